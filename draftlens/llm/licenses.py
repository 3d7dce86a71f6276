"""License scans (op 2): canonical digests of whole texts, hash-joined to known licence digests.

A whole text counts: lower-cased, without copyright lines, "all rights reserved" and title lines,
punctuation and line breaks one blank, equivalent spellings unified. Licence lines among other text
are no licence text. Repeated documents repeat; very long texts are digested whole; a digest that
several known texts share goes to the smallest licence id; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.llm.license_texts import DIGESTS, KNOWN

# Equivalent spellings, first form replaced by the second.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("non infringement", "noninfringement"), ("favour", "favor"), ("wilful", "willful"), ("per cent", "percent"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder")]
# Patterns of what isn't part of a text: copyright lines (a body line that goes on "copyright notice ..." stays) and
# reservations of rights, after the marks of a comment, and then a title line at the beginning.
MARKS = r"^[ \t/*#;%!.\-]*"
LINES = [
    MARKS + r"(?:copyright[ \t:]*(?:\(c\)|©|&copy;|[12][0-9][0-9][0-9]|<|\[|\{|by )|\(c\)[ \t]|©)[^\n]*$",
    MARKS + r"all rights reserved[. \t*/]*$",
    r"\A\s*[ \t/*#;%!.\-]*(?:the )?[a-z0-9.,+()\"' \t-]{0,60}licen[sc]e(?:,? (?:version|v)?[. ]*[0-9.]+)?(?:[ \t]*\([^\n()]*\))?[ \t*/]*\n",
]


def canonical(text: Column) -> Column:
    """Lower case; copyright, rights and title lines gone; punctuation and runs of space one blank; spellings unified."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for line in LINES:
        out = F.regexp_replace(out, "(?md)" + line, "")
    out = F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{old}", new)
    return out


def scan(docs: DataFrame, known: dict[str, str] | DataFrame | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """Every document's doc_id, digest and license_id (null: no known text).

    `known` is a mapping or a table (license_id, text), `digests` maps further ids to canonical
    digests; by default all of `license_texts`. Spark picks the join's strategy from the size of
    the licence side. A null or empty text has the digest of the empty string and matches nothing.
    """
    spark = docs.sparkSession
    if known is None:
        known, digests = KNOWN, DIGESTS if digests is None else digests
    if not isinstance(known, DataFrame):
        known = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in known.items()])))
    table = known.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''").select("license_id", F.sha2("c", 256).alias("digest"))
    if digests:
        table = table.unionByName(spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("digest")) for k, v in digests.items()]))))
    table = table.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(table, "digest", "left").select("doc_id", "digest", "license_id")


def _sql_canonical(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for line in LINES:
        out = "regexp_replace({}, '(?m){}', '', 'g')".format(out, line.replace("'", "''"))
    out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{old}', '{new}', 'g')"
    return out


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    more = "".join(f" UNION ALL SELECT '{v}', '{k}'" for k, v in DIGESTS.items())
    return f"""
    WITH texts AS (SELECT k, {_sql_canonical('t')} AS c FROM (VALUES {values}) v(k, t)), every AS (SELECT sha256(c) AS digest, k FROM texts WHERE c <> ''{more}),
    known AS (SELECT digest, min(k) AS license_id FROM every GROUP BY 1), d AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
    SELECT doc_id, d.digest AS digest, license_id FROM d LEFT JOIN known ON d.digest = known.digest"""
