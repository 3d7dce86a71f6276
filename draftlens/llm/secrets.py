"""Secret scans (op 8): key patterns plus strings whose sliding-window entropy is high.

All of it is column expressions. Spans count code points, end exclusive. Null texts are empty;
repeated rows give repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, least length. They tile like the contract's base patterns.
ASSIGN = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]
# Candidates for entropy: class, pattern, window, least bits per character in some
# window, and what else the string has to hold (all of it).
CLASSES = [
    ("hex", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_=-])", 24, 3.0, ["[0-9]", "[A-Fa-f]"]),
    ("alphanumeric", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9]{16,23}(?![A-Za-z0-9+/_=-])", 16, 3.4, ["[0-9]", "[A-Z]", "[a-z]"]),
    ("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0, ["[A-Z0-9+/_=-]", "[A-Za-z]"]),
]
# Strings that look random but are known identifiers: UUIDs, numbers, names made of words.
ALLOWED = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9_=+/-]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]*|[A-Z]+|[=_+/-]*(?:[A-Za-z]?[a-z]+[=_+/-]+)+[A-Za-z]?[a-z]*|[=_+/-]*(?:[A-Z]+[=_+/-]+)*[A-Z]*[=_+/-]*)$"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Where the pattern's matches lie, from the lengths of the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["pieces"])
        end = start + F.length(z["found"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = F.lit(True) if keep is None else keep(z["found"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("pieces"), found.alias("found"))
    return F.when(F.size(found) > 0, F.aggregate(zipped, zero, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def peak_entropy(text: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits per character, of any window of an ASCII string.

    The window's sum of c * log2(c) changes by one character in and one out as it slides.
    """
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    cost = lambda n: F.element_at(logs, n + 1)
    count = lambda within, c: F.length(within) - F.length(F.replace(within, c, F.lit("")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))

    def step(acc: Column, i: Column) -> Column:
        start = F.greatest(i - window, F.lit(1))
        into, before = F.substring(text, i, F.lit(1)), F.substring(text, start, i - start)
        n_in = count(before, into)
        s = acc["s"] + cost(n_in + 1) - cost(n_in)
        gone = F.substring(text, start, F.lit(1))
        n_out = count(before, gone) + F.when(gone == into, 1).otherwise(0)
        s = F.when(i > window, s + cost(F.greatest(n_out - 1, F.lit(0))) - cost(n_out)).otherwise(s)
        return F.struct(s.alias("s"), F.when(i >= window, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

    slid = F.aggregate(F.sequence(F.lit(1), F.length(text)), zero, step, lambda acc: F.lit(math.log2(window)) - acc["low"] / window)
    return F.when(F.length(text) >= window, slid).otherwise(F.lit(0.0))


def scan(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id and its spans (start, kind as a place in KINDS, end), by start and then kind.

    Base kinds stay whatever the method adds; an entropy span within a base span, or within one of
    an earlier class, isn't repeated.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *keep)
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    base = F.concat(_spans(F.col("text"), ASSIGN, 0, keep=long_value), _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2))
    rows = rows.withColumn("base", base)
    extra = F.array().cast(SPAN)
    for _, pattern, window, least, holds in CLASSES:

        def random(m: Column, window=window, least=least, holds=holds) -> Column:
            has = ~m.rlike(ALLOWED)
            for p in holds:
                has = has & m.rlike(p)
            return F.when(has, peak_entropy(m, window) >= least).otherwise(F.lit(False))

        extra = F.concat(extra, _spans(F.col("text"), pattern, 3, keep=random))
    rows = rows.withColumn("extra", F.array_distinct(extra))
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return rows.select("doc_id", "text", *keep, F.array_sort(F.col("base")).alias("base"), F.array_sort(F.concat("base", F.filter("extra", lambda s: ~inside(s)))).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns over the spans of `scan`."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scan(docs).select("doc_id", n(0), n(1), n(2), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The documents with every span replaced by `[kind]`; overlapping spans become one."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring("text", acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        added = F.concat(acc["out"], F.array(kept, F.element_at(names, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], added).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"].cast("int") + 1, 2147483647)))
    return scan(docs, keep).select("doc_id", *keep, F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))
