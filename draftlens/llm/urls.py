"""URL filters (op 6): explicit rules, and block decisions passed on along redirect and canonical links.

Links are resolved against their page, entities undone, scheme and host lower-cased, dot segments
and fragments dropped, so that all spellings of an address are one node. Every canonical and
refresh link of a page counts. Repeated pages repeat; ties between rules of one length go to the
longer host, then the smaller text. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.llm.shared import connected_components, cut, drop

# Action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: More rules than this are joined, not compiled into the plan.
MAX_RULES = 100
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
# Character references and what they stand for, the ampersand last.
ENTITIES = [("(?i)&quot;|&#34;|&#x22;", '"'), ("(?i)&apos;|&#39;|&#x27;", "'"), ("(?i)&lt;|&#60;|&#x3c;", "<"), ("(?i)&gt;|&#62;|&#x3e;", ">"), ("(?i)&#47;|&#x2f;", "/"), ("(?i)&amp;|&#38;|&#x26;", "&")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """The path with its `.` and `..` segments worked out."""

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    done = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    # A path that ends in a dot segment names a folder.
    folder = path.rlike(r"/\.{1,2}$") & (done != "/")
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.when(folder, F.concat(done, F.lit("/"))).otherwise(done)).otherwise(path)


def node(url: Column) -> Column:
    """One spelling of an address: scheme and host lower-cased, path at least `/` and without dot segments, no fragment; null without `://`."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    host, path = host_path(url)
    query = F.regexp_extract(url, r"(?s)://[^?#]*(\?[^#]*)", 1)
    path = F.when(path == "", "/").otherwise(_without_dots(path))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host, path, query))


def resolve(page: Column, link: Column) -> Column:
    """A link's address as seen from a page; null for links of other kinds (mailto and such)."""
    for pattern, sign in ENTITIES:
        link = F.regexp_replace(link, pattern, sign)
    link = F.trim(link)
    scheme, site = F.regexp_extract(page, r"(?s)^(.*?)://", 1), F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    _, path = host_path(page)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link.startswith("#"), page)
        .otherwise(F.concat(site, folder, link))
    )


def ruled(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """`rows`, which have host and path, with the longest fitting rule and its action.

    A few rules are compiled into the plan, so that judging a row costs no join; more of them, or
    a table (action, host, path), are joined on the host's suffixes, once per distinct address.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_RULES:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for a, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), [-ord(c) for c in r[1] + r[2]])):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, a).otherwise(action)
        return rows.withColumn("rule", rule).withColumn("action", action)
    if not isinstance(rules, DataFrame):
        rules = rows.sparkSession.createDataFrame(rules, "action string, host string, path string")
    table = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("start")).agg(F.min("action").alias("action"))
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spots = rows.select("host", "path").distinct().withColumn("suffix", F.explode(ends))
    rule = F.concat("suffix", "start")
    met = spots.join(table, "suffix").where("startswith(path, start)").groupBy("host", "path")
    best = met.agg(F.min_by(F.struct(rule.alias("rule"), "action"), F.struct(-F.length(rule), -F.length("suffix"), rule)).alias("_best"))
    return rows.join(best, ["host", "path"], "left").withColumn("rule", F.col("_best.rule")).withColumn("action", F.col("_best.action")).drop("_best")


def links_of(pages: DataFrame) -> DataFrame:
    """The distinct alias links (src, dst) that pages' canonical and refresh links make, as nodes."""
    found = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all("html", F.lit(REFRESH), F.lit(1)))
    rows = pages.select("url", F.explode(found).alias("link"))
    return rows.select(node(F.col("url")).alias("src"), node(resolve(F.col("url"), F.col("link"))).alias("dst")).where("src <> dst").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    The longest fitting rule decides. A page without one takes part in its alias component, over
    links in the html and `redirects` (src, dst): an allow rule among the aliases allows, else a
    block rule blocks, else the page is allowed. Null urls have no aliases.
    """
    host, path = host_path(F.col("url"))
    links = links_of(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")).where("src <> dst"))
    links = cut(links)
    parts = connected_components(links)
    drop(links)
    plain = ruled(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    if parts.isEmpty():  # a small table, already written
        return plain.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    # Aliases that aren't pages themselves are judged by the rules too.
    h, p = host_path(F.col("id"))
    nodes = ruled(parts.withColumn("host", h).withColumn("path", p), rules)
    decided = nodes.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    passed = nodes.select(F.col("id").alias("node"), "component").join(decided, "component")
    passed = passed.select("node", F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("passed"))
    return plain.withColumn("node", node(F.col("url"))).join(passed, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """Holds for tables whose html has no canonical or refresh links, as in the given ones."""
    fits = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    action = " ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for a, h, p in RULES)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, CASE {fits} END AS rule FROM s)
    SELECT page_id, host, path, rule, CASE {action} ELSE 'allow' END AS verdict FROM r"""
