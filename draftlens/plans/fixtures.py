"""The library's operators as queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlens.operators import drawing, inspection, spatial, windows
from draftlens.streaming import metrics

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("nominal"), F.col("l_discount").alias("up"), (-F.col("l_tax")).alias("down"))
    rows = rows.withColumn("upper", inspection.limit(F.col("nominal"), F.col("up"))).withColumn("lower", inspection.limit(F.col("nominal"), F.col("down")))
    measured = F.array(F.col("nominal") + F.pmod("l_orderkey", F.lit(3)) * 0.03125)
    return rows.withColumn("result", inspection.result(measured, F.col("upper"), F.col("lower")))


_RECORDS = """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS nominal, round_even(l_quantity + l_discount, 10) AS upper, round_even(l_quantity - l_tax, 10) AS lower FROM lineitem),
 s AS (SELECT *, CASE WHEN nominal + (l_orderkey % 3) * 0.03125::DOUBLE BETWEEN lower AND upper THEN 'OK' ELSE 'NOK' END AS result FROM r) """


@query(_RECORDS + "SELECT l_orderkey, l_linenumber, lower, upper, result FROM s")
def inspect_result(spark, sf_dir):
    return records(spark, sf_dir).select("l_orderkey", "l_linenumber", "lower", "upper", "result")


@query(_RECORDS + """, w AS (SELECT l_orderkey, CASE WHEN bool_or(result = 'NOK') THEN 'NOK' ELSE 'OK' END AS worst, arg_min(lower, (l_linenumber, nominal, lower, upper)) AS lower, arg_min(upper, (l_linenumber, nominal, lower, upper)) AS upper, count(*) AS n_records FROM s GROUP BY 1)
 SELECT o_orderkey, coalesce(worst, 'UNMEASURED') AS worst, lower, upper, coalesce(n_records, 0) AS n_records FROM orders LEFT JOIN w ON o_orderkey = l_orderkey""")
def inspect_worst_by_item(spark, sf_dir):
    worst = inspection.worst_by_item(records(spark, sf_dir), "l_orderkey", F.struct("l_linenumber", "nominal", "lower", "upper"))
    items = table(spark, sf_dir, "orders").select("o_orderkey")
    return items.join(worst, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("worst", F.lit("UNMEASURED")).alias("worst"), "lower", "upper", F.coalesce("n_records", F.lit(0)).alias("n_records"))


def boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_orderkey", F.lit(4096)).alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.pmod(F.col("l_partkey") * 37, F.lit(1000)).cast("double").alias("x0"), F.pmod(F.col("l_suppkey") * 91 + F.col("l_linenumber") * 13, F.lit(700)).cast("double").alias("y0"), (4 + F.col("l_quantity") % 20).alias("w"), (4.0 + F.col("l_linenumber")).alias("h"))
    return rows.select("page", "id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


_BOXES = """WITH b AS (SELECT l_orderkey % 4096 AS page, l_orderkey * 8 + l_linenumber AS id, (l_partkey * 37 % 1000)::DOUBLE AS x0, ((l_suppkey * 91 + l_linenumber * 13) % 700)::DOUBLE AS y0,
 (l_partkey * 37 % 1000) + 4 + l_quantity % 20 AS x1, (l_suppkey * 91 + l_linenumber * 13) % 700 + 4.0::DOUBLE + l_linenumber AS y1 FROM lineitem) """


@query(_BOXES + "SELECT p.page AS page, p.id AS left_id, q.id AS right_id FROM b p JOIN b q ON p.page = q.page AND p.id < q.id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1")
def grid_range_join(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.box_join(b, b).where("left_id < right_id")


@query(_BOXES + """, v AS (SELECT page, id AS view_id, greatest(x0 - 100, 0) AS x0, greatest(y0 - 80, 0) AS y0, x1 + 100 AS x1, y1 + 80 AS y1 FROM b WHERE id % 8 = 1)
 SELECT b.page AS page, b.id AS id, (SELECT arg_min(view_id, (((v.x1 - v.x0) * (v.y1 - v.y0)), view_id)) FROM v WHERE v.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN v.x0 AND v.x1 AND (b.y0 + b.y1) / 2 BETWEEN v.y0 AND v.y1) AS view_id FROM b""")
def view_owner(spark, sf_dir):
    b = boxes(spark, sf_dir)
    views = b.where("id % 8 = 1").selectExpr("page", "id", "greatest(x0 - 100, 0) x0", "greatest(y0 - 80, 0) y0", "x1 + 100 x1", "y1 + 80 y1")
    return spatial.owner(b, views)


@query(_BOXES + """, o AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, x0, id) >= 12 THEN 1 ELSE 0 END AS open FROM b),
 r AS (SELECT *, sum(open) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS UNBOUNDED PRECEDING) AS r FROM o)
 SELECT page, id, CAST(r AS BIGINT) AS "row", row_number() OVER (PARTITION BY page ORDER BY r, x0, y0, id) AS place FROM r""")
def reading_order(spark, sf_dir):
    return windows.reading_order(boxes(spark, sf_dir).selectExpr("page", "id", "x0 x", "y0 y"), 12.0).select("page", "id", "row", "place")


@query(_BOXES + """, e AS (SELECT page, y0, y1, max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
 SELECT page, sum(greatest(0, y1 - greatest(y0, coalesce(before, y0)))) AS covered FROM e GROUP BY page""")
def interval_coverage(spark, sf_dir):
    return windows.coverage(boxes(spark, sf_dir).select("page", "y0", "y1"), "page", "y0", "y1")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return windows.forward_fill(rows, "conv_id", ["turn"], "asked", "asked_at").select("conv_id", "turn", "asked_at")


@query("SELECT digest, min(doc_id) AS first_id, count(*) AS n_copies FROM (SELECT doc_id, sha256(text) AS digest FROM documents) GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return drawing.duplicate_groups(table(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("doc_id"))


@query("SELECT event_type, count(*) AS n, count_if(value < 0) AS n_errors, max(value) AS max_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def metrics_by_route(spark, sf_dir):
    return metrics.by_route(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


@query("SELECT event_type, user_id % 4 AS status, count(*) AS n FROM events GROUP BY 1, 2")
def metrics_by_status(spark, sf_dir):
    return metrics.by_status(table(spark, sf_dir, "events").withColumn("status", F.pmod("user_id", F.lit(4))), "event_type", "status")


@query("SELECT page, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 4999)) AS page) LEFT JOIN (SELECT l_orderkey % 4096 AS p, count(*) AS n FROM lineitem GROUP BY 1) ON p = page")
def page_counts_with_zeros(spark, sf_dir):
    return drawing.page_counts(boxes(spark, sf_dir), "page", 5000)


@query("SELECT width, n FROM (SELECT l_tax AS width, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1) ORDER BY n DESC, first LIMIT 1")
def width_mode(spark, sf_dir):
    return drawing.modal_width(table(spark, sf_dir, "lineitem"), F.col("l_tax"), F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query("SELECT o_orderkey, unnest(range(1, 1 + greatest(1, least(999, CASE WHEN o_orderkey % 50 = 0 THEN 1200 WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 5 - 1 END)))) AS copy FROM orders")
def quantity_expand(spark, sf_dir):
    quantity = F.when(F.col("o_orderkey") % 50 == 0, 1200).when(F.col("o_orderkey") % 7 != 0, F.pmod("o_orderkey", F.lit(5)) - 1)
    return drawing.expand_quantity(table(spark, sf_dir, "orders").select("o_orderkey"), quantity)


@query("SELECT d.doc_id AS doc_id, CASE WHEN l.doc_id IS NULL THEN -1 WHEN l.doc_id % 4 = 0 THEN NULL ELSE l.quality END AS quality, l.doc_id IS NOT NULL AS decided FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def overlay_decisions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("quality")).alias("quality"))
    return drawing.overlay(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", {"quality": F.lit(-1)}).select("doc_id", "quality", "decided")


@query("""SELECT source, count(*) AS n_in, count_if(n_chars >= 100 AND lang <> 'es') AS n_out, min(CASE WHEN n_chars < 100 OR lang = 'es' THEN doc_id END) AS first_drop, count_if(n_chars < 100) AS n_short, count_if(n_chars >= 100 AND lang = 'es') AS n_other FROM documents GROUP BY 1""")
def drop_ledger(spark, sf_dir):
    out = drawing.drop_ledger(table(spark, sf_dir, "documents"), "source", [("short", F.col("n_chars") < 100), ("other", F.col("lang") == "es")], F.col("doc_id"))
    n = lambda name: F.coalesce(F.col("by_reason")[name], F.lit(0)).alias(f"n_{name}")
    return out.select("source", "n_in", "n_out", "first_drop", n("short"), n("other"))


@query("SELECT a.p_partkey AS key, b.p_partkey AS entry FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND abs(b.p_retailprice - a.p_retailprice) <= 2 AND abs(a.p_partkey - b.p_partkey) <= 900")
def key_band_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return drawing.band_lookup(part, part, ["p_size", "p_brand"], {"p_retailprice": 2.0, "p_partkey": 900.0}, "p_partkey", "p_partkey")
