"""Dimension texts, boxes, points and page tables as queries, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlens.functions import dimension_text
from draftlens.operators import drawing, graph, mutation, ranking
from draftlens.plans.fixtures import query, table

# The text of a made-up dimension, in SQL that both engines read alike.
_TEXT = """concat(CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size * 25 AS STRING), 'X') ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'Ø' WHEN 1 THEN 'R' WHEN 2 THEN '⌀ ' WHEN 3 THEN 'Ra' ELSE '' END,
 CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(p_partkey % 1200 AS STRING) END, CASE WHEN p_size % 2 = 0 THEN concat('.', CAST(p_size AS STRING)) ELSE '' END, CASE WHEN p_partkey % 13 = 0 THEN '.5' WHEN p_partkey % 7 = 0 THEN '°' ELSE '' END,
 CASE p_size % 9 WHEN 0 THEN '±0.1' WHEN 1 THEN '+0.2/-0.1' WHEN 2 THEN '+12' WHEN 3 THEN 'MAX' WHEN 4 THEN ' - 0.05' WHEN 5 THEN '---' WHEN 6 THEN '+0.1MIN' WHEN 7 THEN 'x45°' ELSE '' END)"""
_SIDE = r"[0-9](\.[0-9]{1,3})?°?"
_REASON = rf"""WITH t AS (SELECT p_partkey, {_TEXT} AS raw FROM part), c AS (SELECT *, translate(regexp_replace(raw, '\s+', '', 'g'), 'ø⌀∅Φφ', 'ØØØØØ') AS whole FROM t),
 b AS (SELECT *, regexp_replace(whole, '(MAX|MIN)$', '') AS body, regexp_matches(whole, '(MAX|MIN)$') AS qualified FROM c),
 r AS (SELECT *, regexp_extract(body, '^([0-9]+)[*xX×]', 1) AS qty, regexp_replace(regexp_replace(body, '^([0-9]+)[*xX×]', ''), '^(Ra|R|Ø)', '') AS rest FROM b),
 m AS (SELECT *, regexp_extract(rest, '^(.?[^+±-]*)', 1) AS main FROM r), l AS (SELECT *, substring(rest, length(main) + 1) AS tol FROM m),
 v AS (SELECT *, CASE WHEN whole = '' THEN 'empty' WHEN regexp_full_match(whole, '[.+±/-]+') THEN 'symbol_only' WHEN NOT regexp_matches(whole, '[0-9]') THEN 'no_digits' WHEN contains(whole, '---') THEN 'long_minus_run'
  WHEN regexp_full_match(body, '[+-]?[0-9]{{1,3}}(\.[0-9]{{1,3}})?[*xX×][0-9]{{1,3}}(\.[0-9]{{1,3}})?°') THEN CASE WHEN qualified THEN 'invalid_qualifier' ELSE 'ok' END
  WHEN qty <> '' AND (length(qty) > 3 OR NOT regexp_matches(qty, '[1-9]')) THEN 'invalid_quantity' WHEN main = '' THEN 'missing_main' WHEN contains(tol, '°') AND NOT suffix(main, '°') THEN 'invalid_degree_unit'
  WHEN NOT regexp_full_match(main, '[+-]?[0-9]{{1,3}}(\.[0-9]{{1,3}})?°?') THEN 'invalid_main_number' WHEN tol <> '' AND NOT regexp_full_match(tol, '±{_SIDE}|[+-]{_SIDE}(/?[+-]{_SIDE})?') THEN 'invalid_tolerance_number'
  WHEN tol <> '' AND qualified THEN 'invalid_qualifier' ELSE 'ok' END AS reason FROM l) """


@query(_REASON + "SELECT p_partkey, whole AS canonical, reason, reason IN ('symbol_only', 'long_minus_run', 'invalid_tolerance_number') AS blocked FROM v")
def dim_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEXT).alias("raw"))
    rows = rows.select("p_partkey", dimension_text.canonical(F.col("raw")).alias("canonical"), dimension_text.reason(F.col("raw")).alias("reason"))
    return rows.withColumn("blocked", dimension_text.blocks_output(F.col("reason")))


@query(_REASON + r", s AS (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN 'unread_glyph_present' WHEN reason = 'ok' THEN 'ok' WHEN regexp_full_match(raw, '([0-9]+[xX×])?[ØR]?[+-]?[0-9]+(\.[0-9]+){2,}') THEN 'incomplete_separator' ELSE 'invalid_dimension_syntax' END AS label FROM v) SELECT label, count(*) AS n FROM s GROUP BY label")
def dim_syntax_label(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEXT).alias("raw"))
    drops = F.when(F.col("p_partkey") % 17 == 0, F.array(F.lit("unrecognized_slot")))
    return rows.groupBy(dimension_text.syntax_label(F.col("raw"), drops).alias("label")).agg(F.count("*").alias("n"))


def points(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.min("o_custkey").alias("c")).selectExpr("c % 64 page", "id", "cast(id * 37 % 1000 as double) x", "cast(id * 91 % 700 as double) y")


_POINTS = """WITH RECURSIVE p AS (SELECT min(o_custkey) % 64 AS page, o_orderkey AS id, (o_orderkey * 37 % 1000)::DOUBLE AS x, (o_orderkey * 91 % 700)::DOUBLE AS y FROM orders GROUP BY o_orderkey),
 near AS (SELECT a.page AS page, a.id AS src, b.id AS dst FROM p a JOIN p b ON a.page = b.page AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 30)"""


@query(_POINTS + " SELECT page, src, dst FROM near WHERE src < dst")
def endpoint_pairs(spark, sf_dir):
    return graph.near_pairs(points(spark, sf_dir), 30.0)


@query(_POINTS + """, core AS (SELECT src AS id FROM near GROUP BY src HAVING count(*) >= 2), e AS (SELECT src, dst FROM near WHERE src IN (FROM core) AND dst IN (FROM core)),
 reach AS (SELECT id, id AS got FROM core UNION SELECT r.id, e.dst FROM reach r JOIN e ON r.got = e.src), c AS (SELECT id, min(got) AS cluster FROM reach GROUP BY id),
 border AS (SELECT src AS id, min(cluster) AS cluster FROM near JOIN c ON dst = c.id WHERE src NOT IN (FROM core) GROUP BY src), l AS (FROM c UNION ALL FROM border)
 SELECT p.id AS id, cluster FROM p LEFT JOIN l ON p.id = l.id""")
def dbscan3(spark, sf_dir):
    return graph.dbscan(points(spark, sf_dir), 30.0, 3)


def detections(spark, sf_dir):
    return points(spark, sf_dir).selectExpr("page", "id", "x x0", "y y0", "x + 30 + id % 20 x1", "y + 25 + id % 15 y1", "id % 97 score")


@query("""WITH RECURSIVE b AS (SELECT min(o_custkey) % 64 AS page, o_orderkey AS id, (o_orderkey * 37 % 1000)::DOUBLE AS x0, (o_orderkey * 91 % 700)::DOUBLE AS y0, x0 + 30 + o_orderkey % 20 AS x1, y0 + 25 + o_orderkey % 15 AS y1 FROM orders GROUP BY o_orderkey),
 k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id % 97 DESC, id) AS place FROM b),
 c AS (SELECT w.page AS page, w.place AS winner, l.place AS loser, greatest(0, least(w.x1, l.x1) - greatest(w.x0, l.x0)) * greatest(0, least(w.y1, l.y1) - greatest(w.y0, l.y0)) AS shared, (w.x1 - w.x0) * (w.y1 - w.y0) AS aw, (l.x1 - l.x0) * (l.y1 - l.y0) AS al FROM k w JOIN k l ON w.page = l.page AND w.place < l.place AND w.x0 <= l.x1 AND l.x0 <= w.x1 AND w.y0 <= l.y1 AND l.y0 <= w.y1),
 z AS (SELECT page, loser, list(winner) AS winners FROM c WHERE shared / (aw + al - shared) >= 0.3 OR shared / least(aw, al) >= 0.8 GROUP BY page, loser),
 g AS (SELECT k.page AS page, k.place AS place, k.id AS id, coalesce(z.winners, []) AS winners FROM k LEFT JOIN z ON k.page = z.page AND k.place = z.loser),
 s AS (SELECT DISTINCT page, 0::BIGINT AS place, []::BIGINT[] AS kept FROM k UNION ALL SELECT s.page, g.place, CASE WHEN list_has_any(s.kept, g.winners) THEN s.kept ELSE list_append(s.kept, g.place) END FROM s JOIN g ON s.page = g.page AND g.place = s.place + 1),
 last AS (SELECT page, arg_max(kept, place) AS kept FROM s GROUP BY page)
 SELECT g.page AS page, id FROM g JOIN last ON g.page = last.page WHERE list_contains(kept, place)""")
def nms_final(spark, sf_dir):
    from draftlens.functions.segments import same_place

    boxes = detections(spark, sf_dir).withColumn("down", -F.col("score"))
    return ranking.dedupe_boxes(boxes, ["down"], same_place, looks_at=[]).select("page", "id")


@query("""WITH c AS (SELECT l_orderkey AS key, l_linenumber AS candidate, min(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (l_partkey * 7 + l_suppkey * 31) % 50 / 2.0 END) AS score FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS place, abs(lead(score) OVER w - score) AS gap FROM c WHERE score IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY score, candidate)) SELECT key, candidate, score FROM r WHERE place = 1 AND NOT coalesce(gap < 5 AND gap / greatest(abs(score), 1) < 0.15, false)""")
def topk_margin(spark, sf_dir):
    score = F.when(F.col("l_partkey") % 11 != 0, (F.col("l_partkey") * 7 + F.col("l_suppkey") * 31) % 50 / 2.0)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("candidate")).agg(F.min(score).alias("score"))
    return ranking.best_unless_ambiguous(rows, "key", "score", "candidate").select("key", "candidate", "score")


@query("""WITH t AS (SELECT o_orderkey AS id, o_custkey % 64 AS page, o_orderkey % 3 <> 0 AS auto, 'old' AS version FROM orders), s AS (SELECT o_orderkey AS id, o_custkey % 64 AS page, true AS auto, 'new' AS version FROM orders WHERE o_orderkey % 5 = 0)
 SELECT * FROM t WHERE NOT auto OR page % 4 <> 0 UNION ALL SELECT * FROM s WHERE page % 4 = 0""")
def partition_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.selectExpr("o_orderkey id", "o_custkey % 64 page", "o_orderkey % 3 <> 0 auto", "'old' version")
    new = orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey id", "o_custkey % 64 page", "true auto", "'new' version")
    return mutation.replace_pages(old, new, spark.range(0, 64, 4).toDF("page"), F.col("auto")).select("id", "page", "auto", "version")


@query("""WITH d AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS k, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS size FROM documents), m AS (SELECT k, median(size) AS mid FROM d WHERE size > 0 GROUP BY k)
 SELECT doc_id, CASE WHEN size > 1.5 * mid THEN 'L' WHEN size < 0.8 * mid THEN 'S' ELSE 'M' END AS layer FROM d LEFT JOIN m ON d.k IS NOT DISTINCT FROM m.k""")
def font_layer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars")).alias("size"))
    return drawing.font_layers(docs, "size", ["lang"]).select("doc_id", "layer")


@query("""WITH w AS (SELECT round_even(l_tax, 4) AS width, sum(l_quantity) AS total FROM lineitem WHERE l_tax > 0.01 GROUP BY 1), t AS (SELECT * FROM w ORDER BY total DESC, width LIMIT 2)
 SELECT CASE count(*) WHEN 0 THEN 0.5 WHEN 1 THEN max(width) * 1.5 ELSE avg(width) END AS threshold FROM t""")
def width_threshold(spark, sf_dir):
    return drawing.width_threshold(table(spark, sf_dir, "lineitem"), F.col("l_tax"), F.col("l_quantity"))


@query("""SELECT kind, count(*) AS n, min(label) AS first_label FROM (SELECT CASE WHEN regexp_full_match(label, '[0-9]+(-.*)?') THEN 0 ELSE 1 END AS kind, label FROM (SELECT CASE p_size % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat(CAST(p_partkey AS STRING), '-', CAST(p_size AS STRING)) WHEN 2 THEN concat(CAST(p_partkey AS STRING), '-x') ELSE concat('A', CAST(p_partkey AS STRING)) END AS label FROM part)) GROUP BY 1""")
def label_kinds(spark, sf_dir):
    label = F.expr("CASE p_size % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat(CAST(p_partkey AS STRING), '-', CAST(p_size AS STRING)) WHEN 2 THEN concat(CAST(p_partkey AS STRING), '-x') ELSE concat('A', CAST(p_partkey AS STRING)) END")
    return table(spark, sf_dir, "part").select(drawing.label_order(label).alias("o")).groupBy("o.kind").agg(F.count("*").alias("n"), F.min("o.label").alias("first_label"))


@query("""WITH s AS (SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat(CAST(p_partkey // 7 AS STRING), '-', CAST(p_size AS STRING)) ELSE concat('A', CAST(p_partkey AS STRING)) END AS label FROM part)
 SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN starts_with(label, 'A') THEN 1 ELSE 0 END, TRY_CAST(regexp_extract(label, '^[0-9]+') AS BIGINT), CASE WHEN contains(label, '-') THEN CAST(string_split(label, '-')[2] AS BIGINT) ELSE 0 END, label) AS place FROM s""")
def label_places(spark, sf_dir):
    from pyspark.sql import Window

    label = F.expr("CASE p_size % 3 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat(CAST(p_partkey div 7 AS STRING), '-', CAST(p_size AS STRING)) ELSE concat('A', CAST(p_partkey AS STRING)) END")
    rows = table(spark, sf_dir, "part").withColumn("o", drawing.label_order(label))
    # The SQL leaves equal labels of a brand open; DuckDB puts the later key first at sf0.01, and varies from run to run at sf0.1.
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("o", F.desc("p_partkey"))).alias("place"))


@query("""SELECT l_suppkey, list_sort(list(l_quantity))[1 + CAST(round_even((count(*) - 1) * 0.25, 0) AS BIGINT)] AS low, list_sort(list(l_quantity))[1 + CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT)] AS high FROM lineitem GROUP BY 1""")
def nearest_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_quantity").alias("v"))
    return rows.select("l_suppkey", drawing.nearest_rank(F.col("v"), 0.25).alias("low"), drawing.nearest_rank(F.col("v"), 0.9).alias("high"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey, o_custkey) AS BIGINT) AS number FROM (SELECT o_orderpriority, o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1, 2)")
def running_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderkey").agg(F.min("o_custkey").alias("o_custkey"))
    return drawing.running_number(rows, "o_orderpriority", ["o_orderkey", "o_custkey"]).select("o_orderkey", "number")


_REGIONS = """WITH p AS (SELECT min(o_custkey) % 64 AS page, o_orderkey AS id, (o_orderkey * 37 % 1000)::DOUBLE AS x0, (o_orderkey * 91 % 700)::DOUBLE AS y0 FROM orders GROUP BY o_orderkey), r AS (SELECT page, id, x0, y0, x0 + 60 AS x1, y0 + 40 AS y1 FROM p WHERE id % 5 = 0), v AS (SELECT page, x0 - 10 AS x0, y0 - 10 AS y0, x0 + 45 AS x1, y0 + 60 AS y1 FROM p WHERE id % 7 = 1), c AS (SELECT page, x0, y0, x0 + 9 AS x1, y0 + 9 AS y1 FROM p) """


@query(_REGIONS + """, s AS (SELECT r.page, r.id, max(greatest(0, least(r.x1, v.x1) - greatest(r.x0, v.x0)) * greatest(0, least(r.y1, v.y1) - greatest(r.y0, v.y0)) / 2400) AS share FROM r JOIN v ON r.page = v.page GROUP BY 1, 2),
 n AS (SELECT r.page, r.id, count(*) AS n FROM r JOIN c ON r.page = c.page AND (c.x0 + c.x1) / 2 BETWEEN r.x0 AND r.x1 AND (c.y0 + c.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY 1, 2)
 SELECT r.page AS page, r.id AS id FROM r LEFT JOIN s ON r.id = s.id AND r.page = s.page LEFT JOIN n ON r.id = n.id AND r.page = n.page WHERE coalesce(share, 0) < 0.5 OR coalesce(n, 0) >= 2""")
def table_regions_kept(spark, sf_dir):
    p = points(spark, sf_dir)
    regions = p.where("id % 5 = 0").selectExpr("page", "id", "x x0", "y y0", "x + 60 x1", "y + 40 y1")
    views = p.where("id % 7 = 1").selectExpr("page", "x - 10 x0", "y - 10 y0", "x + 45 x1", "y + 60 y1")
    cells = p.selectExpr("page", "x x0", "y y0", "x + 9 x1", "y + 9 y1")
    return drawing.table_regions_outside_views(regions, views, cells, least_cells=2).select("page", "id")


_SHORT = """SELECT page, id, x, y, CASE id % 4 WHEN 0 THEN concat(CAST(id % 90 AS STRING)) WHEN 1 THEN concat('R', CAST(id % 60 AS STRING)) WHEN 2 THEN concat('R', CAST(id % 60 AS STRING), ' +0.', CAST(id % 90 AS STRING)) ELSE concat(CAST(id % 90 AS STRING), '±0.1') END AS text, id % 6 = 0 OR id % 6 = 1 AS toleranced FROM """


@query("WITH q AS (SELECT min(o_custkey) % 64 AS page, o_orderkey AS id, (o_orderkey * 37 % 1000)::DOUBLE AS x, (o_orderkey * 91 % 700)::DOUBLE AS y FROM orders GROUP BY o_orderkey), t AS (SELECT *, replace(text, ' ', '') AS c FROM (" + _SHORT + """q))
 SELECT a.page AS page, a.id AS id FROM t a WHERE NOT ((regexp_full_match(a.c, '[0-9]{1,3}') OR regexp_full_match(a.c, 'R[0-9]{1,2}') AND NOT a.toleranced) AND EXISTS (SELECT 1 FROM t b WHERE a.page = b.page AND length(b.c) > length(a.c) AND contains(b.c, a.c) AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 50))""")
def fragments_dropped(spark, sf_dir):
    points(spark, sf_dir).createOrReplaceTempView("_made_points")
    return drawing.without_fragments(spark.sql(_SHORT + "_made_points")).select("page", "id")


@query("SELECT l_orderkey % 4096 AS page, min((l_partkey * 37 % 1000)::DOUBLE) AS x0, max((l_partkey * 37 % 1000) + 4 + l_quantity % 20) AS x1 FROM lineitem GROUP BY 1")
def page_boxes(spark, sf_dir):
    from draftlens.plans.fixtures import boxes

    return drawing.union_box(boxes(spark, sf_dir), ["page"]).select("page", "x0", "x1")
