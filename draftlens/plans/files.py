"""Archives as queries, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlens.plans.fixtures import query, table
from draftlens.sources import archives


@query("SELECT doc_id % 50 AS archive, CAST(doc_id AS STRING) || '.txt' AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256, true AS sound FROM documents")
def archive_round_trip(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(50)).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return archives.read(archives.build(parts)).select("archive", "name", "bytes", "sha256", "sound")


@query("""SELECT conv_id, CASE WHEN min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*) THEN 'pages' WHEN conv_id % 5 = 0 THEN 'total' WHEN conv_id % 7 > count(*) OR conv_id % 7 = 0 THEN 'owned' END AS error FROM conversations GROUP BY conv_id""")
def archive_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn") + 1)).alias("pages"))
    total = F.size("pages") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)
    return rows.select("conv_id", archives.pages_error(F.col("pages"), F.array(F.col("conv_id") % 7), total).alias("error"))
