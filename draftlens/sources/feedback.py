"""Review feedback as append-only JSON lines: a batch sink, and a source for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pdf_name string, page int, timestamp timestamp, stamp_id string, action string, nominal string, source string, confidence double, user_correction string, created_at timestamp"
# Known actions, and how many one request may hold.
ACTIONS, MAX_ACTIONS = ["keep", "modify", "delete", "add"], 5000


def append(actions: DataFrame, path: str) -> None:
    """Append one request's actions; an unknown action or more than MAX_ACTIONS fails before writing."""
    seen = actions.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False))).alias("bad")).first()
    if seen["n"] > MAX_ACTIONS or seen["bad"]:
        raise ValueError(f"{seen['n']} actions, {seen['bad']} unknown; at most {MAX_ACTIONS} known ones")
    actions.withColumn("created_at", F.current_timestamp()).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
