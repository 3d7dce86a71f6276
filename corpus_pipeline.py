"""A corpus pipeline of five stages; each stage's kept documents are written and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.llm import bpe, decontaminate, jaccard, secrets, toxicity
from draftlens.llm.queries import table, vocabulary
from draftlens.llm.shared import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go, each by its own text; empty and null texts score like any other text without segments."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group stays: that with the smallest doc_id; texts without words link with nothing and stay."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their doc_id."""
    return decontaminate.search(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where(F.size("found") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; every row stays, null texts as empty ones."""
    return secrets.redact(docs, keep=["lang", "source"]).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that stay, a row each."""
    ids = bpe.encode(docs, *vocabulary("byte_bpe_multi_50k.tiktoken"))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]
# Model scores, similarity search and tokenizer ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.parquet(f"{root}/{k}_{name}")
    return docs
