"""The ten operators and the pipeline as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.llm import ann, bpe, chat, decontaminate, jaccard, licenses, secrets, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """A public tokenizer's file and splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_token_counts(spark, sf_dir):
    return bpe.token_counts(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.json"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("record"))
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(chat.PLANTED_RECORD).alias("record"))
    return chat.digests(chat.canonical_turns(rows, "conv_id", "record").unionByName(chat.canonical_turns(planted, "conv_id", "record")))


def op5_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op6_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(), "score", "predicted")


def op8_secret_scan(spark, sf_dir):
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_multi_50k.tiktoken"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_decontamination, op4_chat_format, op5_nearest_neighbours, op6_url_filter, op7_toxicity, op8_secret_scan, op9_bpe_codec, op10_jaccard_join, pipeline)}
ORACLES = {"op2_license_scan": licenses.oracle(), "op4_chat_format": chat.oracle(), "op6_url_filter": urls.oracle()}
