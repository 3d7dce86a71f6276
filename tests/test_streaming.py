"""Streams against the same operators on a batch; the feedback sink and source."""

import pytest
from pyspark.sql import functions as F

from draftlens.sources import feedback
from draftlens.streaming import metrics

SF = "/root/testdata/sf0.001"


def test_route_metrics_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    run = metrics.by_route(stream, "event_type", "value", ["ts", "event_id"]).writeStream.outputMode("complete").format("memory").queryName("routes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    want = metrics.by_route(events, "event_type", "value", ["ts", "event_id"])
    assert sorted(spark.table("routes").collect()) == sorted(want.collect())


def test_feedback_round_trip(spark, tmp_path):
    path = str(tmp_path / "feedback")
    rows = spark.createDataFrame([("a.pdf", 1, "keep"), ("a.pdf", 2, "delete")], "pdf_name string, page int, action string")
    feedback.append(rows, path)
    feedback.append(rows.limit(1), path)
    assert feedback.read(spark, path).groupBy("action").count().where("action in ('keep', 'delete')").agg(F.sum("count")).first()[0] == 3
    assert feedback.read_stream(spark, path).isStreaming
    for bad in (rows.withColumn("action", F.lit("drop")), rows.withColumn("action", F.lit(None).cast("string")), spark.range(feedback.MAX_ACTIONS + 1).withColumn("action", F.lit("keep"))):
        with pytest.raises(ValueError):
            feedback.append(bad, path)
