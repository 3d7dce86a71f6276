"""Commits on the expected version only, refusals, failures and restores."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from draftlens.operators.mutation import replace_pages
from draftlens.operators.versions import Versions


def test_commit_refuse_restore(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "stamps"))
    assert table.current() == 0 and table.all() == []
    first = spark.createDataFrame([(1, 1, True), (2, 2, False)], "id long, page long, auto boolean")
    assert table.commit(first, 0) and not table.commit(first, 0)
    staged = spark.createDataFrame([(9, 1, True)], first.schema)
    assert table.commit(replace_pages(table.read(), staged, spark.range(1, 2).toDF("page"), F.col("auto")), 1)
    assert [r["id"] for r in table.read().orderBy("id").collect()] == [2, 9]
    assert [r["id"] for r in table.read(1).orderBy("id").collect()] == [1, 2]
    assert table.restore(1, 2) and table.current() == 3
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, first.collect()))


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    table.commit(spark.range(3).toDF("id"), 0)
    with pytest.raises(PySparkException):
        table.commit(table.read().select(F.raise_error(F.lit("no")).alias("id")), 1)
    assert table.all() == [1] and sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["version=00000001"]
    assert table.commit(spark.range(0).toDF("id"), 1) and table.read().count() == 0
