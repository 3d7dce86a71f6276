"""Graphs over rows: pairs of near points, connected components, density clusters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that one task may hold; a graph with more is contracted in rounds over all tasks.
LOCAL_EDGES = 400_000
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.gettempdir() + "/draftlens-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later steps don't recompute it.

    The shuffle files behind it go once it is written; the folder goes with `drop`, or when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what `cut` wrote for these tables; nothing may read them afterwards."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            at, files = _hadoop(table.sparkSession, path)
            files.delete(at, True)


def _forest(limit: int):
    """Union-find over a task's edges: each node but its set's smallest, with that one. At `limit` nodes it starts afresh."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def out(schema):
            low = [(x, find(x)) for x in list(root)]
            low = [r for r in low if r[0] != r[1]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in low], schema.field(i).type) for i in (0, 1)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > limit:
                yield out(schema)
                root.clear()
        if root:
            yield out(schema)

    return work


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Label each endpoint of `edges` (src, dst) with the smallest id it can reach: columns id, component.

    Every task first replaces its edges by the stars of their sets. When at most `local_edges`
    remain, one task finishes; else large-star and small-star rounds go on, each written to the
    shared folder, until a round changes nothing. Null ends and self loops are ignored; repeated
    edges count once; an empty edge table gives an empty result.
    """
    clean = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    pairs = cut(clean.mapInArrow(_forest(1 << 19), clean.schema))
    seen = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        if state["n"] <= local_edges:
            stars = cut(pairs.coalesce(1).mapInArrow(_forest(4 * local_edges), pairs.schema))
            drop(pairs)
            break
        if tuple(state) == seen:
            stars = pairs
            break
        seen, old = tuple(state), pairs
        both = pairs.union(pairs.select("dst", "src"))
        low = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low)
        pairs = cut(small.where("src <> dst").distinct())
        drop(old)
    roots = stars.select("dst").distinct()
    return stars.toDF("id", "component").unionByName(roots.select(F.col("dst").alias("id"), F.col("dst").alias("component")))


def near_pairs(points: DataFrame, eps: float) -> DataFrame:
    """Pairs (src < dst) of ids on one page at most `eps` apart, through a grid of that size."""
    at = points.select("page", "id", "x", "y", F.floor(F.col("x") / eps).alias("cx"), F.floor(F.col("y") / eps).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = at.withColumn("s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("s.i")).withColumn("cy", F.col("cy") + F.col("s.j"))
    a, b = at.alias("a"), around.alias("b")
    same = F.expr("a.page = b.page and a.cx = b.cx and a.cy = b.cy and a.id < b.id")
    near = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) <= eps
    return a.join(b, same & near).select(F.col("a.page").alias("page"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """id and cluster (its smallest core id; null: noise) of points with unique ids.

    A point with `min_points` points within `eps`, itself included, is a core; a border point
    goes to the smallest cluster among the cores near it. Points at one spot are one point with
    their number, so copies form no pairs; points without a page or finite place are near none.
    """
    lone = F.when(F.coalesce(F.col("page").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)), F.lit(None)).otherwise(F.col("id"))
    placed = points.select("page", "x", "y", "id", lone.alias("_lone"))
    spots = cut(placed.groupBy("page", "x", "y", "_lone").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = cut(near_pairs(spots, eps).select("src", "dst"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    around = both.join(spots.select(F.col("id").alias("dst"), "n"), "dst").select("src", "n").unionByName(spots.select(F.col("id").alias("src"), "n"))
    cores = cut(around.groupBy("src").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("src"))
    between = both.where("src < dst").join(cores, "src", "left_semi").join(cores.toDF("dst"), "dst", "left_semi")
    labels = cores.toDF("id").join(connected_components(between.select("src", "dst")), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    labels = cut(labels)
    border = both.join(cores, "src", "left_anti").join(labels.toDF("dst", "cluster"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("cluster"))
    found = spots.join(labels.unionByName(border), "id").select(*[F.col(c).alias(f"_{c}") for c in ("page", "x", "y")], F.col("_lone").alias("_alone"), "cluster")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("page", "_page"), ("x", "_x"), ("y", "_y"), ("_lone", "_alone"))]
    return placed.join(found, same, "left").select("id", "cluster")
