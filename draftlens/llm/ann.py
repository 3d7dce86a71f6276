"""Approximate nearest neighbours (op 5): cross-polytope hashing with multiprobe tables.

Equal vectors are indexed once, with the least vec_ids that have them, as no others can be among
the k nearest. Each table turns a unit vector twice by fast Hadamard pseudo-rotations (random
signs, transform, three times) and hashes it to the nearest signed axis of each turn; of the second
turn it keeps as many leading coordinates as make a bucket hold about BUCKET vectors, so that the
candidates of a query don't grow with the table. Queries probe, in every table, the PROBES buckets
whose axes are nearest to them. Rows and probes meet in an equi-join on table and bucket, which
carries ids only; candidates are then ranked by their exact cosine in double precision, against
queries that are broadcast in blocks of a bounded size. A query with fewer than k candidates is
compared with all vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlens.llm.shared import cut, drop

TABLES, PROBES, BUCKET = 32, 16, 6
#: Bytes of query vectors in one broadcast; rows that are compared at once.
BLOCK_BYTES, CHUNK = 32 << 20, 2048


class CrossPolytope:
    """Hash tables for unit vectors of one length; `second` signed axes of the second turn make up the bucket."""

    def __init__(self, dim: int, size: int, tables: int = TABLES, seed: int = 7):
        self.width = 1 << max(0, dim - 1).bit_length()
        self.dim, self.tables = dim, tables
        axes = 2 * self.width
        self.second = 2 * min(self.width, max(0, int(np.ceil(size / BUCKET / axes / 2)))) if size > BUCKET * axes else 1
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, self.width))

    def rotate(self, unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : self.dim] = unit
        for s in signs:
            x = x * s
            step = 1
            while step < self.width:
                y = x.reshape(len(x), -1, 2, step)
                x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), -1)
                step *= 2
            x /= np.sqrt(self.width)
        return x

    def _turned(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.rotate(unit, self.signs[table, 0])
        first = np.concatenate((x, -x), 1)
        if self.second == 1:
            return first, np.zeros((len(unit), 1))
        y = self.rotate(unit, self.signs[table, 1])[:, : self.second // 2]
        return first, np.concatenate((y, -y), 1)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each vector (column) in each table (row)."""
        out = []
        for t in range(self.tables):
            first, second = self._turned(unit, t)
            out.append(first.argmax(1) * self.second + second.argmax(1))
        return np.stack(out)

    def probes(self, unit: np.ndarray, count: int) -> np.ndarray:
        """For each table and vector the `count` buckets whose axes it is nearest to, by the loss over the best of each turn."""
        out = []
        for t in range(self.tables):
            first, second = self._turned(unit, t)
            n1, n2 = min(count, first.shape[1]), min(count, second.shape[1])
            i1, i2 = np.argsort(-first, 1)[:, :n1], np.argsort(-second, 1)[:, :n2]
            v1, v2 = np.take_along_axis(first, i1, 1), np.take_along_axis(second, i2, 1)
            loss = (v1[:, :1] - v1)[:, :, None] ** 2 + (v2[:, :1] - v2)[:, None, :] ** 2
            flat = loss.reshape(len(unit), -1)
            best = np.argsort(flat, 1, kind="stable")[:, : min(count, flat.shape[1])]
            bucket = np.take_along_axis(i1, best // n2, 1) * self.second + np.take_along_axis(i2, best % n2, 1)
            out.append(bucket)
        return np.stack(out)


def usable(vector: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _hasher(index: CrossPolytope, probes: int | None):
    """(row, bucket) of vectors (row, v): a bucket per table, or `probes` buckets per table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                unit = _unit(_matrix(rows.column("v"), index.dim))
                codes = index.codes(unit)[:, :, None] if probes is None else index.probes(unit, probes)
                bucket = codes * index.tables + np.arange(index.tables)[:, None, None]
                row = np.broadcast_to(rows.column("row").to_numpy()[None, :, None], bucket.shape)
                yield pa.RecordBatch.from_arrays([pa.array(row.ravel()), pa.array(bucket.ravel().astype(np.int64))], ["row", "bucket"])

    return work


class _Best:
    """The best `k` candidates of each query that a task has seen, by score and then least vec_id."""

    def __init__(self, n: int, k: int):
        self.score, self.row, self.least = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, q: int, score: np.ndarray, row: np.ndarray, least: np.ndarray) -> None:
        good = score >= self.score[q, -1]
        if good.any():
            s, r, i = (np.concatenate((a[q], b[good])) for a, b in ((self.score, score), (self.row, row), (self.least, least)))
            keep = np.lexsort((i, -s))[: self.k]
            self.score[q], self.row[q], self.least[q] = s[keep], r[keep], i[keep]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(self.row[i, j]), pa.array(self.least[i, j]), pa.array(self.score[i, j])], ["q", "row", "least", "score"])


def _ranker(shared, k: int, dim: int):
    """Exact cosines of vectors (row, least, v) with the queries in `qs` (null: with all of the block)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        norms, best = np.sqrt((vectors * vectors).sum(1)), _Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                v = _matrix(rows.column("v"), dim)
                norm, row, least = np.sqrt((v * v).sum(1)), rows.column("row").to_numpy(), rows.column("least").to_numpy()
                if rows.column("qs").null_count == 0:
                    lists = rows.column("qs").to_pylist()
                    q = np.searchsorted(ids, np.fromiter((x for qs in lists for x in qs), np.int64))
                    pair = np.unique(q * len(v) + np.repeat(np.arange(len(v)), [len(qs) for qs in lists]))
                    q, at_row = np.divmod(pair, len(v))
                    cuts = np.flatnonzero(np.diff(q)) + 1
                    groups = zip(q[np.concatenate(([0], cuts))], np.split(at_row, cuts), strict=True) if len(q) else []
                else:
                    groups = ((i, np.arange(len(v))) for i in range(len(ids)))
                for i, r in groups:
                    best.add(i, (v[r] * vectors[i]).sum(1) / (norm[r] * norms[i]), row[r], least[r])
        yield best.rows(ids)

    return work


RANKED = "q long, row long, least long, score double"


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, probes: int) -> DataFrame:
    """query_id, vec_id, score of the k best rows of each query among vectors of one length."""
    spark = rows.sparkSession
    ids = rows.select("vec_id", "v", F.xxhash64("v").alias("h")).dropDuplicates(["vec_id", "h"])
    order = Window.partitionBy("h").orderBy("vec_id")
    # A query's own id takes one place at most among the ids of one vector.
    few = cut(ids.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1).drop("_place"))
    # Vectors go by a number, which is shorter on the way than their hash.
    vectors = cut(few.groupBy("h").agg(F.first("v").alias("v"), F.min("vec_id").alias("least")).withColumn("row", F.monotonically_increasing_id()))
    queries = cut(asked.select("vec_id", F.xxhash64("v").alias("h"), "v").dropDuplicates(["vec_id", "h"]))
    wanted = cut(queries.groupBy("h").agg(F.first("v").alias("v")).withColumn("row", F.monotonically_increasing_id()))
    index = CrossPolytope(dim, vectors.count(), tables)
    at = cut(vectors.select("row", "v").mapInArrow(_hasher(index, None), "row long, bucket long"))

    def ranked(chosen: DataFrame, paired: bool) -> list[DataFrame]:
        """(q, row, score) by blocks of queries, each broadcast for one pass over its candidates."""
        out = []
        blocks = 1 + chosen.count() * dim * 8 // BLOCK_BYTES
        for b in range(blocks):
            mine = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
            block = sorted((r["row"], r["v"]) for r in mine.collect())  # at most about BLOCK_BYTES
            if not block:
                continue
            shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], float)))
            candidates = vectors.select("row", "least", "v", F.lit(None).cast("array<long>").alias("qs"))
            if paired:
                probed = mine.select("row", "v").mapInArrow(_hasher(index, probes), "row long, bucket long").withColumnRenamed("row", "q")
                lists = at.join(probed, "bucket").groupBy("row").agg(F.collect_list("q").alias("qs"))
                candidates = vectors.join(lists, "row").select("row", "least", "v", "qs")
            out.append(cut(candidates.mapInArrow(_ranker(shared, k + 1, dim), RANKED)))
        return out

    none = spark.createDataFrame([], RANKED)
    found = none
    for part in ranked(wanted, True):
        found = found.unionByName(part)
    # With k + 1 vectors there are k other rows whatever the query's own id; a query with fewer is compared with all.
    full = found.groupBy("q").agg(F.countDistinct("row").alias("n")).where(F.col("n") > k)
    short = cut(wanted.join(full.select(F.col("q").alias("row")), "row", "left_anti"))
    for part in ranked(short, False):
        found = found.unionByName(part)
    drop(at, short)
    # Each task gave its best; only the best of all go on to the ids.
    once = found.groupBy("q", "row").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    found = once.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k + 1).select("q", "row", "score")
    named = queries.select(F.col("vec_id").alias("query_id"), "h").join(wanted.select("h", F.col("row").alias("q")), "h").drop("h")
    near = few.select("vec_id", "h").join(vectors.select("h", "row"), "h").drop("h")
    best = named.join(found, "q").join(near, "row")
    return best.where("vec_id <> query_id").select("query_id", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, ties to smaller vec_id.

    Both sides have vec_id and embedding. Vectors that `usable` rejects and rows with a null vec_id
    take no part; vectors of a length that differs from the query's aren't its candidates. Rows
    that repeat a vec_id with the same vector count once, with other vectors each; a query_id with
    several vectors has the nearest rows to any of them, each row once with its best score.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows, asked = plain(vectors), plain(queries)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect()):  # a handful of lengths
        same = F.size("v") == dim
        found = found.unionByName(_search(rows.where(same), asked.where(same), dim, k, tables, probes))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
