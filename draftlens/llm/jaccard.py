"""N-gram Jaccard join (op 10) with adaptive multi-match prefixes.

Words are runs without ASCII white space, A-Z lower-cased; a set holds 64-bit hashes of distinct
5-word shingles. Equal sets are one node, named by the set's own hash. Shingles are ordered from
rare to common by a frequency sketch over all documents, of fixed size; the order decides the cost
only, not the result. A partner of at least the same size shares at least t = ceil(160 n / 180)
shingles with a set of n (at 80 %), one of at most that size ceil(0.8 n). So a set is found by its
first n - t + l shingles and looks with its first n - ceil(0.8 n) + l; two sets can only link if
those share min(l, l') of them. l grows, set by set, while that lowers the estimated cost.

Candidates are verified exactly: a bitmap of each set's hashes bounds what a pair can share, and
pairs that may share enough have their whole sets compared. First each set meets one likely
partner at a time, that with the most shared shingles among those it could meet, which joins groups
of near copies with work linear in their size; then every candidate pair whose ends aren't yet
connected is verified, so no link between components is lost and no group is expanded.

Null texts and texts without words have an empty set and link with nothing. Rows that repeat a
doc_id with different texts each count; the result has a row per input row. A row with a null
doc_id takes part in links; a component of such rows alone has a null component_id. Only doc_id
and text are read, so further columns can't clash. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlens.llm.shared import connected_components, cut, drop

BITS, BLOCK, MAX_MATCH, STAR_ROUNDS, MEMO_ENTRIES = 20, 4096, 4, 3, 1_000_000
#: A token with more rows than this is split over several tasks when pairs are formed.
SPLIT = 1000
#: Longs of the short bitmap that goes with every row of a token.
SHORT = 16
#: Text hashes of so many sets at most go to every task; more are joined by a shuffle.
FEW_SETS = 2_000_000
SHORTS = [f"b{i}" for i in range(SHORT)]
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    def __init__(self, width: int = 5):
        self.width, self.memo = width, _WordHashes()

    def _mixed(self, h: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _FACTORS[i] + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _FACTORS[0]
        return (out ^ (out >> np.uint64(29))).view(np.int64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each whole text, as int64."""
        words = [(t or "").encode().lower().split() for t in texts]
        h = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words)))
        rolled = self._mixed(h, self.width) if len(h) >= self.width else h.view(np.int64)
        out, at = [], 0
        for w in words:
            n = len(w)
            if n >= self.width:
                out.append(np.unique(rolled[at : at + n - self.width + 1]))
            else:
                out.append(self._mixed(h[at : at + n], n) if n else np.empty(0, np.int64))
            at += n
        return out


def name_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def _parts(texts: pa.Array, rows: int = 1000) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), rows):
        yield texts[at : at + rows].to_pylist()


PROFILE = "doc_id long, h long, n long, name long, block int, counts binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and, per task, the sketch's counts in blocks (block is not null)."""
    shingler, sketch, schema = Shingler(), np.zeros(1 << BITS, np.uint32), None
    for batch in batches:
        n, names = [], []
        for texts in _parts(batch.column("text")):
            sets = shingler.sets(texts)
            n += map(len, sets)
            names += map(name_of, sets)
            sketch += np.bincount(_bucket(np.concatenate(sets)), minlength=1 << BITS).astype(np.uint32)
        k = len(n)
        out = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "h", "n", "name", "block", "counts"])
        schema = out.schema
        yield out
    if schema is not None:
        blocks = [(b, c) for b, c in enumerate(sketch.reshape(-1, BLOCK)) if c.any()]
        k = len(blocks)
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([b for b, _ in blocks], pa.int32()), pa.array([c.tobytes() for _, c in blocks], pa.binary())], schema=schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[b] = total.get(b, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes() for c in total.values()], pa.binary())], ["block", "counts"])


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The merged sketch: one number for each of 2^BITS hash ranges, 4 MB whatever the corpus."""
    out = np.zeros(1 << BITS, np.uint32)
    merged = rows.where("block is not null").select("block", "counts").repartition(32, "block").mapInArrow(_summed, "block int, counts binary")
    for r in merged.toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return out - np.minimum(out, np.uint32(np.median(out)))


def prefix(shingles: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The adaptive prefix of a set, rare shingles first, and the number of matches it asks for."""
    n = len(shingles)
    need = -(-percent * n // 100)
    freq = sketch[_bucket(shingles)]
    order = np.argsort(freq, kind="stable")[: n - need + MAX_MATCH]
    cost = np.cumsum(freq[order], dtype=np.int64)
    # By Markov's inequality at most cost / l sets share l of the prefix's shingles.
    best = 1
    if cost[n - need] > 4 * n:
        best = min(range(1, min(MAX_MATCH, need) + 1), key=lambda m: (cost[n - need + m - 1] + 2 * m) / m)
    return shingles[order[: n - need + best]], best


TOKENS = "token long, name long, n int, m byte, pos int, found boolean"


def _prefixes(sketch, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, counts = Shingler(), set(), sketch.value
        for batch in batches:
            for texts in _parts(batch.column("text")):
                tokens, names, ns, matches = [np.empty(0, np.int64)], [], [], []
                for s in shingler.sets(texts):
                    if not len(s) or (name := name_of(s)) in seen:
                        continue
                    seen.add(name)
                    p, m = prefix(s, counts, percent)
                    tokens.append(p), names.append(name), ns.append(len(s)), matches.append(m)
                size = np.array([len(t) for t in tokens[1:]], np.int64)
                n, m = np.repeat(np.array(ns, np.int64), size), np.repeat(np.array(matches, np.int64), size)
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found = pos < n - -(-2 * percent * n // (100 + percent)) + m
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(names, np.int64), size)), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int8)), pa.array(pos.astype(np.int32)), pa.array(found)],
                    ["token", "name", "n", "m", "pos", "found"],
                )

    return work


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits that a set's hashes hit, eight or more per shingle up to 2^16; whole bytes, a power of two of them."""
    size = min(1 << 16, max(64 * SHORT, 1 << (8 * len(shingles) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(shingles.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_shared(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> int:
    """An upper bound of what two sets share: each bit that only one has stands for a shingle of its own."""
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    return min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for texts in _parts(batch.column("text")):
            sets = shingler.sets(texts)
            bits = [bitmap(s) for s in sets]
            short = np.array([folded(b, 8 * SHORT).view(np.int64) for b in bits], np.int64).reshape(-1, SHORT)
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary()), *[pa.array(short[:, i]) for i in range(SHORT)]], ["name", "bits", *SHORTS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for texts in _parts(batch.column("text"), 500):
            sets = shingler.sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "s"])


def _possible(percent: int):
    """The pairs whose bitmaps leave room for a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ba, bb = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(c)] for c in ("ba", "bb"))
            na, nb = (batch.column(c).to_pylist() for c in ("na", "nb"))
            keep = [(100 + percent) * most_shared(x, n, y, k) >= percent * (n + k) for x, n, y, k in zip(ba, na, bb, nb, strict=True)]
            yield batch.select(["a", "b", "src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return work


def _verifier(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return work


PAIR = ["a", "b", "na", "nb", "src", "dst"]


def classes(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, h, n_shingles, name; h is the text's hash, name its set's) and the linked sets (name, component)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(texts.withColumn("h", F.xxhash64("text")).mapInArrow(_profile, PROFILE))
    profile = rows.where("block is null").select("doc_id", "h", F.col("n").alias("n_shingles"), "name")
    sketch = spark.sparkContext.broadcast(sketch_of(rows))

    # Tokens of two sets or more, one of which can be found by them; each set once per token.
    tokens = texts.select("text").mapInArrow(_prefixes(sketch, percent), TOKENS)
    by = Window.partitionBy("token")
    once = tokens.withColumn("_before", F.lag("name").over(by.orderBy("name"))).where("_before is null or _before <> name").drop("_before")
    shared = once.withColumn("_sets", F.count("*").over(by)).withColumn("_any", F.max("found").over(by))
    tokens = cut(shared.where("_sets > 1 and _any").drop("_sets", "_any"))

    # One text of each set that has a shared token, by its hash: equal texts have equal sets.
    met = tokens.groupBy("name").agg(F.count("*").alias("degree"))
    chosen = cut(profile.join(met, "name").groupBy("name").agg(F.min("h").alias("h"), F.first("degree").alias("degree")))

    def made(names: DataFrame, make, schema: str) -> DataFrame:
        """What `make` works out from one text of each of the names."""
        hashes = names.select("h")
        hashes = F.broadcast(hashes) if names.count() <= FEW_SETS else hashes
        wanted = texts.select("text", F.xxhash64("text").alias("h")).join(hashes, "h", "left_semi").select("text")
        out = wanted.mapInArrow(make, schema)
        return cut(out.groupBy("name").agg(*[F.first(c).alias(c) for c in out.columns if c != "name"]))

    bits = made(chosen, _bitmaps, "name long, bits binary, " + ", ".join(f"{b} long" for b in SHORTS))
    common = cut(tokens.join(chosen.select("name", "degree"), "name"))
    drop(tokens)

    def verified(pairs: DataFrame) -> DataFrame:
        """The components (src, dst) that the links among the pairs (a, b) join."""
        pairs = cut(pairs.select(*PAIR))
        both = pairs.join(bits.select(F.col("name").alias("a"), F.col("bits").alias("ba")), "a").join(bits.select(F.col("name").alias("b"), F.col("bits").alias("bb")), "b")
        close = cut(both.mapInArrow(_possible(percent), "a long, b long, src long, dst long"))
        drop(pairs)
        names = close.select(F.col("a").alias("name")).union(close.select("b")).distinct()
        need = cut(chosen.join(names, "name", "left_semi").select("h"))
        sets = made(need, _sets, "name long, s binary")
        both = close.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("src", "dst", "sa", "sb")
        out = cut(both.mapInArrow(_verifier(percent), "src long, dst long").distinct())
        drop(close, need, sets)
        return out

    def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """Names in new components; names that have none yet are their own."""
        parts = connected_components(links)
        if labels is None:
            return cut(parts.toDF("name", "component"))
        moved = labels.join(parts.toDF("component", "into"), "component", "left").select("name", F.coalesce("into", "component").alias("component"))
        fresh = parts.toDF("name", "component").join(labels, "name", "left_anti")
        return cut(moved.unionByName(fresh.select("name", "component")))

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return common.withColumn("component", F.col("name"))
        return common.join(labels, "name", "left").withColumn("component", F.coalesce("component", "name"))

    def room(x: str, y: str) -> str:
        """Sizes and places of two rows of a token leave room for a link."""
        need = f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent})"
        return f"""{x}.component <> {y}.component and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)
            and {x}.pos <= {x}.n - {need} + least({x}.m, {y}.m) - 1 and {y}.pos <= {y}.n - {need} + least({x}.m, {y}.m) - 1
            and least({x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need}"""

    def bits_leave_room(x: str, y: str) -> str:
        need = f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent})"
        own = lambda p, q: " + ".join(f"bit_count({p}.{b} & ~{q}.{b})" for b in SHORTS)
        return f"{x}.n - ({own(x, y)}) >= {need} and {y}.n - ({own(y, x)}) >= {need}"

    # What the pair shares beyond its last common place in either order can't be more than what follows there.
    last = f"""c + least(na - pa, nb - pb) - 1 >= ceil({percent} * (na + nb) / {100 + percent}) and c >= m"""
    columns = ["name", "n", "m", "pos", "component"]
    labels = None
    for turn in range(STAR_ROUNDS):
        # The set that most others could meet first; later any, so that other centres have their turn.
        rank = [F.desc("degree"), F.xxhash64("name")] if turn == 0 else [F.xxhash64("name", F.lit(turn)), F.col("name")]
        star = labelled(labels).select("token", F.struct(*columns).alias("x"), F.first(F.struct(*columns)).over(by.orderBy(*rank)).alias("y")).where(room("x", "y"))
        star = star.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.component").alias("src"), F.col("y.component").alias("dst"))
        star = star.agg(F.count("*").alias("c"), F.max("x.pos").alias("pa"), F.max("y.pos").alias("pb"), F.first(F.least("x.m", "y.m")).alias("m")).where(last)
        star = star.groupBy("a").agg(F.max_by(F.struct(*PAIR[1:]), F.struct("c", "b")).alias("best")).select("a", "best.*")
        new = verified(star)
        if new.isEmpty():
            drop(new)
            break
        old, labels = labels, merged(labels, new)
        drop(new, *([old] if old is not None else []))

    # Every pair of sets in different components that shares enough of the shingles both could meet by.
    at = labelled(labels).withColumn("_lo", F.min("component").over(by)).withColumn("_hi", F.max("component").over(by)).withColumn("_rows", F.count("*").over(by))
    at = cut(at.where("_lo <> _hi").select("token", "found", "_rows", *columns).join(bits.drop("bits"), "name"))
    parts = F.ceil(F.col("_rows") / SPLIT)
    x = at.where("found").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).alias("x")
    y = at.withColumn("part", F.pmod(F.xxhash64("name"), parts)).alias("y")
    rest = x.join(y, F.expr("x.token = y.token and x.part = y.part and (x.n < y.n or x.n = y.n and x.name < y.name) and " + room("x", "y") + " and " + bits_leave_room("x", "y")))
    rest = rest.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.component").alias("src"), F.col("y.component").alias("dst"))
    rest = rest.agg(F.count("*").alias("c"), F.max("x.pos").alias("pa"), F.max("y.pos").alias("pb"), F.first(F.expr("least(x.m, y.m)")).alias("m")).where(last)
    new = verified(rest)
    old, labels = labels, merged(labels, new)
    drop(new, at, common, chosen, bits, *([old] if old is not None else []))
    return profile, labels


def join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    profile, labels = classes(docs, percent)
    # A name's smallest doc_id, then its component's, for the sets that have links.
    least_id = profile.groupBy("name").agg(F.min("doc_id").alias("least"))
    linked = least_id.join(labels, "name", "left").withColumn("component", F.coalesce("component", "name"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(linked.join(smallest, "component").select("name", "component_id"))
    drop(labels)
    out = profile.where("n_shingles > 0").join(named, "name").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(profile.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with one row of each linked group: that with the smallest doc_id, a null one last, then the smallest text hash.

    Rows that agree in doc_id and text are one row, unless they have no words; those link with
    nothing and all stay.
    """
    profile, labels = classes(docs, percent)
    rows = profile.where("n_shingles > 0").join(labels, "name", "left").select("doc_id", "h", F.coalesce("component", "name").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    best = rows.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("n")).where("n > 1")
    met = cut(rows.join(best, "component").select("doc_id", "h", (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.h") == F.col("h"))).alias("stays")))
    drop(labels)
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"))
    same = F.struct(F.coalesce("doc_id", F.lit(0).cast("long")).alias("i"), F.col("doc_id").isNull().alias("no_id"), "h")
    gone = met.where("not stays").select(same.alias("_key")).distinct()
    again = met.where("stays").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(same.alias("_key"))
    keyed = docs.withColumn("_key", key).join(gone, "_key", "left_anti")
    once = keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"])
    return keyed.join(again, "_key", "left_anti").unionByName(once).select(*docs.columns)
