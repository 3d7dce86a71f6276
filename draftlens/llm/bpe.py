"""Byte-level BPE: token counts (op 1) and encoding with decoding (op 9).

Texts are split by a public pattern, and each distinct piece is worked out once per process and
remembered in a table of bounded size. Null texts count as empty; empty texts have no tokens.
Repeated rows give repeated results, and only the id and text columns are read, so further columns
can't clash. Texts are processed whole.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 400_000


def merge(symbols: list, rank) -> int:
    """Merge the lowest-ranked adjacent pair (leftmost on ties) in place until none is left; the number of merges.

    `symbols` are byte strings (or strings) joined by concatenation, merged-away places become
    None; `rank(a, b)` gives the pair's rank or None. A heap orders pairs and linked neighbours
    make each merge O(log n).
    """
    n, merges = len(symbols), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else n
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = left + right, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank(symbols[i], symbols[k])) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := rank(symbols[h], symbols[i])) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return merges


def compile_pattern(pattern: str) -> regex.Pattern:
    """White space as Unicode defines it, which is what the reference tokenizers use."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Memo(dict):
    """Remembers results by piece and starts afresh when it holds MEMO_ENTRIES."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = value = self.make(key)
        return value


@cache
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in .json vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counting:
    """Counts tokens for a byte-level .json vocabulary."""

    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.letters, self.pattern = _byte_letters(), compile_pattern(pattern)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.memo = Memo(self.piece)

    def piece(self, piece: str) -> int:
        symbols = [self.letters[b] for b in piece.encode()]
        return len(symbols) - merge(symbols, lambda a, b: self.rank.get((a, b)))

    def count(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            for piece, n in Counter(self.pattern.findall(part)).items():
                total += self.memo[piece] * n
        return total


class PerfectHash:
    """Minimal perfect hash by hash and displace: a seed per bucket sends its keys to free slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in keys:
            groups[xxhash.xxh64_intdigest(key) % self.buckets].append(key)
        self.seeds, self.slots = [0] * self.buckets, [None] * n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # a direct slot, marked by a negative seed
                free = free if free is not None else iter([i for i, s in enumerate(self.slots) if s is None])
                slot = next(free)
                self.seeds[b], self.slots[slot] = -slot - 1, group[0]
                continue
            seed = 1
            while True:
                at = {xxhash.xxh64_intdigest(key, seed) % n for key in group}
                if len(at) == len(group) and all(self.slots[a] is None for a in at):
                    break
                seed += 1
            self.seeds[b] = seed
            for key in group:
                self.slots[xxhash.xxh64_intdigest(key, seed) % n] = key

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 when it isn't one of the keys."""
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        at = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return at if self.slots[at] == key else -1


class Codec:
    """Encodes and decodes with a .tiktoken rank file."""

    def __init__(self, path: str, pattern: str):
        rows = [line.split() for line in open(path, "rb") if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.hash = PerfectHash(list(self.ranks))
        self.ids = [self.ranks[key] for key in self.hash.slots]
        self.bytes = {i: key for key, i in self.ranks.items()}
        self.pattern, self.memo = compile_pattern(pattern), Memo(self.piece)

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        slot = self.hash.slot(raw)
        if slot >= 0:
            ids = [self.ids[slot]]
        else:
            symbols = [raw[i : i + 1] for i in range(len(raw))]
            merge(symbols, lambda a, b: self.ranks.get(a + b))
            ids = [self.ranks[s] for s in symbols if s is not None]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def counting(path: str, pattern: str) -> Counting:
    return Counting(path, pattern)


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text (null: empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counting(path, pattern).count
        for batch in batches:
            tokens = pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns `keep`, ids (binary, little-endian unsigned 32-bit) of every whole text, and its decoded bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                ids = [c.encode(t) for t in rows.column("_text").to_pylist()]
                columns = {n: rows.column(n) for n in rows.schema.names if n != "_text"}
                yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([c.decode(i) for i in ids], pa.binary())})

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(work, f"{kinds}, ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, derived from `encode`."""
    return encode(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
