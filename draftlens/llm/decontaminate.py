"""Benchmark decontamination (op 3): CGK embedding and bit-sampling LSH over item-sized windows.

Symbols are words: runs of letters and digits, lower-cased. Items fall into classes by length, one
for each length up to EACH words and then of a constant ratio; a class looks at every window of its
own size in the documents, whatever the offset. A random walk embeds a window, which turns edit
distance into Hamming distance, and a few sampled embedded symbols are a key; items and windows
that share a key in some repetition are candidates. The number of repetitions of a class is what
its own items, edited as much as is allowed, need for TARGET recall. Candidates are verified by the
exact word edit distance of the whole item to the best stretch of the document: an item is found
when that is at most `1 - similarity` of its words. A verbatim copy always shares all keys.

Windows that can't hold an item are left out before they are embedded, by two exact conditions:
with at most k edits, a window of w words has at least w - k words that items of its class have,
and at least w - 1 - 2 k pairs of neighbours that they have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EACH, RATIO, TARGET, MOST_REPEATS = 16, 1.1, 0.97, 96
#: Items are indexed in blocks of about so many bytes of text, each one pass over the documents.
BLOCK_BYTES = 16 << 20
CELLS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
FOUND = "array<struct<item_id:bigint,distance:bigint,position:bigint>>"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def fit(items: np.ndarray, lengths: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each item (row, of its length) to the best stretch in its row of `stretches`, and where that begins.

    Of equally good stretches the one that begins last counts. Worked backwards, so that the end
    of an alignment is its beginning in the text; all rows advance together.
    """
    m, t = stretches.shape
    back, at = stretches[:, ::-1], np.arange(t + 1)
    row = np.zeros((m, t + 1), np.int64)
    for i in range(items.shape[1]):
        symbol = items[np.arange(m), np.maximum(lengths - 1 - i, 0)]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (back != symbol[:, None]))
        new = np.minimum.accumulate(new - at, 1) + at
        row = np.where((i < lengths)[:, None], new, row)
    best = row.argmin(1)
    return row[np.arange(m), best], t - best


class SizeClass:
    """The items whose windows have `width` words."""

    def __init__(self, width: int, owners: np.ndarray, items: np.ndarray, lengths: np.ndarray, allowed: np.ndarray, index: Index, rng: np.random.Generator):
        self.width, self.owners, self.items, self.lengths, self.allowed = width, owners, items, lengths, allowed
        self.edits = int(allowed.max())
        self.least_words, self.least_pairs = width - self.edits, width - 1 - 2 * self.edits
        grid = index.codes[items[:, :width]]
        for sampled in range(min(width, 2 + int(np.log(len(items)) / np.log(50))), 0, -1):
            self._draw(sampled, rng)
            if self.edits == 0:  # only verbatim copies, which share every key
                self.repeats = 1
                break
            missed = self._misses(index, rng)
            if len(enough := np.flatnonzero(missed <= (1 - TARGET) + 1e-9)):
                self.repeats = int(enough[0]) + 1
                break
        else:
            self.repeats = MOST_REPEATS
        flat, at = np.concatenate((grid.ravel(), [index.pad])), np.arange(len(grid)) * width
        self.keys = []
        for r in range(self.repeats):
            key = self.embed(flat, at, r, index.pad)
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], order))

    def _draw(self, sampled: int, rng: np.random.Generator) -> None:
        steps = max(sampled, int(1.6 * self.width))
        edges = np.linspace(0, steps, sampled + 1).astype(int)
        self.samples = np.stack([rng.integers(edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)) for _ in range(MOST_REPEATS)])
        self.turns = rng.integers(0, 2**63, (MOST_REPEATS, steps + 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.mixes = rng.integers(0, 2**63, (MOST_REPEATS, sampled)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def _misses(self, index: Index, rng: np.random.Generator) -> np.ndarray:
        """The share of edited items not found by the first 1, 2, ... repetitions."""
        picked = rng.integers(0, len(self.items), 300)
        rows = []
        for p in picked:
            item = list(self.items[p, : self.lengths[p]])
            for _ in range(self.allowed[p]):
                at, kind = int(rng.integers(0, len(item))), int(rng.integers(0, 3))
                item[at : at + (kind != 1)] = [0] * (kind != 2)
                item = item or [0]
            rows.append((item + [0] * self.width)[: self.width])
        flat = np.concatenate((index.codes[np.array(rows)].ravel(), [index.pad]))
        plain = np.concatenate((index.codes[self.items[picked, : self.width]].ravel(), [index.pad]))
        at = np.arange(len(picked)) * self.width
        hit = np.stack([self.embed(flat, at, r, index.pad) == self.embed(plain, at, r, index.pad) for r in range(MOST_REPEATS)])
        return 1 - np.logical_or.accumulate(hit, 0).mean(1)

    def embed(self, flat: np.ndarray, at: np.ndarray, r: int, pad: np.uint64) -> np.ndarray:
        """The keys, in repetition r, of the windows that begin at `at` in the codes `flat`."""
        pos, key, taken = at.copy(), np.zeros(len(at), np.uint64), 0
        end = at + self.width
        samples = self.samples[r]
        for j in range(int(samples[-1]) + 1):
            code = flat[np.minimum(pos, len(flat) - 1)]
            if j >= self.width:
                code = np.where(pos < end, code, pad)
            while taken < len(samples) and samples[taken] == j:
                key = (key ^ (key >> np.uint64(29))) * self.mixes[r, taken] + code
                taken += 1
            pos += ((code * self.turns[r, j]) >> np.uint64(63)).astype(np.int64)
        return key


class Index:
    """Items by class; symbol 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, seed: int = 11):
        self.vocab: dict[str, int] = {}
        rng = np.random.default_rng(seed)
        rows = []
        for item_id, text in sorted(items, key=lambda r: (r[0], r[1])):
            symbols = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if symbols:
                rows.append((item_id, symbols, int(len(symbols) * (1 - similarity) + 1e-9)))
        codes = rng.integers(1, 2**63, len(self.vocab) + 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.codes, self.pad = codes[:-1], codes[-1]
        self.ids = np.array([r[0] for r in rows], np.int64)
        pairs = sum(len(r[1]) for r in rows)
        self.pair_bits = np.uint64(min(26, max(12, (32 * pairs).bit_length())))
        self.pairs = np.zeros(1 << int(self.pair_bits), bool)
        groups: dict[int, list[int]] = {}
        for k, (_, symbols, _) in enumerate(rows):
            self.pairs[self._pair(self.codes[np.array(symbols)])] = True
            n = len(symbols)
            width = n if n <= EACH else int(EACH * RATIO ** np.floor(np.log(n / EACH) / np.log(RATIO) + 1e-9))
            groups.setdefault(width, []).append(k)
        self.classes = []
        for width, own in sorted(groups.items()):
            lengths = np.array([len(rows[k][1]) for k in own])
            grid = np.full((len(own), lengths.max()), -1, np.int64)
            for i, k in enumerate(own):
                grid[i, : lengths[i]] = rows[k][1]
            self.classes.append(SizeClass(width, np.array(own), grid, lengths, np.array([rows[k][2] for k in own]), self, rng))

    def _pair(self, codes: np.ndarray) -> np.ndarray:
        return ((codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:] >> np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)) >> (np.uint64(64) - self.pair_bits)

    def find(self, docs: list[list[int]]) -> list[tuple[int, int, int, int]]:
        """(document, item id, distance, position) of every item found; documents are symbol lists."""
        sizes = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, int(sizes.sum())
        if not n or not self.classes:
            return []
        longest = max(c.width for c in self.classes)
        ids = np.zeros(n + longest, np.int32)
        ids[:n] = np.fromiter((s for d in docs for s in d), np.int32, n)
        flat = self.codes[ids]
        is_word = ids > 0
        is_pair = self.pairs[self._pair(flat)] & is_word[:-1] & is_word[1:]
        n_words = np.concatenate(([0], np.cumsum(is_word, dtype=np.int32)))
        n_pairs = np.concatenate(([0], np.cumsum(is_pair, dtype=np.int32)))
        out = []
        for c in self.classes:
            w = c.width
            may = n_words[w : n + w] - n_words[:n] >= c.least_words
            if c.least_pairs > 0:
                may &= n_pairs[w - 1 : n + w - 1] - n_pairs[:n] >= c.least_pairs
            at = np.flatnonzero(may)
            for part in range(0, len(at), 500_000):
                out += self._matches(c, at[part : part + 500_000], flat, ids, starts, ends)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, k, distance, begin in out:
            best[d, k] = min(best.get((d, k), (1 << 30, 0)), (distance, begin))
        return [(d, int(self.ids[k]), distance, begin) for (d, k), (distance, begin) in sorted(best.items())]

    def _matches(self, c: SizeClass, at: np.ndarray, flat: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Verified (document, item, distance, position) of one class's windows at `at`."""
        seen = np.empty(0, np.int64)
        for r in range(c.repeats if len(at) else 0):
            keys, order = c.keys[r]
            key = c.embed(flat, at, r, self.pad)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(high > low)
            for some in np.array_split(hit, 1 + int((high[hit] - low[hit]).sum()) // CELLS):
                many = high[some] - low[some]
                win = order[np.repeat(low[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                seen = np.union1d(seen, win * len(flat) + np.repeat(at[some], many))
        if not len(seen):
            return []
        own, pos = np.divmod(seen, len(flat))
        doc = np.searchsorted(ends, pos, "right")
        # Of starts of one item that lie within its edits, the first stands for all.
        keep, last = np.zeros(len(own), bool), (-1, -1, -1)
        for i, (o, d, p) in enumerate(zip(own.tolist(), doc.tolist(), pos.tolist(), strict=True)):
            if (o, d) != last[:2] or p - last[2] > c.allowed[o]:
                keep[i], last = True, (o, d, p)
        own, doc, pos = own[keep], doc[keep], pos[keep]
        out, span = [], c.items.shape[1] + 4 * c.edits
        for part in range(0, len(own), max(1, CELLS // span)):
            o, d, p = (x[part : part + max(1, CELLS // span)] for x in (own, doc, pos))
            begin = p - 2 * c.edits
            where = begin[:, None] + np.arange(span)
            inside = (where >= starts[d][:, None]) & (where < ends[d][:, None])
            stretch = np.where(inside, ids[np.clip(where, 0, len(ids) - 1)], -2)
            items, lengths, allowed = c.items[o], c.lengths[o], c.allowed[o]
            # Exact: all but the edited words of an item are in the stretch.
            row = np.arange(len(o))[:, None] * (len(self.codes) + 4) + 3
            there = (np.isin(items + row, stretch + row) & (items > 0)).sum(1) >= lengths - allowed
            o, d, begin, stretch, items, lengths, allowed = o[there], d[there], begin[there], stretch[there], items[there], lengths[there], allowed[there]
            if len(o):
                distance, first = fit(items, lengths, stretch)
                good = distance <= allowed
                place = np.maximum(begin + first - starts[d], 0)
                out += zip(d[good].tolist(), c.owners[o[good]].tolist(), distance[good].tolist(), place[good].tolist(), strict=True)
        return out


def _finder(shared, text: str, keep: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        symbol = index.vocab.get
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                got = index.find([[symbol(w, 0) for w in words(t)] for t in rows.column(text).to_pylist()])
                counts = np.bincount([g[0] for g in got], minlength=rows.num_rows) if got else np.zeros(rows.num_rows, int)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                values = pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (1, 2, 3)], ["item_id", "distance", "position"])
                yield pa.RecordBatch.from_pydict({n: rows.column(n) for n in keep} | {"_new": pa.ListArray.from_arrays(offsets, values)})

    return work


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], similarity: float = 0.8) -> DataFrame:
    """The columns `keep` of every document, and `found`: item_id, distance, position of each benchmark item in its whole text.

    Null and empty texts hold nothing; empty items and items with a null id are never found;
    repeated documents repeat, repeated items count once. `position` is the word at which the best
    stretch begins (of equally good ones found, the smallest). The benchmark is indexed in blocks
    of a bounded size, broadcast one at a time, each for one pass over the documents.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    text = "text" if "text" in keep else "_text"
    out = docs.select(*keep, *([] if text in keep else [F.col("text").alias(text)]), F.array().cast(FOUND).alias("found"))
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Index(block, similarity))
        on = [*keep, "found", *([] if text in keep or b + 1 == blocks else [text])]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in on)
        rows = out.mapInArrow(_finder(shared, text, [f.name for f in out.schema if f.name in on]), f"{kinds}, _new {FOUND}")
        out = rows.select(*[n for n in on if n != "found"], F.concat("found", "_new").alias("found"))
    return out.select(*keep, "found")


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, distance, position: every benchmark item found in a document's whole text, as `search` tells."""
    return search(docs, benchmark, ["doc_id"], similarity).select("doc_id", F.inline("found"))
