"""Toxicity (op 7): maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens are runs of letters, lower-cased, and word beginnings of a few lengths. A token's log-odds
in toxic against clean texts have a Dirichlet prior that follows the corpus's own frequencies, and
are taken SIGMAS standard errors nearer to zero. A word scores the log-odds of its most telling
token, less STEP, the odds a passage must have on average. One linear scan finds all maximal
segments of a text. By chance K * m * exp(-lambda * S) segments reach S in m words: lambda is the
Karlin-Altschul root over the words of clean texts, K fits the extreme-value law to their best
segments. The significant segments add up, and a logistic curve turns the sum into a score.

Null and empty texts get the curve's value without segments. Repeated rows and ids repeat; only
doc_id, text and the columns asked for are read, so others can't clash; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.llm.shared import cut, drop

WORD = r"\p{L}+"
#: About so many labelled documents are learnt from, those whose ids hash lowest; this bounds the tokens known, too.
TRAIN_ROWS = 50_000
#: The prior weighs as much as this share of the counts; standard errors; least mean odds of a passage.
PRIOR, SIGMAS, STEP = 0.1, 2.0, math.log(2)
BEGINNINGS, MEMO_ENTRIES = range(4, 9), 500_000
BIN = 0.05
_WORD = regex.compile(WORD)
SEGMENTS = "array<struct<first:bigint,last:bigint,odds:double>>"


@dataclass
class Model:
    odds: dict[str, float]
    rate: float = 1.0  # lambda
    start: float = 1.0  # K
    slope: float = 0.0
    offset: float = 0.0
    scores: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self.scores = _WordScores(self.odds)

    def __reduce__(self):
        return Model, (self.odds, self.rate, self.start, self.slope, self.offset)


class _WordScores(dict):
    """Remembers each word's score, starting afresh at MEMO_ENTRIES words."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        known = [self.odds.get(t, 0.0) for t in (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k))]
        self[word] = score = max(known, key=abs) - STEP
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in one pass; each holds a positive score.

    Ties leave the shorter, earlier segment.
    """
    through = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    stack: list[list] = []  # first, last, sum before, sum through, nearest earlier one that starts lower
    for i, s, t in zip(at.tolist(), scores[at].tolist(), through[at].tolist(), strict=True):
        new = [i, i, t - s, t]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, t - before) for a, b, before, t, _ in stack]


def scores_of(text: str | None, model: Model) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(model.scores.__getitem__, words), float, len(words))


def significance(n_words: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """The sum of the significances of a text's segments; without any, what none is worth at that length."""
    cost = math.log1p(model.start * n_words)
    each = [model.rate * s - cost for _, _, s in found] or [-cost]
    best = max(each)
    return best + sum(x for x in each if x > 0) - max(best, 0.0)


def tokens_of(text: Column) -> Column:
    """The distinct tokens of a text: its words, and the beginnings of longer words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))

    def begun(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(begun, BEGINNINGS)))


def _profiled(shared):
    """Per text its label, words and segments' scores; per task and bin of clean words' scores, a row without label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bins = shared.value, {}
        names = ["toxic", "m", "s"]
        kind = pa.schema([("toxic", pa.int32()), ("m", pa.int64()), ("s", pa.list_(pa.float64()))])
        for batch in batches:
            toxic, m, s = batch.column("toxic").to_pylist(), [], []
            for label, text in zip(toxic, batch.column("text").to_pylist(), strict=True):
                scores = scores_of(text, model)
                m.append(len(scores))
                s.append([x[2] for x in segments(scores)])
                if not label:
                    for b, n in zip(*np.unique(np.round(scores / BIN).astype(np.int64), return_counts=True), strict=True):
                        bins[int(b)] = bins.get(int(b), 0) + int(n)
            yield pa.RecordBatch.from_pydict(dict(zip(names, (toxic, m, s), strict=True)), schema=kind)
        yield pa.RecordBatch.from_pydict({"toxic": [None] * len(bins), "m": list(bins), "s": [[float(n)] for n in bins.values()]}, schema=kind)

    return work


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * scores)) = 1; the mean score is negative."""
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (share * np.exp(np.minimum(700.0, mid * scores))).sum() > 1 else (mid, high)
    return high


def _constant(share: float) -> Model:
    share = min(1 - 1e-6, max(1e-6, share))
    return Model({}, offset=math.log(share / (1 - share)))


def train_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """toxic and text of about `rows` labelled documents whose crc32(doc_id) mod 5 isn't 0, each text once.

    A doc_id labelled more than once, or a text under several ids, is toxic if any label says so.
    """
    known = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = rows / max(rows, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(known), "doc_id")  # about `rows` labels
    return texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).drop("h")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from `train_rows`; `labels` has doc_id and toxic.

    Without both kinds of text the model knows no tokens and scores the share of toxic labels.
    """
    spark = docs.sparkSession
    train = cut(train_rows(docs, labels, rows))
    counts = cut(train.select("toxic", F.explode(tokens_of(F.col("text"))).alias("w")).groupBy("w").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.count("*").alias("n")))
    texts = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not texts["toxic"] or texts["toxic"] == texts["n"]:
        drop(train, counts)
        return _constant((texts["toxic"] or 0) / texts["n"] if texts["n"] else 0.0)
    total = counts.agg(F.sum("a").alias("a"), F.sum("n").alias("n")).first()
    if not total["a"] or total["a"] == total["n"]:
        drop(train, counts)
        return _constant(texts["toxic"] / texts["n"])
    alpha, all_alpha = F.col("n") * PRIOR, total["n"] * PRIOR
    a, b, A, B = F.col("a") + alpha, F.col("n") - F.col("a") + alpha, total["a"] + all_alpha, total["n"] - total["a"] + all_alpha
    delta = F.log(a / (A - a)) - F.log(b / (B - b))
    sure = F.greatest(F.lit(0.0), F.abs(delta) - SIGMAS * F.sqrt(1 / a + 1 / b))
    known = counts.select("w", (F.signum(delta) * sure).alias("odds")).where("odds <> 0").collect()  # as many as the training rows let there be
    model = Model({r["w"]: r["odds"] for r in known})
    profile = cut(train.mapInArrow(_profiled(spark.sparkContext.broadcast(model)), "toxic int, m long, s array<double>"))
    bins = profile.where("toxic is null").groupBy("m").agg(F.sum(F.col("s")[0]).alias("n")).collect()
    n = np.array([r["n"] for r in bins], float)
    if len(n):
        model.rate = _rate(np.array([r["m"] for r in bins]) * BIN, n / n.sum())
    best = F.coalesce(F.array_max("s"), F.lit(0.0))
    start = profile.where("toxic = 0 and m > 0").agg(F.avg(F.col("m") * F.exp(-model.rate * best))).first()[0]
    model.start = 1 / start if start else 1.0
    cost = F.log1p(F.col("m") * model.start)
    each = F.when(F.size("s") > 0, F.transform("s", lambda s: s * model.rate - cost)).otherwise(F.array(-cost))
    x = F.array_max(each) - F.greatest(F.lit(0.0), F.array_max(each)) + F.aggregate(each, F.lit(0.0), lambda t, v: t + F.greatest(F.lit(0.0), v))
    rows_ = profile.where("toxic is not null").select("toxic", F.round(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), x)) * 4).alias("x"))
    rows_ = rows_.groupBy("x", "toxic").count().collect()
    model.slope, model.offset = _logistic(np.array([r["x"] / 4 for r in rows_]), np.array([r["toxic"] for r in rows_], float), np.array([r["count"] for r in rows_], float))
    drop(train, counts, profile)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Newton steps for weighted logistic regression on one feature, lightly ridged."""
    design, w = np.stack((x, np.ones_like(x)), 1), np.zeros(2)
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve((design * (n * q * (1 - q))[:, None]).T @ design + ridge, design.T @ (n * (y - q)) - ridge @ w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(w[0]), float(w[1])


def _scorer(shared, text: str, keep: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x, found = [], []
            for t in batch.column(text).to_pylist():
                scores = scores_of(t, model)
                got = segments(scores)
                x.append(significance(len(scores), got, model))
                found.append(got)
            flat = [s for got in found for s in got]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(got) for got in found]))).astype(np.int32))
            values = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["first", "last", "odds"])
            columns = {n: batch.column(n) for n in keep}
            yield pa.RecordBatch.from_pydict(columns | {"_x": pa.array(x, pa.float64()), "_segments": pa.ListArray.from_arrays(offsets, values)})

    return work


def score(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns `keep`, score, predicted and the segments (word positions and odds) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = "text" if "text" in keep else "_text"
    rows = docs.select(*keep, *([] if text in keep else [F.col("text").alias(text)]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    out = rows.mapInArrow(_scorer(shared, text, keep), f"{kinds}, _x double, _segments {SEGMENTS}")
    curve = F.least(F.lit(60.0), F.greatest(F.lit(-60.0), F.col("_x") * model.slope + model.offset))
    out = out.withColumn("score", 1 / (1 + F.exp(-curve)))
    return out.select(*keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("_segments").alias("segments"))


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
