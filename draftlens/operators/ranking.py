"""Greedy survivors of ranked conflicts, dedups built on them, and best candidates that aren't ambiguous."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.functions import segments
from draftlens.operators.graph import connected_components, cut, drop
from draftlens.operators.spatial import box_join

#: Conflicts that one task may hold; larger components are resolved in rounds over all tasks.
LOCAL_CONFLICTS = 200_000


def _beaten(conflicts: pa.Table) -> pa.Table:
    """The losers of one component's conflicts, each item decided after all that are better."""
    beats, waits = defaultdict(list), defaultdict(int)
    for w, l in zip(conflicts["winner"].to_pylist(), conflicts["loser"].to_pylist(), strict=True):
        beats[w].append(l)
        waits[l] += 1
    ready, gone = [w for w in beats if not waits[w]], set()
    while ready:
        item = ready.pop()
        for loser in beats[item]:
            if item not in gone:
                gone.add(loser)
            waits[loser] -= 1
            if not waits[loser]:
                ready.append(loser)
    return pa.table({"id": pa.array(gone, conflicts["loser"].type)})


def survivors(items: DataFrame, conflicts: DataFrame, local_conflicts: int = LOCAL_CONFLICTS) -> DataFrame:
    """The ids that stay when items are taken from best to worst and none may conflict with a kept one.

    `items`: id; `conflicts`: winner, loser, the better-ranked end first, for any total order. A
    component of at most `local_conflicts` is passed through in one task; in larger ones, round by
    round, those that no undecided better one contests stay, and what they beat goes. Both give the
    result of the sequential pass, however long a chain of conflicts is.
    """
    open_ = cut(conflicts.select("winner", "loser").distinct())
    parts = connected_components(open_.toDF("src", "dst"))
    placed = cut(open_.join(parts.withColumnRenamed("id", "winner"), "winner"))
    drop(open_)
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > local_conflicts).select("component")
    kind = f"id {placed.schema['loser'].dataType.simpleString()}"
    out = [cut(placed.join(large, "component", "left_anti").groupBy("component").applyInArrow(lambda t: _beaten(t), kind))]
    open_ = cut(placed.join(large, "component", "left_semi").select("winner", "loser"))
    drop(placed)
    while not open_.isEmpty():
        safe = open_.select("winner").distinct().join(open_.select(F.col("loser").alias("winner")), "winner", "left_anti")
        beaten = cut(open_.join(safe, "winner", "left_semi").select(F.col("loser").alias("id")).distinct())
        out.append(beaten)
        old, open_ = open_, cut(open_.join(beaten.toDF("winner"), "winner", "left_anti").join(beaten.toDF("loser"), "loser", "left_anti"))
        drop(old)
        if len(out) > 20:
            merged = out[0]
            for more in out[1:]:
                merged = merged.unionByName(more)
            merged, old = cut(merged), out
            out = [merged]
            drop(*old)
    gone = out[0]
    for more in out[1:]:
        gone = gone.unionByName(more)
    return items.join(gone, "id", "left_anti")


def claim_survivors(members: DataFrame) -> DataFrame:
    """The claims (id, rank) that stay when they are taken by rank and each member belongs to one only.

    `members`: id, member, rank (unique per id). A round keeps the claims that are first for all
    their members and drops those that share one; no pairs of claims are formed, so a member of
    many claims costs no more than one of few.
    """
    open_, out = cut(members.select("id", "member", "rank").distinct()), []
    while not open_.isEmpty():
        first = open_.groupBy("member").agg(F.min("rank").alias("_least"))
        marked = open_.join(first, "member")
        safe = cut(marked.groupBy("id", "rank").agg(F.bool_and(F.col("rank") == F.col("_least")).alias("_all")).where("_all").select("id", "rank"))
        out.append(safe)
        taken = open_.join(safe.select("id"), "id", "left_semi").select("member").distinct()
        dropped = open_.join(taken, "member", "left_semi").select("id").distinct()
        old, open_ = open_, cut(open_.join(dropped, "id", "left_anti"))
        drop(old)
    if not out:
        return members.select("id", "rank").limit(0)
    kept = out[0]
    for more in out[1:]:
        kept = kept.unionByName(more)
    return kept


def best_of_alike(rows: DataFrame, key: list[Column], place: Column, alike: Column) -> DataFrame:
    """Of the rows of one `key` the one of least `place`, and all rows for which `alike` isn't true."""
    lone = F.when(~F.coalesce(alike, F.lit(False)), F.monotonically_increasing_id())
    marked = rows.select(F.struct(*rows.columns).alias("_r"), place.alias("_place"), lone.alias("_lone"), *[k.alias(f"_k{n}") for n, k in enumerate(key)])
    best = marked.groupBy(*[f"_k{n}" for n in range(len(key))], "_lone").agg(F.min_by("_r", "_place").alias("_r"))
    return best.select("_r.*")


def dedupe_boxes(boxes: DataFrame, order: list[str], conflict, size: float = 32.0, looks_at: list[str] | None = None) -> DataFrame:
    """The rows of `boxes` (page, id, x0, y0, x1, y1, ...) that stay when taken in `order`, ties by id.

    `conflict(w, l)` says of two rows' structs, the better one first, whether the second must go;
    only boxes that meet are compared. `looks_at` names the columns besides the box that it looks
    at; where they are known, only the best of equal boxes is compared: it beats the others if it
    stays, and whatever beats it beats them. Equal boxes that don't beat each other all count.
    """
    names = list(dict.fromkeys([*order, "id"]))
    whole = lambda side: F.struct(*[F.col(f"{side}.{c}" if side else c).alias(c) for c in boxes.columns])
    key = lambda side: F.struct(*[F.col(f"{side}.{n}" if side else n).alias(n) for n in names])
    if looks_at is not None:
        own = F.expr("page is not null and x0 <= x1 and y0 <= y1") & conflict(whole(""), whole(""))
        boxes = best_of_alike(boxes, [F.col(c) for c in ("page", "x0", "y0", "x1", "y1", *looks_at)], key(""), own)
    boxes = cut(boxes)
    beaten = lambda met: met.where(F.expr("a.id <> b.id") & (key("a") < key("b")) & conflict(whole("a"), whole("b"))).select(F.col("a.id").alias("winner"), F.col("b.id").alias("loser"))
    kept = survivors(boxes.select("id"), box_join(boxes, boxes, size, beaten))
    return boxes.join(kept.distinct(), "id", "left_semi")


def nms(boxes: DataFrame, threshold: float, size: float = 64.0) -> DataFrame:
    """Detector boxes (page, id, score, x0, ...) whose overlap with no better kept one reaches `threshold`."""
    return dedupe_boxes(boxes.withColumn("_order", -F.col("score")), ["_order"], lambda w, l: segments.shares(w, l)[0] >= threshold, size, []).drop("_order")


def final_positions(items: DataFrame) -> DataFrame:
    """One winner per type and place of items (page, id, type, syntax, text_length, confidence, x0, ...).

    Better syntax first; then the longer text and the smaller box, for geometric tolerances (type
    `gdt`) the larger box and the higher confidence; then the id.
    """
    # Syntax labels from best to worst.
    ranks = ["ok", "incomplete_separator", "unread_glyph_present", "invalid_dimension_syntax"]
    syntax = F.lit(len(ranks))
    for k, label in enumerate(ranks):
        syntax = F.when(F.coalesce("syntax", F.lit("ok")) == label, k).otherwise(syntax)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    gdt = F.col("type") == "gdt"
    second = F.when(gdt, -area).otherwise(-F.coalesce("text_length", F.lit(0)))
    third = F.when(gdt, -F.coalesce("confidence", F.lit(0.0))).otherwise(area)
    ranked = items.withColumn("_a", syntax).withColumn("_b", second.cast("double")).withColumn("_c", third.cast("double"))
    return dedupe_boxes(ranked, ["_a", "_b", "_c"], lambda w, l: w["type"].eqNullSafe(l["type"]) & segments.same_place(w, l), looks_at=["type"]).drop("_a", "_b", "_c")


def read_texts(rows: DataFrame, iou: float = 0.5) -> DataFrame:
    """Read texts (page, id, eng_len, has_tolerance, geometric, confidence, x0, ...) whose overlap with no fuller kept one is above `iou`."""
    down = {"_a": "eng_len", "_b": "has_tolerance", "_c": "geometric", "_d": "confidence"}
    ranked = rows
    for name, column in down.items():
        ranked = ranked.withColumn(name, -F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
    return dedupe_boxes(ranked, list(down), lambda w, l: segments.shares(w, l)[0] > iou, looks_at=[]).drop(*down)


def table_regions(regions: DataFrame) -> DataFrame:
    """Regions from large to small, without those in a kept one or with more than four fifths in common with it."""
    inside = lambda w, l: (w["x0"] <= l["x0"]) & (w["y0"] <= l["y0"]) & (w["x1"] >= l["x1"]) & (w["y1"] >= l["y1"])
    ranked = regions.withColumn("_a", -(F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return dedupe_boxes(ranked, ["_a"], lambda w, l: inside(w, l) | (segments.shares(w, l)[0] > 0.8), 64.0, []).drop("_a")


def best_unless_ambiguous(candidates: DataFrame, key: str, score: str, tie: str, distance: str | None = None, relative: float = 0.15, absolute: float = 5.0) -> DataFrame:
    """Each key's lowest-scored candidate, unless the runner-up's distance is too near to tell.

    Too near means a gap below `absolute` and below `relative` of the best distance (at least 1).
    Candidates without a score or distance don't count; a key may be left without a row.
    """
    far = distance or score
    by = Window.partitionBy(key).orderBy(score, far, tie)
    gap: Column = F.abs(F.lead(far).over(by) - F.col(far))
    rows = candidates.where(F.col(score).isNotNull() & F.col(far).isNotNull()).withColumn("_gap", gap).withColumn("_place", F.row_number().over(by))
    near = (F.col("_gap") < absolute) & (F.col("_gap") / F.greatest(F.abs(F.col(far)), F.lit(1.0)) < relative)
    return rows.where(F.col("_place") == 1).where(~F.coalesce(near, F.lit(False))).drop("_place", "_gap")
