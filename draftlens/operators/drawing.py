"""Aggregates and lookups over drawing primitives, pages and review items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.operators.spatial import box_join

# Widths up to this count as none; threshold without any width.
ZERO_WIDTH, NO_WIDTH = 0.01, 0.5


def width_threshold(lines: DataFrame, width: Column, length: Column) -> DataFrame:
    """One row: the width between thin and thick lines, half-way between the two widths of the largest total length.

    Widths round to four places. A single width counts one and a half times; ties go to the smaller width.
    """
    by_width = lines.where(width > ZERO_WIDTH).groupBy(F.bround(width, 4).alias("width")).agg(F.sum(length).alias("total"))
    top = by_width.orderBy(F.desc("total"), "width").limit(2)
    n = F.count("*")
    return top.agg(F.when(n == 0, NO_WIDTH).when(n == 1, F.max("width") * 1.5).otherwise(F.avg("width")).alias("threshold"))


def modal_width(lines: DataFrame, width: Column, ordinal: Column) -> DataFrame:
    """One row: the most frequent width and its count; of equally frequent ones the first seen."""
    counts = lines.groupBy(width.alias("width")).agg(F.count("*").alias("n"), F.min(ordinal).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(1).select("width", "n")


def font_layers(blocks: DataFrame, size: str, key: list[str]) -> DataFrame:
    """`blocks` with `layer`: L above one and a half times the key's median size, S below four fifths of it, else M.

    Sizes of 0 or less don't count for the median; a key without any is all M. Null keys are a key.
    """
    mid = blocks.where(F.col(size) > 0).groupBy(*key).agg(F.percentile(size, 0.5).alias("_mid"))
    same = [blocks[k].eqNullSafe(mid[k]) for k in key]
    joined = blocks.join(mid.select(*[F.col(k).alias(f"_key_{k}") for k in key], "_mid"), [blocks[k].eqNullSafe(F.col(f"_key_{k}")) for k in key], "left") if same else blocks
    layer = F.when(F.col(size) > 1.5 * F.col("_mid"), "L").when(F.col(size) < 0.8 * F.col("_mid"), "S").otherwise("M")
    return joined.withColumn("layer", layer).drop("_mid", *[f"_key_{k}" for k in key])


def page_counts(rows: DataFrame, page: str, pages: int) -> DataFrame:
    """Rows per page 0 to `pages` - 1, pages without any included."""
    counts = rows.groupBy(F.col(page).cast("long").alias("page")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(pages).withColumnRenamed("id", "page").join(counts, "page", "left").select("page", F.coalesce("n", F.lit(0)).alias("n"))


def expand_quantity(rows: DataFrame, quantity: Column, into: str = "copy") -> DataFrame:
    """Each row as often as its quantity says, 1 to 999, numbered from 1; a null quantity counts 1."""
    times = F.greatest(F.lit(1), F.least(F.lit(999), F.coalesce(quantity.cast("long"), F.lit(1))))
    return rows.withColumn(into, F.explode(F.sequence(F.lit(1).cast("long"), times)))


def duplicate_groups(rows: DataFrame, digest: Column, ordinal: Column) -> DataFrame:
    """digest, first ordinal and count of every digest that more than one row has."""
    return rows.groupBy(digest.alias("digest")).agg(F.min(ordinal).alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1")


def overlay(items: DataFrame, decisions: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """`items` with a decision's values over the given defaults; an explicit null wins. One decision per key.

    `columns` maps each decided column to what it is without a decision; `decided` tells which rows have one.
    """
    marked = decisions.select(key, *columns, F.lit(True).alias("decided"))
    rows = items.join(marked, key, "left").withColumn("decided", F.coalesce("decided", F.lit(False)))
    for name, default in columns.items():
        rows = rows.withColumn(name, F.when(F.col("decided"), F.col(name)).otherwise(default))
    return rows


def drop_ledger(rows: DataFrame, stage: str, reasons: list[tuple[str, Column]], ordinal: Column) -> DataFrame:
    """Per stage: rows in and out, the first row dropped, and drops by reason (a map without zeroes); the first reason that holds counts."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(reasons):
        reason = F.when(rule, name).otherwise(reason)
    named = rows.withColumn("_reason", reason)
    dropped = F.col("_reason").isNotNull()
    counts = [F.count_if(F.col("_reason") == name).alias(f"_n{k}") for k, (name, _) in enumerate(reasons)]
    out = named.groupBy(stage).agg(F.count("*").alias("n_in"), F.count_if(~dropped).alias("n_out"), F.min(F.when(dropped, ordinal)).alias("first_drop"), *counts)
    entries = F.array(*[F.struct(F.lit(name).alias("key"), F.col(f"_n{k}").alias("value")) for k, (name, _) in enumerate(reasons)])
    return out.select(stage, "n_in", "n_out", "first_drop", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)).alias("by_reason"))


def band_lookup(keys: DataFrame, table: DataFrame, equal: list[str], bands: dict[str, float], key_id: str, entry_id: str) -> DataFrame:
    """(key_id, entry_id) of keys and entries equal in `equal` and within a width of each other in each of `bands`."""
    first, width = next(iter(bands.items()))
    k = keys.withColumn("_band", F.explode(F.sequence(F.floor(F.col(first) / width) - 1, F.floor(F.col(first) / width) + 1))).alias("k")
    t = table.withColumn("_band", F.floor(F.col(first) / width)).alias("t")
    on = F.col("k._band") == F.col("t._band")
    for name in equal:
        on = on & (F.col(f"k.{name}") == F.col(f"t.{name}"))
    for name, w in bands.items():
        on = on & (F.abs(F.col(f"k.{name}") - F.col(f"t.{name}")) <= w)
    return k.join(t, on).select(F.col(f"k.{key_id}").alias("key"), F.col(f"t.{entry_id}").alias("entry"))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at that share of an array's order, the rank rounded half to even; 0 of an empty array."""
    share = max(0.0, min(1.0, fraction))
    place = F.bround((F.size(values) - 1) * F.lit(share)).cast("int")
    return F.coalesce(F.get(F.array_sort(values), place), F.lit(0.0))


def union_box(rows: DataFrame, key: list[str]) -> DataFrame:
    """The box around each key's boxes."""
    return rows.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def label_order(label: Column) -> Column:
    """A sort key for labels: `12` before `12-3` before `12-x`, by numbers; anything else last, by text."""
    head, tail = F.regexp_extract(label, "^([0-9]+)(?:-|$)", 1), F.regexp_extract(label, "^[0-9]+-([0-9]+)$", 1)
    second = F.when(label.rlike("^[0-9]+$"), 0).when(tail != "", tail.try_cast("long")).otherwise(1_000_000)
    named = head != ""
    return F.struct(F.when(named, 0).otherwise(1).alias("kind"), F.when(named, head.try_cast("long")).otherwise(0).alias("first"), F.when(named, second.cast("long")).otherwise(0).alias("second"), label.alias("label"))


def row_order(y: Column, x: Column, height: float = 15.0) -> Column:
    """A sort key for places: rows of that height from top to bottom, then left to right."""
    return F.struct(F.floor(y / height).alias("row"), x.alias("x"))


def table_regions_outside_views(regions: DataFrame, views: DataFrame, cells: DataFrame, overlap: float = 0.50, least_cells: int = 4, size: float = 64.0) -> DataFrame:
    """Table regions (page, id, box) but those that a view covers by half or more (`overlap`, above 0), unless enough cells are centred in them.

    Only boxes that meet are compared, and equal ones once.
    """
    sides = ["x0", "y0", "x1", "y1"]
    spots = regions.select("page", *sides).distinct()
    covers = views.select("page", *sides).distinct()
    centres = cells.select("page", ((F.col("x0") + F.col("x1")) / 2).alias("x0"), ((F.col("y0") + F.col("y1")) / 2).alias("y0")).groupBy("page", "x0", "y0").agg(F.count("*").alias("n"))
    centres = centres.select("page", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"), "n")
    place = [F.col(f"a.{c}").alias(c) for c in ("page", *sides)]

    def share(met: DataFrame) -> DataFrame:
        side = lambda lo, hi: F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}")
        area = (F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0"))
        return met.where(F.when(area > 0, side("x0", "x1") * side("y0", "y1") / area).otherwise(0.0) >= overlap).select(*place)

    covered = box_join(spots, covers, size, share).distinct()
    full = box_join(spots, centres, size, lambda met: met.select(*place, "b.n")).groupBy("page", *sides).agg(F.sum("n").alias("n")).where(F.col("n") >= least_cells)
    dropped = covered.join(full, ["page", *sides], "left_anti")
    return regions.join(dropped, ["page", *sides], "left_anti")


def without_fragments(texts: DataFrame, reach: float = 50.0) -> DataFrame:
    """Dimension texts (page, id, text, x, y, toleranced) but short numbers and prefixed numbers that a longer text near them holds."""
    compact = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
    rows = texts.withColumn("_c", compact).withColumn("_gx", F.floor(F.col("x") / reach)).withColumn("_gy", F.floor(F.col("y") / reach))
    short = F.col("_c").rlike("^[0-9]{1,3}$") | (F.col("_c").rlike("(?i)^[⌀∅ØφΦR][0-9]{1,2}$") & ~F.coalesce("toleranced", F.lit(False)))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = rows.where(short).withColumn("_s", F.explode(steps)).withColumn("_gx", F.col("_gx") + F.col("_s.i")).withColumn("_gy", F.col("_gy") + F.col("_s.j")).alias("a")
    b = rows.alias("b")
    same = F.expr("a.page = b.page and a._gx = b._gx and a._gy = b._gy and length(b._c) > length(a._c) and contains(b._c, a._c)")
    gone = a.join(b, same & (F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) < reach), "left_semi").select("page", "id").distinct()
    return texts.join(gone, ["page", "id"], "left_anti")


def running_number(rows: DataFrame, group: str, order: list[str], into: str = "number") -> DataFrame:
    """Continuous numbers over all groups, from 1: by group, then `order`; numbering within a group is one window, its start a sum over groups."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    start = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))).select(F.col(group).alias("_g"), "_start")  # one row per group
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.join(start, placed[group].eqNullSafe(F.col("_g"))).withColumn(into, F.coalesce("_start", F.lit(0)) + F.col("_place")).drop("_start", "_place", "_g")
