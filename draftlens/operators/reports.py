"""Inspection reports: records of dimension reports and of coordinate-measuring reports, from the cells of workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.functions import cells
from draftlens.operators import inspection

FILE = ["source_file", "source_hash"]
SHEET = [*FILE, "sheet"]
# How far from the top heads are looked for, and where samples stand without a head.
HEAD_ROWS, REPORT_HEAD_ROWS, SAMPLE_HEAD_ROWS, FIRST_SAMPLE, LAST_SAMPLE, SAMPLES = 30, 60, 5, 5, 40, 6
# Heads of a measuring report and the column each names.
REPORT_HEADS = {"characteristic": ["characteristic"], "actual": ["actual"], "nominal": ["nominal"], "upper_tol": ["upper tol", "upper tolerance"], "lower_tol": ["lower tol", "lower tolerance"], "deviation": ["deviation"]}


def sheet_rows(table: DataFrame) -> DataFrame:
    """A row per sheet and row that has cells: `c`, a map from column to text, number and flag, and the sheet's width."""
    filled = table.where("row is not null")
    rows = filled.groupBy(*SHEET, "sheet_index", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("text", "number", "flag")))).alias("c"), F.max("col").alias("_last"))
    return rows.withColumn("ncols", F.max("_last").over(Window.partitionBy(*SHEET)) + 1).drop("_last")


def _cell(col: Column | int, c: str = "c") -> Column:
    return F.col(c)[F.lit(col).cast("int") if isinstance(col, int) else col.cast("int")]


def text_at(col: Column | int) -> Column:
    return cells.norm_text(_cell(col)["text"])


def number_at(col: Column | int) -> Column:
    """A cell's number, or the first in its text; none of a truth value."""
    cell = _cell(col)
    return F.coalesce(cell["number"], F.when(cell["flag"].isNull(), cells.parse_number(cell["text"])))


def row_text(columns: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), text_at), " ")


def detect_types(table: DataFrame) -> DataFrame:
    """source_type of every file: a sheet `03`, else a measuring report's heads, else known sheet names."""
    rows = sheet_rows(table)
    heads = _report_heads(rows).select(*FILE).distinct().withColumn("_report", F.lit(True))
    names = table.where("sheet is not null").groupBy(*FILE).agg(F.collect_set(F.lower("sheet")).alias("names"))
    known = F.arrays_overlap("names", F.array(*map(F.lit, ("main", "detail", "baogaozhengli"))))
    kind = F.when(F.array_contains("names", "03"), "dimension_report").when(F.coalesce("_report", F.lit(False)), "calypso_report").when(known, "measurement_result").otherwise("unknown")
    return names.join(heads, FILE, "left").select(*FILE, kind.alias("source_type"))


def dimension_records(table: DataFrame) -> DataFrame:
    """Records of the sheets `03` of dimension reports; a sheet without a head has none.

    A row continues the item above when it has no number of its own. Limits or deviations, as the
    heads say; samples stand under 1, 2, ... near the head, else in six columns.
    """
    rows = sheet_rows(table.where(F.lower("sheet") == "03"))
    text = row_text(14)
    is_head = F.upper(text).contains("NO") & (text.contains("检验项目") | F.upper(text).contains("ITEM"))
    heads = rows.where((F.col("row") < HEAD_ROWS) & is_head).groupBy(*SHEET).agg(F.min("row").alias("head"))
    rows = rows.join(heads, SHEET)

    def run(state: Column, col: Column) -> Column:
        """The first run of cells that count 1, 2, ..."""
        value = number_at(col)
        fits = F.coalesce((F.abs(value - (state["n"] + 1)) < 1e-9) & ~state["done"], F.lit(False))
        start = F.when(fits & (state["n"] == 0), col).otherwise(state["start"])
        return F.struct(start.alias("start"), (state["n"] + F.when(fits, 1).otherwise(0)).alias("n"), (state["done"] | (~fits & (state["n"] > 0))).alias("done"))

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    near = rows.where((F.col("row") >= F.col("head")) & (F.col("row") < F.col("head") + SAMPLE_HEAD_ROWS))
    columns = F.when(F.col("ncols") > FIRST_SAMPLE, F.sequence(F.lit(FIRST_SAMPLE), F.least("ncols", F.lit(LAST_SAMPLE)) - 1)).otherwise(F.array().cast("array<int>"))
    samples = near.withColumn("_run", F.aggregate(columns, zero, run)).where("_run.n > 0").groupBy(*SHEET).agg(F.min_by("_run", "row").alias("_run"))
    labels = F.concat_ws(" ", text_at(3), text_at(4))
    modes = rows.where((F.col("row") >= F.col("head")) & (F.col("row") < F.col("head") + 4)).groupBy(*SHEET).agg(cells.limit_mode(F.array_join(F.collect_list(labels), " ")).alias("mode"))
    rows = rows.join(samples, SHEET, "left").join(modes, SHEET, "left").where("row > head")
    first = F.coalesce("_run.start", F.lit(FIRST_SAMPLE))
    many = F.coalesce("_run.n", F.greatest(F.lit(0), F.least("ncols", F.lit(FIRST_SAMPLE + SAMPLES)) - FIRST_SAMPLE))
    after = F.when(many > 0, first + many).otherwise(11)
    rows = rows.withColumn("_first", first).withColumn("_many", many).withColumn("_after", after)
    listed = F.when(F.col("_many") > 0, F.transform(F.sequence(F.lit(1), F.col("_many")), lambda i: F.struct(i.alias("sample"), number_at(F.col("_first") + i - 1).alias("value")))).otherwise(F.array().cast("array<struct<sample:int,value:double>>"))
    rows = rows.withColumn("actuals", F.filter(listed, lambda a: a["value"].isNotNull()))
    rows = rows.withColumn("item_text", text_at(2)).withColumn("_up", number_at(3)).withColumn("_low", number_at(4)).withColumn("_label", row_text(13))
    filled = (F.col("item_text") != "") | (F.size("actuals") > 0) | F.col("_up").isNotNull() | F.col("_low").isNotNull()
    subhead = F.col("_label").contains("名义值") & (F.col("_label").contains("上差") | F.col("_label").contains("上限") | F.col("_label").contains("UTL"))
    rows = rows.where(filled & ~subhead)

    record = F.concat_ws(":", "source_hash", "sheet", F.col("row") + 1, F.lit(1))
    above = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("record_id", record).withColumn("_own", cells.item_number(_cell(0)["text"]))
    rows = rows.withColumn("no", F.last("_own", ignorenulls=True).over(above)).withColumn("_parent", F.last(F.when(F.col("_own").isNotNull(), F.col("record_id")), ignorenulls=True).over(above))
    rows = rows.where((F.col("item_text") != "") | F.col("no").isNotNull())
    deviation = F.col("mode") == "deviation"
    read = cells.nominal_and_tolerances(F.col("item_text"), F.when(~deviation, F.col("_up")), F.when(~deviation, F.col("_low")))
    rows = rows.withColumn("_read", read).withColumn("nominal", F.col("_read.nominal"))
    rows = rows.withColumn("upper_tol", F.when(deviation, F.coalesce("_up", "_read.upper")).otherwise(F.col("_read.upper"))).withColumn("lower_tol", F.when(deviation, F.coalesce("_low", "_read.lower")).otherwise(F.col("_read.lower")))
    rows = rows.withColumn("utl", F.when(deviation, inspection.limit(F.col("nominal"), F.col("upper_tol"))).otherwise(F.col("_up"))).withColumn("ltl", F.when(deviation, inspection.limit(F.col("nominal"), F.col("lower_tol"))).otherwise(F.col("_low")))
    said = text_at(F.col("_after"))
    return rows.select(
        "record_id", "source_file", F.lit("dimension_report").alias("source_type"), F.col("sheet").alias("source_sheet"), (F.col("row") + 1).alias("source_row"), "no",
        F.upper(text_at(1)).isin("Y", "YES", "1", "TRUE").alias("is_key"), "item_text", "nominal", "upper_tol", "lower_tol", "utl", "ltl", "actuals",
        inspection.result(F.transform("actuals", lambda a: a["value"]), F.col("utl"), F.col("ltl"), said).alias("result"),
        F.coalesce(F.nullif(cells.result_token(said), F.lit("")), said).alias("raw_result"), text_at(F.col("_after") + 1).alias("equipment"),
        F.when(F.col("_own").isNull(), F.col("_parent")).alias("continuation_of"),
    )


def _report_heads(rows: DataFrame) -> DataFrame:
    """The first head row of each measuring-report sheet and the column of each of its heads (the last so named)."""
    labels = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda c: F.lower(text_at(c)))
    heads = rows.where(F.col("row") < REPORT_HEAD_ROWS).withColumn("_labels", labels)
    for name, spellings in REPORT_HEADS.items():
        places = [F.when(F.array_contains("_labels", s), 12 - F.array_position(F.reverse("_labels"), s)) for s in spellings]
        heads = heads.withColumn(f"_{name}", (F.greatest(*places) if len(places) > 1 else places[0]).cast("int"))
    needed = [f"_{n} is not null" for n in REPORT_HEADS if n != "deviation"]
    columns = [f"_{n}" for n in REPORT_HEADS]
    found = heads.where(" and ".join(needed))
    return found.groupBy(*SHEET, "sheet_index").agg(F.min_by(F.struct(F.col("row").alias("head"), *columns), "row").alias("_h")).select(*SHEET, "sheet_index", "_h.*")


def measuring_records(table: DataFrame) -> DataFrame:
    """Records of each file's first sheet with the heads of a measuring report; rows without a characteristic don't count."""
    rows = sheet_rows(table)
    heads = _report_heads(rows)
    first = heads.groupBy(*FILE).agg(F.min("sheet_index").alias("sheet_index"))
    heads = heads.join(first, [*FILE, "sheet_index"]).drop("sheet_index")
    rows = rows.join(heads, SHEET).where("row > head").withColumn("raw_item_name", text_at(F.col("_characteristic"))).where("raw_item_name <> ''")
    labelled = F.col("raw_item_name").rlike(cells.LABELLED)
    rows = rows.withColumn("no", F.when(labelled, F.regexp_extract("raw_item_name", cells.LABELLED, 1)))
    rows = rows.withColumn("item_text", F.when(labelled, F.regexp_extract("raw_item_name", cells.LABELLED, 2)).otherwise(F.col("raw_item_name")))
    rows = rows.withColumn("_read", cells.nominal_and_tolerances(F.col("item_text"))).withColumn("nominal", F.coalesce(number_at(F.col("_nominal")), F.col("_read.nominal")))
    rows = rows.withColumn("upper_tol", F.coalesce(number_at(F.col("_upper_tol")), F.col("_read.upper"))).withColumn("lower_tol", F.coalesce(number_at(F.col("_lower_tol")), F.col("_read.lower")))
    rows = rows.withColumn("utl", inspection.limit(F.col("nominal"), F.col("upper_tol"))).withColumn("ltl", inspection.limit(F.col("nominal"), F.col("lower_tol"))).withColumn("_actual", number_at(F.col("_actual")))
    actuals = F.when(F.col("_actual").isNotNull(), F.array(F.struct(F.lit(1).alias("sample"), F.col("_actual").alias("value")))).otherwise(F.array().cast("array<struct<sample:int,value:double>>"))
    return rows.withColumn("actuals", actuals).select(
        F.concat_ws(":", "source_hash", "sheet", F.col("row") + 1, F.lit(1)).alias("record_id"), "source_file", F.lit("calypso_report").alias("source_type"), F.col("sheet").alias("source_sheet"), (F.col("row") + 1).alias("source_row"),
        "no", F.lit(False).alias("is_key"), "item_text", "nominal", "upper_tol", "lower_tol", "utl", "ltl", "actuals",
        inspection.result(F.transform("actuals", lambda a: a["value"]), F.col("utl"), F.col("ltl")).alias("result"), "raw_item_name", F.lit("CMM").alias("equipment"), number_at(F.col("_deviation")).alias("deviation"),
    )
