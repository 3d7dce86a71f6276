"""Changes to tables kept by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def replace_pages(table: DataFrame, staged: DataFrame, pages: DataFrame, replaceable: Column) -> DataFrame:
    """`table` with the `replaceable` rows of the named pages gone and the staged rows of those pages added.

    A null in `replaceable` keeps the row.
    """
    kept = table.where(~replaceable | replaceable.isNull())
    other = table.where(replaceable).join(pages, "page", "left_anti").select(*table.columns)
    return kept.unionByName(other).unionByName(staged.join(pages, "page", "left_semi").select(*table.columns))
