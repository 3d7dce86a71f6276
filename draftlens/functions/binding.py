"""Names for parts of expressions, so that an expression used in many places is written, and worked out, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
