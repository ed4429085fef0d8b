"""Arrays to rows, and values used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_rows(df: DataFrame, array: Column, position: str, item: str) -> DataFrame:
    """One row per array item with its position.

    A plain explode makes Spark infer "the array is not empty", which computes the array once more for
    the test. The outer form computes it once; its placeholder rows are dropped afterwards.
    """
    rows = df.select("*", F.posexplode_outer(array).alias(position, item))
    return rows.where(F.col(position).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
