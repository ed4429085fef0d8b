"""Columns as a product card shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_STORE = "Unknown Store"


def store_label(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN_STORE))


def price_label(c: Column) -> Column:
    return F.when(c != 0, F.concat(F.lit("$"), F.format_string("%.2f", c)))


def star_bar(c: Column) -> Column:
    """Five stars, filled up to the rounded rating."""
    filled = F.floor(c + 0.5).cast("int")
    return F.when(c != 0, F.concat(F.repeat(F.lit("★"), filled), F.repeat(F.lit("☆"), 5 - filled)))


def rating_label(c: Column) -> Column:
    return F.when(c != 0, F.format_string("%.1f", c))


def reviews_label(c: Column) -> Column:
    return F.when(c != 0, F.concat(F.format_number(c, 0), F.lit(" reviews")))
