"""Numeric columns: text casts of the catalog load and the NaN / infinity guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.functions.arrays import let
from shelfseek.functions.text import strip

# Fixed value: the decimal literals that count as a number (underscores between digits allowed).
NUMBER = r"^[+-]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def parsed_number(c: Column) -> Column:
    """A double from text, null where the text is no finite number."""
    def number(text: Column) -> Column:
        return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))

    return let(let(strip(c), number), finite)


def price(c: Column) -> Column:
    """Parsed number; zero counts as absent."""
    return F.nullif(parsed_number(c), F.lit(0.0))


rating = price


def count(c: Column) -> Column:
    """Parsed number cut to a whole one; zero counts as absent (but 0.5 becomes 0)."""
    return price(c).try_cast("bigint")


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def sanitize(df: DataFrame) -> DataFrame:
    """Make every floating and decimal column of ``df`` finite; decimals become doubles."""
    def column(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return finite(c.cast("double")).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return finite(c).alias(field.name)
        return c

    return df.select(*[column(field) for field in df.schema.fields])
