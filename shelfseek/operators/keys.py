"""Dense and continuing row keys without pulling all rows into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfseek.workspace import new_path


def positional_ids(df: DataFrame, order_by: list[str], id_col: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, …`` in ``order_by`` order, without gaps.

    The rows are range-sorted and written once. A row's number is its index in its file plus the rows
    of all earlier files, so only one count per file is ever gathered (at most one file per shuffle
    partition, hence the broadcast).
    """
    spark = df.sparkSession
    path = new_path(spark, "ordered")
    df.orderBy(*order_by).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("bigint")
    earlier = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    numbered = rows.join(F.broadcast(offsets), "_file")
    return numbered.select(
        (F.col("_offset") + F.col("_row") + start).cast("bigint").alias(id_col), *df.columns
    )


def continue_ids(new: DataFrame, existing: DataFrame, order_by: list[str], id_col: str) -> DataFrame:
    """Give ``new`` rows the keys after the largest key of ``existing``."""
    highest = existing.agg(F.max(id_col)).first()[0]
    return positional_ids(new, order_by, id_col, start=(highest or 0) + 1)


CHUNK_BITS = 24


def chunk_key(product_id: Column, chunk_idx: Column) -> Column:
    """One BIGINT per chunk that sorts like (product, position).

    A text holds at most 2**31 bytes, so it cannot yield 2**24 chunks of ordinary size; numbers beyond
    the room of the key raise an error.
    """
    fits = product_id.between(0, 2 ** (63 - CHUNK_BITS) - 1) & (chunk_idx < 2**CHUNK_BITS)
    key = F.shiftleft(product_id.cast("bigint"), CHUNK_BITS).bitwiseOR(chunk_idx.cast("bigint"))
    return F.when(fits, key).otherwise(F.raise_error(F.lit("chunk key out of range")).cast("bigint"))
