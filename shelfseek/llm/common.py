"""What the operators of this subpackage share: written tables, held-out rows, texts as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.workspace import new_path

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder, so that a lost executor costs no more than its tasks."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return (F.crc32(text) % mod).cast("int")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def summed(parts: DataFrame) -> list[float]:
    """Add up rows of one array column ``part``, place by place, on the executors.

    What reaches the driver is one array, as long as the arrays of ``parts``; its length must not depend
    on the data.
    """
    places = parts.select(F.posexplode("part").alias("place", "value"))
    totals = places.groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = [0.0] * len(totals)
    for row in totals:
        values[row["place"]] = row["value"]
    return values


def batches_of(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch for batch in frame if batch.num_rows)
