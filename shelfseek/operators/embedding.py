"""Turn texts into vectors: feature hashing, or any batch function inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
HOSTED_DIM = 300
HOSTED_BATCH = 30
# Texts whose words are counted at once, however large an Arrow batch is.
_ROWS_PER_STEP = 512

Embedder = Callable[[list[str]], list[list[float]]]


def word_hashes(text: Column) -> Column:
    """The first four bytes of the MD5 of every word, lower-cased; words are runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.unhex(F.substring(F.md5(w.cast("binary")), 1, 8)))


def hashed_vector(text: Column, dim: int = DIM) -> Column:
    """Unit-length term counts, each word hashed to one of ``dim`` places; all zero without words.

    A word's place is the number in the first four bytes of its MD5, modulo ``dim``. Words and hashes
    are made in the JVM; counting and scaling take some rows of an Arrow batch at a time.
    """

    def scaled(rows: pa.Array) -> np.ndarray:
        flat = rows.flatten().cast(pa.binary(4))
        numbers = np.frombuffer(flat.buffers()[1], ">u4", len(flat), flat.offset * 4) if len(flat) else []
        row = np.repeat(np.arange(len(rows)), np.asarray(pc.fill_null(pc.list_value_length(rows), 0)))
        cells = row * dim + np.asarray(numbers, np.int64) % dim
        counts = np.bincount(cells, minlength=len(rows) * dim).reshape(len(rows), dim)
        size = np.sqrt((counts * counts).sum(1, keepdims=True))
        return (counts / np.where(size == 0, 1.0, size)).astype(np.float32).ravel()

    @F.arrow_udf("array<float>")
    def scaled_counts(rows: pa.Array) -> pa.Array:
        values = np.empty(len(rows) * dim, np.float32)
        for start in range(0, len(rows), _ROWS_PER_STEP):
            values[start * dim : (start + _ROWS_PER_STEP) * dim] = scaled(rows.slice(start, _ROWS_PER_STEP))
        return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, dim, dtype=np.int32), values)

    return scaled_counts(word_hashes(text))


def embed(df: DataFrame, text_col: str, dim: int = DIM, out_col: str = "embedding") -> DataFrame:
    return df.withColumn(out_col, hashed_vector(F.coalesce(F.col(text_col), F.lit("")), dim))


@dataclass(frozen=True)
class TextEmbedder:
    """How texts become vectors: a name that stands for the model and its version, and an expression."""

    name: str
    dim: int
    vector: Callable[[Column], Column]


def hashing(dim: int = DIM) -> TextEmbedder:
    return TextEmbedder(f"hashing-{dim}", dim, lambda text: hashed_vector(text, dim))


def from_model(name: str, dim: int, make_embedder: Callable[[], Embedder], batch_size: int = HOSTED_BATCH) -> TextEmbedder:
    """An embedder around a model that takes up to ``batch_size`` texts a call and is built once per task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_embedder()
        for texts in batches:
            found: list = []
            for start in range(0, len(texts), batch_size):
                found += model(texts.iloc[start : start + batch_size].tolist())
            yield pd.Series([np.asarray(vector, np.float32) for vector in found], dtype=object)

    return TextEmbedder(name, dim, lambda text: vectors(text))


def embed_in_batches(
    df: DataFrame,
    key_col: str,
    text_col: str,
    make_embedder: Callable[[], Embedder],
    batch_size: int = HOSTED_BATCH,
) -> DataFrame:
    """(key, embedding) from a model that takes a limited number of texts per call.

    ``make_embedder`` runs once per task, where it can load its model.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                yield pd.DataFrame({key_col: part[key_col], "embedding": model(part[text_col].tolist())})

    key_type = df.schema[key_col].dataType.simpleString()
    return df.select(key_col, text_col).mapInPandas(run, f"{key_col} {key_type}, embedding array<float>")
