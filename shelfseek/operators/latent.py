"""An embedder learned from the texts themselves: the leading axes of their word weights.

Words are hashed to places, a text is a sparse row of weights (log of the count, times the rarity of the
place), and a randomised truncated singular value decomposition of all rows finds the axes along which they
differ most. Every pass streams the texts through tasks that hold the axes; a task sends its part of the
next axes as small blocks, which are added up by place. The driver keeps ``places x (dim + EXTRA)`` numbers
and one Gram matrix of (dim + EXTRA)², whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.operators.embedding import TextEmbedder, word_hashes
from shelfseek.workspace import new_path

PLACES = 1 << 16
#: Axes beyond those asked for, and passes that sharpen them before the last one.
EXTRA = 16
PASSES = 3
#: Places in one block of summed axes, and weights that are multiplied at a time.
BLOCK = 64
CHUNK = 1 << 15


@dataclass
class SparseRows:
    """Rows of weights: row, place and weight of every entry, ordered by row and place."""

    n: int
    row: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    def times(self, axes: np.ndarray) -> np.ndarray:
        """The product with ``axes`` (places x m), a bounded number of entries at a time."""
        out = np.zeros((self.n, axes.shape[1]))
        for cut in range(0, len(self.row), CHUNK):
            row, place, weight = (a[cut : cut + CHUNK] for a in (self.row, self.place, self.weight))
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += np.add.reduceat(axes[place] * weight[:, None], first, axis=0)
        return out

    def add_transposed(self, values: np.ndarray, sums: np.ndarray) -> None:
        """Add the product of the transposed rows with ``values`` (n x m) to ``sums`` (places x m)."""
        for cut in range(0, len(self.row), CHUNK):
            row, place, weight = (a[cut : cut + CHUNK] for a in (self.row, self.place, self.weight))
            order = np.argsort(place, kind="stable")
            row, place, weight = row[order], place[order], weight[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            sums[place[first]] += np.add.reduceat(values[row] * weight[:, None], first, axis=0)


def sparse_rows(hashes: pa.Array, rarity: np.ndarray) -> SparseRows:
    """Unit rows of log(1 + count) times rarity, from one list of word hashes per text; none without words."""
    flat = hashes.flatten().cast(pa.binary(4))
    numbers = np.frombuffer(flat.buffers()[1], ">u4", len(flat), flat.offset * 4) if len(flat) else np.zeros(0, np.int64)
    lengths = [len(words) if words is not None else 0 for words in hashes]
    row = np.repeat(np.arange(len(hashes)), np.asarray(lengths, np.int64))
    cells, counts = np.unique(row * len(rarity) + numbers.astype(np.int64) % len(rarity), return_counts=True)
    row, place = cells // len(rarity), cells % len(rarity)
    weight = np.log1p(counts) * rarity[place]
    size = np.sqrt(np.bincount(row, weight * weight, minlength=len(hashes)))
    return SparseRows(len(hashes), row, place, weight / size[row])


@dataclass(frozen=True)
class LatentModel:
    rarity: np.ndarray
    axes: np.ndarray
    singular: np.ndarray

    @property
    def dim(self) -> int:
        return self.axes.shape[1]

    def embedder(self, name: str) -> TextEmbedder:
        """``name`` stands for the model and what it was learned from; indexes are kept apart by it."""
        return TextEmbedder(name, self.dim, lambda text: latent_vector(text, self.rarity, self.axes))


def latent_vector(text: Column, rarity: np.ndarray, axes: np.ndarray) -> Column:
    """The text's weights along the axes, of unit length; all zero for a null text and one without words."""

    @F.arrow_udf("array<float>")
    def along(rows: pa.Array) -> pa.Array:
        found = sparse_rows(rows, rarity).times(axes)
        size = np.sqrt((found * found).sum(1, keepdims=True))
        values = np.where(size > 1e-12, found / np.maximum(size, 1e-12), 0.0).astype(np.float32).ravel()
        return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, axes.shape[1], dtype=np.int32), values)

    return along(word_hashes(F.coalesce(text, F.lit(""))))


def place_rarity(hashes: DataFrame, places: int = PLACES) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the place)) + 1 for every place, counted over all rows of ``hashes``."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros(places, np.int64), 0
        for batch in frame:
            rows = sparse_rows(batch.column("hashes"), np.ones(places))
            held += np.bincount(rows.place, minlength=places)
            texts += rows.n
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[texts, held[found]])], ["place", "n"])

    sums = hashes.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(sums.column("place").to_pylist(), sums.column("n").to_pylist(), strict=True))
    held = np.zeros(places)
    for place, n in counts.items():
        if place >= 0:
            held[place] = n
    return np.log((1 + counts.get(-1, 0)) / (1 + held)) + 1


def _sharpened(hashes: DataFrame, rarity: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The transposed rows times the rows times ``axes``, summed by blocks of places."""
    spark = hashes.sparkSession
    shared = spark.sparkContext.broadcast((rarity, axes))
    width = axes.shape[1]

    def parts(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rarity, own_axes = shared.value
        sums = np.zeros((len(own_rarity), width))
        for batch in frame:
            rows = sparse_rows(batch.column("hashes"), own_rarity)
            rows.add_transposed(rows.times(own_axes), sums)
        for block in range(0, len(sums), BLOCK):
            some = sums[block : block + BLOCK]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([some.tobytes()], pa.binary())], ["block", "sums"])

    def added(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in frame:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                some = np.frombuffer(sums).reshape(-1, width)
                held[block] = held[block] + some if block in held else some
        for block, some in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([some.tobytes()], pa.binary())], ["block", "sums"])

    schema = "block bigint, sums binary"
    total = hashes.mapInArrow(parts, schema).repartition("block").mapInArrow(added, schema).toArrow()
    sums = np.zeros(axes.shape)
    for block, some in zip(total.column("block").to_pylist(), total.column("sums").to_pylist(), strict=True):
        sums[block : block + BLOCK] = np.frombuffer(some).reshape(-1, width)
    shared.unpersist()
    return sums


def _gram(hashes: DataFrame, rarity: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The Gram matrix of all rows along ``axes``: one small matrix per task, added up by Spark."""
    shared = hashes.sparkSession.sparkContext.broadcast((rarity, axes))
    width = axes.shape[1]

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rarity, own_axes = shared.value
        gram = np.zeros((width, width))
        for batch in frame:
            found = sparse_rows(batch.column("hashes"), own_rarity).times(own_axes)
            gram += found.T @ found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(gram.ravel())], ["at", "x"])

    sums = hashes.mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros(width * width)
    gram[np.asarray(sums.column("at"))] = np.asarray(sums.column("x"))
    shared.unpersist()
    return gram.reshape(width, width)


def learn(texts: DataFrame, text_col: str, dim: int, places: int = PLACES, passes: int = PASSES, seed: int = 7) -> LatentModel:
    """Learn ``dim`` axes from every row of ``texts``; any dim from 1 to ``places``.

    Word hashes are written once and read in each of the ``passes`` + 2 passes. Null and empty texts add
    nothing. Without any word, or with fewer directions than ``dim``, the axes left over have a singular value
    of zero and are orthogonal to the others.
    """
    if not 1 <= dim <= places:
        raise ValueError(f"dim must be from 1 to {places}, got {dim}")
    spark = texts.sparkSession
    path = new_path(spark, "word-hashes")
    texts.select(word_hashes(F.coalesce(F.col(text_col), F.lit(""))).alias("hashes")).write.parquet(path)
    hashes = spark.read.schema("hashes array<binary>").parquet(path)
    rarity = place_rarity(hashes, places)
    width = min(dim + EXTRA, places)
    start = np.random.default_rng(seed).standard_normal((places, width))
    axes = np.linalg.qr(start)[0]
    for _ in range(passes):
        sums = _sharpened(hashes, rarity, axes)
        # a little of the last axes keeps full rank where the texts have fewer directions than axes
        axes = np.linalg.qr(sums + 1e-9 * max(1.0, float(np.abs(sums).max())) * axes)[0]
    values, turn = np.linalg.eigh(_gram(hashes, rarity, axes))
    order = np.argsort(-values, kind="stable")[:dim]
    found = axes @ turn[:, order]
    signs = np.sign(found[np.abs(found).argmax(0), np.arange(dim)])
    return LatentModel(rarity, (found * signs).astype(np.float32), np.sqrt(np.maximum(values[order], 0.0)))
