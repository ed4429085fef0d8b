"""Exact nearest-vector join of two large tables, pruned by pivots.

Every vector belongs to the nearest of a bounded number of pivots. A query is first answered by the vectors of
its nearest pivots, as many cells as hold k vectors; its k-th distance there bounds what is left to look at. In
the second round it is sent only to cells that can hold something nearer, by the triangle inequality on the
cell's smallest and largest pivot distance and by the hyperplane between the cell's pivot and the query's own.

A task holds one slot of a cell, at most about ``SLOT_NUMBERS`` numbers, and streams past it the queries sent
there, ``PART_QUERIES`` of them per part; a hot cell has many slots, and a slot asked by many queries is copied
once per part. There is no loop over queries, and neither table is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.operators.nearest import (
    _HITS, _ROUNDING, COSINE, L2_SQUARED, _Block, _columns, _matrix, _rough, _usable,
)
from shelfseek.operators.topk import top_k_per_group
from shelfseek.workspace import new_path

MAX_PIVOTS = 1024
SLOT_NUMBERS = 2_000_000
PART_QUERIES = 50_000
_QUERIES_PER_BLOCK = 256
_VECTORS_PER_STEP = 4096
_EPSILON = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Joined:
    """The hits, and how many copies of queries and of vectors were sent to find them."""

    hits: DataFrame
    query_copies: int
    vector_copies: int
    cells: int


def _points(vectors: np.ndarray, measure: str, of_query: bool) -> np.ndarray:
    """Points whose squared distance is the measure, or twice it for cosine.

    A zero vector has similarity 0 with everything, other zero vectors too: it gets an axis of its own.
    """
    values = vectors.astype(np.float64)
    if measure != COSINE:
        return values
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((values**2).sum(1))
        values = values / np.where(length == 0, 1.0, length)[:, None]
    zero = (length == 0).astype(np.float64)
    return np.column_stack([values, zero if of_query else 0 * zero, 0 * zero if of_query else zero])


@dataclass(frozen=True)
class _Pivots:
    points: np.ndarray
    squares: np.ndarray
    gaps: np.ndarray

    @staticmethod
    def of(points: np.ndarray) -> _Pivots:
        points = np.unique(points, axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (points**2).sum(1)
            square_gaps = squares[:, None] + squares - 2 * points @ points.T
            slack = _slack(points.shape[1], squares, squares)
            gaps = np.sqrt(np.maximum(square_gaps, 0) + slack[:, None])
        return _Pivots(points, squares, gaps)

    def squared(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance to every pivot, bound on its error)."""
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (points**2).sum(1)
            found = squares[:, None] + self.squares - 2 * points @ self.points.T
            return np.maximum(found, 0), _slack(points.shape[1], squares, self.squares)


def _slack(dim: int, squares: np.ndarray, pivot_squares: np.ndarray) -> np.ndarray:
    return 8 * (dim + 4) * _EPSILON * (squares + pivot_squares.max())


def _chosen(stored: DataFrame, dim: int, measure: str, pivots: int | None) -> _Pivots:
    """About sqrt(n) vectors, at most ``MAX_PIVOTS``: those with the smallest hash of their id."""
    wanted = pivots or min(MAX_PIVOTS, max(1, round(stored.count() ** 0.5)))
    first = stored.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("embedding").toArrow()
    table = _usable(first, dim)
    # Where none of those is a usable vector, any single point is as good a pivot.
    found = _matrix(table.column("embedding").combine_chunks(), dim) if table.num_rows else np.zeros((1, dim))
    return _Pivots.of(_points(found, measure, of_query=False))


def _assigned(stored: DataFrame, shared, dim: int, measure: str) -> DataFrame:
    """Every usable vector with its ``cell``, pivot distance ``away`` and the error bound of its square."""
    kind = stored.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: _Pivots = shared.value
        for batch in batches:
            batch = _usable(batch, dim)
            if batch.num_rows == 0:
                continue
            points = _points(_matrix(batch.column("embedding"), dim), measure, of_query=False)
            squared, slack = pivots.squared(points)
            cell = np.argmin(squared, axis=1)
            away = np.sqrt(squared[np.arange(len(cell)), cell])
            added = [pa.array(cell.astype(np.int32)), pa.array(away), pa.array(slack)]
            names = [*batch.schema.names, "cell", "away", "slack"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    schema = f"chunk_id bigint, product_id bigint, embedding {kind}, cell int, away double, slack double"
    return stored.mapInArrow(assign, schema)


@dataclass(frozen=True)
class _Cells:
    """Per pivot: its vectors, and the smallest and largest distance from it (NaN distances prune nothing)."""

    rows: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    slack: float

    @staticmethod
    def of(assigned: DataFrame, number: int) -> _Cells:
        found = assigned.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"),
            F.max("slack").alias("slack"),
        ).toArrow()
        rows = np.zeros(number, np.int64)
        near, far = np.zeros(number), np.zeros(number)
        cell, n, least, most, slack = _columns(found, "cell", "n", "least", "most", "slack")
        rows[cell], near[cell], far[cell] = n, least, most
        return _Cells(rows, near, far, float(slack.max()) if len(slack) else 0.0)


def _home(squared: np.ndarray, k: np.ndarray, cells: _Cells) -> np.ndarray:
    """Which cells each query asks first: its nearest ones, until they hold k vectors."""
    ranked = np.where(cells.rows == 0, np.inf, np.nan_to_num(squared, nan=1e308, posinf=1e308))
    order = np.argsort(ranked, axis=1, kind="stable")
    held = cells.rows[order]
    before = np.cumsum(held, axis=1) - held
    chosen = np.zeros(squared.shape, bool)
    np.put_along_axis(chosen, order, (before < k[:, None]) & (held > 0), axis=1)
    return chosen


def _possible(squared, slack, limit, pivots: _Pivots, cells: _Cells) -> np.ndarray:
    """Cells that may hold a vector within ``limit`` of the query; every doubt counts as yes."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        margin = np.sqrt(slack)[:, None] + cells.slack**0.5
        distance = np.sqrt(squared)
        reach = limit[:, None] + margin
        outside = (distance - cells.farthest > reach) | (cells.nearest - distance > reach)
        own = np.argmin(squared, axis=1)
        beyond = squared - np.take_along_axis(squared, own[:, None], axis=1)
        beyond -= 2 * (slack[:, None] + cells.slack)
        outside |= beyond / (2 * pivots.gaps[own]) > limit[:, None] * (1 + 1e-9)
    return ~outside & (cells.rows > 0)


def _routed(asked: DataFrame, shared, dim: int, measure: str, first: bool) -> DataFrame:
    """The queries with the ``targets`` they are sent to; in the second round those not asked before."""
    kind = asked.schema["embedding"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = shared.value
        for batch in batches:
            batch = _usable(batch, dim)
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                squared, slack = pivots.squared(_points(_matrix(part.column("embedding"), dim), measure, of_query=True))
                (k,) = _columns(part, "k")
                sent = _home(squared, k, cells)
                if not first:
                    (worst,) = _columns(part, "worst")
                    limit = np.sqrt(worst * (2 if measure == COSINE else 1) + 4 * _ROUNDING)
                    sent = _possible(squared, slack, limit, pivots, cells) & ~sent
                ends = np.concatenate([[0], np.cumsum(sent.sum(1))]).astype(np.int32)
                targets = pa.ListArray.from_arrays(ends, np.nonzero(sent)[1].astype(np.int32))
                names = ["query_id", "k", "embedding", "worst", "targets"]
                yield pa.RecordBatch.from_arrays([*[part.column(name) for name in names[:4]], targets], names=names)

    schema = f"query_id bigint, k int, embedding {kind}, worst double, targets array<int>"
    return asked.select("query_id", "k", "embedding", "worst").mapInArrow(route, schema)


_PLACED = "part bigint, is_query boolean, id bigint, product_id bigint, k int, worst double, embedding {}"


def _search_parts(placed: DataFrame, dim: int, measure: str) -> DataFrame:
    """The best hits of the queries of every part among the vectors of that part, which come first."""

    def answer(rows: pa.Table, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for start in range(0, rows.num_rows, _QUERIES_PER_BLOCK):
            table = rows.slice(start, _QUERIES_PER_BLOCK)
            block = _Block(table.rename_columns({"id": "query_id"}), dim, measure)
            # In the units of the block's own bounds, a rounding step above the k-th distance.
            worst = _columns(table, "worst")[0] + 2 * _ROUNDING
            block.worst = np.minimum(block.worst, worst * (2.0 if measure == COSINE else 1.0))
            for part in held:
                block.add(*part)
            yield block.result()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            part, is_query = (np.asarray(batch.column(name)) for name in ("part", "is_query"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if start == end:
                    continue
                if part[start] != current:
                    current, held = part[start], []
                rows = pa.Table.from_batches([batch.slice(start, end - start)])
                if is_query[start]:
                    yield from answer(rows, held)
                    continue
                for first in range(0, rows.num_rows, _VECTORS_PER_STEP):
                    some = rows.slice(first, _VECTORS_PER_STEP)
                    vectors = _matrix(some.column("embedding").combine_chunks(), dim).copy()
                    held.append((vectors, *_rough(vectors, measure), *[c.copy() for c in _columns(some, "id", "product_id")]))

    return placed.mapInArrow(search, _HITS)


def _round(
    assigned: DataFrame, routed: DataFrame, cells: _Cells, dim: int, measure: str
) -> tuple[DataFrame, int, int]:
    """(hits, copies of queries, copies of vectors) of one round; ``routed`` is a written table."""
    spark = assigned.sparkSession
    counts = routed.select(F.explode("targets").alias("cell")).groupBy("cell").count().toArrow()
    asked = np.zeros(len(cells.rows), np.int64)
    cell, n = _columns(counts, "cell", "count")
    asked[cell] = n
    slots = -(-cells.rows * dim // SLOT_NUMBERS)
    parts = -(-asked // PART_QUERIES)
    used = np.flatnonzero(slots * parts)
    first = np.concatenate([[0], np.cumsum(slots * parts)])
    # One row per pivot, so at most MAX_PIVOTS rows.
    plan = F.broadcast(
        spark.createDataFrame(
            [(int(c), int(first[c]), int(slots[c]), int(parts[c])) for c in used],
            "cell int, first bigint, slots bigint, parts bigint",
        )
    )
    kind = assigned.schema["embedding"].dataType.simpleString()
    spread = lambda of, over: F.pmod(F.xxhash64(of), F.col(over))
    each = lambda over: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(over) - 1))
    stored = assigned.join(plan, "cell").withColumn("nth", each("parts")).select(
        (F.col("first") + spread("chunk_id", "slots") * F.col("parts") + F.col("nth")).alias("part"),
        F.lit(False).alias("is_query"), F.col("chunk_id").alias("id"), "product_id", F.lit(0).alias("k"),
        F.lit(0.0).alias("worst"), "embedding",
    )
    sent = routed.withColumn("cell", F.explode("targets")).join(plan, "cell").withColumn("slot", each("slots")).select(
        (F.col("first") + F.col("slot") * F.col("parts") + spread("query_id", "parts")).alias("part"),
        F.lit(True).alias("is_query"), F.col("query_id").alias("id"), F.lit(0).cast("bigint").alias("product_id"),
        "k", "worst", F.col("embedding").cast(kind).alias("embedding"),
    )
    placed = stored.unionByName(sent).repartition("part").sortWithinPartitions("part", "is_query")
    return _search_parts(placed, dim, measure), int((asked * slots).sum()), int((cells.rows * parts).sum())


def _narrower(vectors: DataFrame, queries: DataFrame) -> str:
    kinds = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)}
    return "array<float>" if kinds == {"array<float>"} else "array<double>"


def nearest_join(
    vectors: DataFrame, queries: DataFrame, dim: int, measure: str = L2_SQUARED, pivots: int | None = None
) -> Joined:
    """The k nearest vectors of every query, as ``nearest`` returns them, for any number of queries.

    Same rules: ties go to the smaller chunk_id, distances are compared at nine decimals, vectors or queries
    that are null, of another length or not finite are left out, and so are queries with k below 1. A query_id
    stands for one query. Vectors whose squares overflow prune nothing but are found.
    """
    spark = vectors.sparkSession
    kind = _narrower(vectors, queries)
    stored = vectors.select(
        *[F.col(name).cast("bigint").alias(name) for name in ("chunk_id", "product_id")],
        F.col("embedding").cast(kind).alias("embedding"),
    ).where(F.size("embedding") == dim)
    asked = queries.where(F.col("k") >= 1).select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("k").cast("int").alias("k"),
        F.col("embedding").cast(kind).alias("embedding"), F.lit(float("inf")).alias("worst"),
    ).where(F.size("embedding") == dim)

    def written(df: DataFrame, label: str) -> DataFrame:
        path = new_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    chosen = _chosen(stored, dim, measure, pivots)
    assigned = written(_assigned(stored, spark.sparkContext.broadcast(chosen), dim, measure), "pivot-cells")
    cells = _Cells.of(assigned, len(chosen.points))
    shared = spark.sparkContext.broadcast((chosen, cells))
    near = written(_routed(asked, shared, dim, measure, first=True), "near-cells")
    hits, sent, copied = _round(assigned, near, cells, dim, measure)
    largest = near.agg(F.max("k")).first()[0] or 1
    hits = written(_top_k(hits, largest), "near-hits")

    limits = hits.where("rank = k").select("query_id", F.col("distance").alias("worst"))
    bounded = near.drop("worst", "targets").join(limits, "query_id", "left").withColumn(
        "worst", F.coalesce("worst", F.lit(float("inf")))
    )
    far = written(_routed(bounded, shared, dim, measure, first=False), "far-cells")
    more, sent_on, copied_on = _round(assigned, far, cells, dim, measure)
    found = _top_k(hits.drop("rank").unionByName(more), largest).drop("k")
    return Joined(found, sent + sent_on, copied + copied_on, int((cells.rows > 0).sum()))


def _top_k(hits: DataFrame, largest: int) -> DataFrame:
    """The first k hits of every query; k may differ from query to query, ``largest`` is the largest."""
    ranked = top_k_per_group(hits, ["query_id"], ["distance", "chunk_id"], largest)
    return ranked.where(F.col("rank") <= F.col("k"))
