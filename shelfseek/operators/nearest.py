"""Exact nearest-vector search for a table of queries.

``vectors`` has (chunk_id, product_id, embedding), ``queries`` has (query_id, k, embedding). Each task
scores its vectors block by block and keeps only the best k per query, so what is shuffled is the k best
of every task and never the product of the two tables.

Queries that fit one block are broadcast, so the vectors are never shuffled. More queries than that are joined
by pivots, see ``pivots.nearest_join``. Only queries that probe cells, and few queries that ask for very many
hits, come in several blocks, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.operators.topk import top_k_per_group

L2_SQUARED = "l2_squared"
COSINE = "cosine"

MAX_BROADCAST_NUMBERS = 8_000_000
MAX_KEPT_ROWS = 1_000_000
_QUERIES_PER_BLOCK = 256
# What a task scores at once, however large its batches are: rows, and pairs that are scored exactly.
_ROWS_PER_STEP = 4096
_PAIRS_PER_STEP = 10_000
# Distances are ranked at this resolution, so that the order of summation cannot change a result.
_DECIMALS = 9
# Bounds on the error of a single-precision distance, relative to the squared lengths, and of rounding.
_ROUGH_ERROR = 1e-4
_ROUNDING = 1e-8
# Squared lengths beyond this may overflow in single precision.
_LARGE = 1e37
_MANY = 8

_HITS = "query_id bigint, k int, chunk_id bigint, product_id bigint, distance double"
_HITS_SCHEMA = pa.schema(
    [
        ("query_id", pa.int64()), ("k", pa.int32()), ("chunk_id", pa.int64()), ("product_id", pa.int64()),
        ("distance", pa.float64()),
    ]
)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _usable(table, dim: int):
    """The rows whose vector is not null, has ``dim`` items and only finite ones."""
    column = table.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    if not pc.all(right).as_py():
        table, column = table.filter(right), column.filter(right)
    if len(column) == 0:
        return table
    finite = np.isfinite(_matrix(column, dim)).all(axis=1)
    return table if finite.all() else table.filter(pa.array(finite))


def _columns(table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(name)) for name in names]


def _rough(vectors: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision vectors and squares whose distance |q|^2 + |v|^2 - 2qv ranks like the measure.

    With the cosine measure that distance is twice one minus the similarity; counting every square as 1
    makes this hold for zero vectors too, whose similarity is 0.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (vectors.astype(np.float64) ** 2).sum(1)
        if measure == COSINE:
            lengths = np.sqrt(np.where(squares == 0, 1.0, squares))
            return (vectors / lengths[:, None]).astype(np.float32), np.ones(len(vectors), np.float32)
        return vectors.astype(np.float32), squares.astype(np.float32)


class _Block:
    """Some of the queries and, as flat arrays, the best rows seen for them in one task."""

    def __init__(self, table: pa.Table, dim: int, measure: str):
        self.ids, self.k = _columns(table, "query_id", "k")
        self.vectors = _matrix(table.column("embedding").combine_chunks(), dim).astype(np.float64)
        self.probing: dict[int, list[int]] = {}
        if "cells" in table.column_names:
            for query, cells in enumerate(table.column("cells").to_pylist()):
                for cell in cells or ():
                    self.probing.setdefault(cell, []).append(query)
        self.measure = measure
        self.rough, self.squares = _rough(self.vectors, measure)
        self.rough_error = max(_ROUGH_ERROR, 2e-7 * dim)
        self.query, self.chunk, self.product = (np.empty(0, np.int64) for _ in range(3))
        self.distance = np.empty(0)
        self.worst = np.full(len(self.ids), np.inf)

    def add(self, vectors, rough, squares, chunk, product, cell=None) -> None:
        """Score rows, of one ``cell`` if given: then only the queries that probe it take part."""
        asked = None if cell is None else np.array(self.probing.get(cell, []), np.int64)
        if asked is not None and not len(asked):
            return
        q, v = self._candidates(rough, squares, slice(None) if asked is None else asked)
        if len(q):
            q = q if asked is None else asked[q]
            self._merge(q, self._exact(q, v, vectors), chunk[v], product[v])

    def _candidates(self, rough, squares, asked) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may enter the best k: all whose lower bound is within the k-th best upper bound."""
        own_squares, worst, wanted = self.squares[asked], self.worst[asked], self.k[asked]
        with np.errstate(over="ignore", invalid="ignore"):
            lower = (own_squares[:, None] + squares) * np.float32(1 - self.rough_error)
            lower -= 2.0 * (self.rough[asked] @ rough.T)
            error = 2 * self.rough_error * (own_squares + squares.max())
        if max(own_squares.max(), squares.max()) > _LARGE:
            lower[~np.isfinite(lower)] = -np.inf
        possible = lower <= (worst + _ROUNDING)[:, None]
        k = int(wanted.max())
        if k < lower.shape[1] and possible.sum() > _MANY * wanted.sum():
            limit = np.minimum(worst, np.partition(lower, k - 1, axis=1)[:, k - 1] + error)
            possible = lower <= (limit + _ROUNDING)[:, None]
        return np.divmod(np.flatnonzero(possible), lower.shape[1])

    def _exact(self, q: np.ndarray, v: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        steps = []
        for start in range(0, len(q), _PAIRS_PER_STEP):
            a = self.vectors[q[start : start + _PAIRS_PER_STEP]]
            b = vectors[v[start : start + _PAIRS_PER_STEP]].astype(np.float64)
            if self.measure == COSINE:
                norms = np.sqrt((a**2).sum(1) * (b**2).sum(1))
                steps.append(1.0 - (a * b).sum(1) / np.where(norms == 0, np.inf, norms))
            else:
                steps.append(((a - b) ** 2).sum(1))
        return np.round(np.concatenate(steps), _DECIMALS) + 0.0

    def _merge(self, q, distance, chunk, product) -> None:
        query = np.concatenate([self.query, q])
        distance = np.concatenate([self.distance, distance])
        chunk = np.concatenate([self.chunk, chunk])
        product = np.concatenate([self.product, product])
        order = np.lexsort((chunk, distance, query))
        query, distance, chunk, product = (a[order] for a in (query, distance, chunk, product))
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.ids)))[query]
        kept, last = place < self.k[query], place == self.k[query] - 1
        self.worst[query[last]] = distance[last] * (2.0 if self.measure == COSINE else 1.0)
        self.query, self.distance = query[kept], distance[kept]
        self.chunk, self.product = chunk[kept], product[kept]

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "query_id": self.ids[self.query].astype(np.int64),
                "k": self.k[self.query].astype(np.int32),
                "chunk_id": self.chunk,
                "product_id": self.product,
                "distance": self.distance,
            }
        )


def _scan(batches, queries: pa.Table, dim: int, measure: str) -> Iterator[pa.RecordBatch]:
    """The best rows of all ``batches`` for every query, one block of queries at a time."""
    cuts = range(0, queries.num_rows, _QUERIES_PER_BLOCK)
    blocks = [_Block(queries.slice(cut, _QUERIES_PER_BLOCK), dim, measure) for cut in cuts]
    parts = (batch.slice(start, _ROWS_PER_STEP) for batch in batches for start in range(0, batch.num_rows, _ROWS_PER_STEP))
    for batch in parts:
        batch = _usable(batch, dim)
        if batch.num_rows == 0:
            continue
        chunk, product = _columns(batch, "chunk_id", "product_id")
        cell = _columns(batch, "cell")[0] if "cell" in batch.schema.names else None
        vectors = _matrix(batch.column("embedding"), dim)
        rough, squares = _rough(vectors, measure)
        if cell is None:
            for block in blocks:
                block.add(vectors, rough, squares, chunk, product)
            continue
        for one in np.unique(cell):
            rows = np.flatnonzero(cell == one)
            part = [column[rows] for column in (vectors, rough, squares, chunk, product)]
            for block in blocks:
                block.add(*part, int(one))
    return (block.result() for block in blocks)


def _broadcast_search(vectors: DataFrame, table: pa.Table, dim: int, measure: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(table)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(batches, shared.value, dim, measure)

    return vectors.mapInArrow(search, _HITS)


def query_blocks(asked: DataFrame, dim: int, most: int, first: pa.Table | None = None) -> Iterator[pa.Table]:
    """The queries as tables of about ``most`` rows that ask for about ``MAX_KEPT_ROWS`` hits in sum.

    A single query may ask for more; it then keeps as many hits in a task as the task has vectors. ``first`` are
    the first ``most`` + 1 queries, if they have been read already.
    """
    table = asked.limit(most + 1).toArrow() if first is None else first
    if table.num_rows <= most and np.asarray(table.column("k")).sum() <= MAX_KEPT_ROWS:
        yield _usable(table, dim)
        return
    capped = F.least(F.col("k"), F.lit(MAX_KEPT_ROWS))
    n, kept = asked.agg(F.count(F.lit(1)), F.sum(capped)).first()
    number = max(-(-n // max(1, most // 2)), -(-kept // max(1, MAX_KEPT_ROWS // 2)))
    for block in range(number):
        yield _usable(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == block).toArrow(), dim)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    dim: int,
    measure: str = L2_SQUARED,
    max_broadcast_numbers: int = MAX_BROADCAST_NUMBERS,
) -> DataFrame:
    """The k nearest vectors of every query: (query_id, chunk_id, product_id, distance, rank).

    Ties go to the smaller chunk_id, fewer than k vectors give fewer rows, and vectors or queries that
    are null, of another length or not finite are left out. With the cosine measure ``distance`` is
    one minus the similarity. Optional columns ``cell`` (vectors) and ``cells`` (queries) restrict each
    query to the vectors of its cells.
    """
    stored = vectors.select(
        *[F.col(name).cast("bigint").alias(name) for name in ("chunk_id", "product_id")],
        "embedding",
        *[c for c in ("cell",) if c in vectors.columns],
    )
    asked = queries.where(F.col("k") >= 1).select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.col("k").cast("int").alias("k"),
        "embedding",
        *[c for c in ("cells",) if c in queries.columns],
    )
    asked = asked.where(F.size("embedding") == dim)
    found = None
    most = max(1, max_broadcast_numbers // dim)
    first = asked.limit(most + 1).toArrow()
    if first.num_rows > most and "cells" not in asked.columns:
        from shelfseek.operators.pivots import nearest_join

        return nearest_join(vectors, queries, dim, measure).hits
    for table in query_blocks(asked, dim, most, first):
        if table.num_rows == 0:
            continue
        hits = _broadcast_search(stored, table, dim, measure)
        k_max = int(np.asarray(table.column("k")).max())
        ranked = top_k_per_group(hits, ["query_id"], ["distance", "chunk_id"], k_max)
        ranked = ranked.where(F.col("rank") <= F.col("k")).drop("k")
        if np.asarray(table.column("k")).sum() <= MAX_KEPT_ROWS:
            # So few narrow rows that whatever large table they are joined with need not move.
            ranked = F.broadcast(ranked)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id bigint, chunk_id bigint, product_id bigint, distance double, rank int"
        )
    return found
