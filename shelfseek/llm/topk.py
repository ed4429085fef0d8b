"""Exact top-k search by distributed histogram selection.

Every task scores all its vectors against a block of queries. The k-th best score of each query is located by
refining a global histogram: round after round, the range that must hold it is cut into ``BUCKETS`` parts, the
tasks count their scores per part, and the part where the counts from the top reach k becomes the next range,
until it is one score. Then all better rows and, of the rows that tie with it, the smallest ids are kept.

A task reports counts from its best part down to where it has seen k rows by itself, as nothing below can be
the k-th best; so what is shuffled is about k numbers for each query and task, before it is added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of

SCALE = 1024
BUCKETS = 128
#: Most queries of a block; their vectors are broadcast.
BLOCK = 1024
_ROWS = 2048
_EXACT = 2.0**53
#: Scores are kept within this, so that the range of all of them fits 64 bits.
MOST = 2**62 - 1


def whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every item, in double precision."""
    items = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return np.floor(items * scale)


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; one beyond ``MOST`` in size counts as ``MOST`` of its sign.

    Products below 2**53 are exact in double precision, in any order of summation. The pairs whose sums may
    be larger are multiplied as Python integers.
    """
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    longest = [np.abs(rows).max(axis=1) for rows in (queries, vectors)]
    with np.errstate(over="ignore", invalid="ignore"):
        large = longest[0][:, None] * longest[1] * queries.shape[1] >= _EXACT
        if not large.any():
            return (queries @ vectors.T).astype(np.int64)
        found = np.where(large, 0.0, queries @ vectors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    for place in np.flatnonzero(large.any(axis=0)).tolist():
        rows = np.flatnonzero(large[:, place])
        exact = whole(queries[rows]) @ whole(vectors[place])
        found[rows, place] = [max(-MOST, min(MOST, score)) for score in exact.tolist()]
    return found


def _valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))


class _Queries:
    """A block of queries with, for each, the range [low, high] that holds its k-th best score."""

    def __init__(self, table: pa.Table, dim: int, scale: int, k: int):
        table = table.sort_by("vec_id")
        self.ids, self.k = np.asarray(table.column("vec_id")), k
        self.vectors = whole_numbers(table.column("embedding").combine_chunks(), dim, scale)
        self.low = np.full(len(self.ids), np.iinfo(np.int64).min // 4)
        self.high = np.full(len(self.ids), np.iinfo(np.int64).max // 4)
        self.above = np.zeros(len(self.ids), np.int64)

    def width(self) -> np.ndarray:
        return -(-(self.high - self.low + 1) // BUCKETS)

    def open(self) -> np.ndarray:
        return np.flatnonzero(self.low < self.high)

    def narrow(self, counts: dict[tuple[int, int], int]) -> None:
        """Go to the part where the counts, from the top, reach k; to the lowest one if they never do."""
        width = self.width()
        parts: dict[int, list[tuple[int, int]]] = {}
        for (query, part), n in counts.items():
            parts.setdefault(query, []).append((part, n))
        for query in self.open().tolist():
            for part, n in sorted(parts.get(query, []), reverse=True):
                if self.above[query] + n >= self.k:
                    base = self.low[query] + part * width[query]
                    self.high[query] = min(self.high[query], base + width[query] - 1)
                    self.low[query] = base
                    break
                self.above[query] += n
            else:  # fewer than k rows: all of them are wanted
                self.high[query] = self.low[query]


def _batches(frame: Iterator[pa.RecordBatch], dim: int, scale: int, queries: _Queries):
    for batch in batches_of(frame):
        for cut in range(0, batch.num_rows, _ROWS):
            some = batch.slice(cut, _ROWS)
            ids = np.asarray(some.column("vec_id"))
            scores = scores_of(queries.vectors, whole_numbers(some.column("embedding"), dim, scale))
            yield ids, scores, queries.ids[:, None] != ids[None, :]


def _bounds(vectors: DataFrame, queries: _Queries, dim: int, scale: int) -> None:
    """Start from ranges that hold every score: products of the largest lengths."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    longest = vectors.select(F.max(F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.nan_to_num(np.sqrt((queries.vectors**2).sum(1)) * (longest or 0.0) * (1 + 1e-9) + 1, nan=np.inf)
    queries.high = np.where(most < 2.0**61, most, 0.0).astype(np.int64) + np.where(most < 2.0**61, 0, MOST)
    queries.low = -queries.high


def _counts(vectors: DataFrame, queries: _Queries, dim: int, scale: int) -> dict[tuple[int, int], int]:
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        active, width, k = block.open(), block.width(), block.k
        counts = np.zeros((len(active), BUCKETS), np.int64)
        rows = np.arange(len(active))[:, None]
        for _, scores, other in _batches(frame, dim, scale, block):
            own = scores[active]
            inside = other[active] & (own >= block.low[active, None]) & (own <= block.high[active, None])
            parts = (own - block.low[active, None]) // width[active, None]
            keys = (rows * BUCKETS + parts)[inside]
            counts += np.bincount(keys, minlength=counts.size).reshape(counts.shape)
        # from the top: what this task has in better parts; at k and more nothing below matters
        better = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        query, part = np.nonzero((counts > 0) & (better < k))
        arrays = [pa.array(active[query].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(counts[query, part])]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "part", "n"])

    found = vectors.mapInArrow(run, "query int, part int, n bigint")
    sums = found.groupBy("query", "part").agg(F.sum("n").alias("n")).toArrow()  # BLOCK * BUCKETS rows at most
    columns = [sums.column(name).to_pylist() for name in ("query", "part", "n")]
    return {(query, part): n for query, part, n in zip(*columns, strict=True)}


def _selected(vectors: DataFrame, queries: _Queries, dim: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): from every task, its rows at or above the k-th best, its k best at most."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        query, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for vec, found, other in _batches(frame, dim, scale, block):
            q, v = np.nonzero(other & (found >= block.low[:, None]))
            query, ids = np.concatenate([query, q]), np.concatenate([ids, vec[v]])
            scores = np.concatenate([scores, found[q, v]])
            order = np.lexsort((ids, -scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, ids, scores = (x[place < block.k] for x in (query, ids, scores))
        arrays = [pa.array(block.ids[query]), pa.array(ids), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _search_block(vectors: DataFrame, table: pa.Table, dim: int, k: int, scale: int) -> DataFrame:
    queries = _Queries(table, dim, scale, k)
    _bounds(vectors, queries, dim, scale)
    while len(queries.open()):
        queries.narrow(_counts(vectors, queries, dim, scale))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = _selected(vectors, queries, dim, scale).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` best rows of ``vectors``, or all if fewer.

    Both tables have vec_id and embedding. An item x counts as floor(scale * x), the score is the whole inner
    product, ties go to the smaller vec_id. Rows with the query's own vec_id are no candidates. Rows without
    a vec_id, and vectors that are null, empty or hold null or non-finite items, take no part; a query meets
    vectors of its own length only. Repeated candidate rows are ranked as often as they occur, repeated
    queries once. A score beyond 2**62 - 1 in size counts as that number: finite vectors of any size take part. Queries are searched in blocks of bounded size, one after the other.
    """
    spark = vectors.sparkSession
    result = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def usable(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")
        return _valid(named)

    stored, asked = usable(vectors), usable(queries)
    sizes = asked.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect()
    for dim, n in sizes:
        own = stored.where(F.size("embedding") == dim)
        same = asked.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        blocks = -(-n // (BLOCK // 2)) if n > BLOCK else 1
        for block in range(blocks):
            part = same.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
            table = part.toArrow()  # about BLOCK / 2 rows, by hash
            if table.num_rows:
                result = result.unionByName(_search_block(own, table, dim, k, scale))
    return result
