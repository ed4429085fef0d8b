"""Approximate search over compressed cells: product quantisation of what is left of a vector beside its cell's centre.

Every vector belongs to its nearest centre; the difference to it is cut into parts, and each part is stored as
the number of the nearest entry of that part's codebook, one byte. A search adds up, for each vector of the
probed cells, one table entry per part: the distance between the query's part and the codebook's entry. The best
of these estimates, ``SHORTLIST`` for every hit asked for, are then compared exactly.

Codes and vectors lie in one table, sorted by cell: the estimates read the narrow columns only, the exact
comparison reads the vectors of the short list's cells, and parquet statistics leave the other cells out. Centres
and codebooks are learned from a bounded sample; every usable vector is stored, found and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.functions import vectors as V
from shelfseek.operators.nearest import COSINE, L2_SQUARED, MAX_BROADCAST_NUMBERS, MAX_KEPT_ROWS, query_blocks
from shelfseek.operators.topk import top_k_per_group
from shelfseek.workspace import new_path

#: Vectors that centres and codebooks are learned from, at most; the smallest hashes of the ids choose them.
SAMPLE = 1 << 15
#: Rounds of k-means over the sample.
ROUNDS = 8
#: Numbers of a vector that share a code, and entries of a codebook.
WIDTH, ENTRIES = 4, 256
#: Estimated hits that are compared exactly, for each hit asked for.
SHORTLIST = 20
#: Share of the cells that a query looks into, and the least number of cells, if it does not say how many.
PROBED_SHARE, LEAST_PROBED = 1 / 32, 8
_ROWS, _QUERIES = 4096, 256
# Distances to centres and estimates are compared at this resolution; ties go to the smaller number.
_DECIMALS, _NEAR = 9, 1e-9


@dataclass(frozen=True)
class Codebook:
    """Centres (cells x dim) and, for each part of a vector, its entries (parts x entries x width)."""

    centres: np.ndarray
    entries: np.ndarray

    def parts_of(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into parts, with zeros behind the last number."""
        parts, _, width = self.entries.shape
        full = np.zeros((len(rows), parts * width))
        full[:, : rows.shape[1]] = rows
        return full.reshape(len(rows), parts, width)

    def cells_of(self, rows: np.ndarray, number: int = 1) -> np.ndarray:
        """The ``number`` nearest cells of each row, nearest first."""
        found = []
        for cut in range(0, len(rows), _ROWS):
            distance = _distances(rows[cut : cut + _ROWS], self.centres)
            if number == 1:
                least = distance.min(axis=1, keepdims=True)
                found.append((distance <= least + _NEAR).argmax(axis=1)[:, None])
            else:
                found.append(np.argsort(np.round(distance, _DECIMALS), axis=1, kind="stable")[:, :number])
        return np.concatenate(found) if found else np.empty((0, number), np.int64)

    def codes_of(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """One byte per part: the nearest entry to what is left of a row beside its centre."""
        left = self.parts_of(rows - self.centres[cells])
        codes = [_distances(left[:, part], entries).argmin(axis=1) for part, entries in enumerate(self.entries)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of each query's parts, beside the cell's centre, to all entries."""
        left = self.parts_of(queries - self.centres[cell])
        return ((left[:, :, None, :] - self.entries) ** 2).sum(axis=3)


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    squares = rows @ (-2.0 * others.T)
    squares += (rows**2).sum(1)[:, None]
    squares += (others**2).sum(1)
    return squares


def _k_means(rows: np.ndarray, number: int, seed: int) -> np.ndarray:
    """``number`` centres of the rows, fewer if there are not so many rows."""
    centres = rows[np.sort(np.random.default_rng(seed).permutation(len(rows))[:number])]
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(rows[cut : cut + _ROWS], centres).argmin(1) for cut in range(0, len(rows), _ROWS)])
        order = np.argsort(own, kind="stable")
        held, starts, sizes = np.unique(own[order], return_index=True, return_counts=True)
        centres = centres.copy()
        centres[held] = np.add.reduceat(rows[order], starts) / sizes[:, None]
    return centres


def _units(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, measure: str) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return _units(rows) if measure == COSINE else rows


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(V.is_valid(F.col("embedding"), dim))


def first_vectors(vectors: DataFrame, dim: int, number: int, measure: str = L2_SQUARED) -> np.ndarray:
    """``number`` usable vectors, in order of the md5 of their ids. Only these reach the driver."""
    chosen = _usable(vectors, dim).orderBy(F.md5(F.col("chunk_id").cast("string")), "chunk_id").limit(number)
    table = chosen.select("embedding").toArrow()
    return _matrix(table.column("embedding"), dim, measure) if table.num_rows else np.empty((0, dim))


def learn(vectors: DataFrame, dim: int, cells: int | None = None, measure: str = L2_SQUARED, seed: int = 7) -> Codebook:
    """Centres and codebooks from at most ``SAMPLE`` vectors; as many cells as the square root of all, if not given.

    ``cells`` is kept at an eighth of the sample, so that every centre is learned from several vectors.
    """
    rows = first_vectors(vectors, dim, SAMPLE, measure)
    number = cells or round(vectors.count() ** 0.5)
    parts = -(-dim // WIDTH)
    if not len(rows):
        return Codebook(np.zeros((1, dim)), np.zeros((parts, 1, WIDTH)))
    centres = _k_means(rows, max(1, min(number, max(1, len(rows) // 8))), seed)
    book = Codebook(centres, np.zeros((parts, 1, WIDTH)))
    left = book.parts_of(rows - centres[book.cells_of(rows)[:, 0]])
    entries = np.zeros((parts, ENTRIES, WIDTH))
    for part in range(parts):
        own = _k_means(left[:, part], ENTRIES, seed + part)
        entries[part] = own[np.minimum(np.arange(ENTRIES), len(own) - 1)]  # a repeated entry is never the nearest
    return Codebook(centres, entries)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row as one binary value."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of a column of binary values of one size."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][ends[0] : ends[-1]], kind).reshape(len(column), -1)


@dataclass(frozen=True)
class CompressedIndex:
    path: str
    codebook: Codebook
    dim: int
    measure: str


def write_compressed(vectors: DataFrame, codebook: Codebook, dim: int, measure: str = L2_SQUARED) -> CompressedIndex:
    """Write all usable vectors with their cells and codes, sorted by cell, and the codebook.

    Ranges of (cell, chunk_id) are dealt to the writers, so a cell with very many vectors becomes many files.
    """
    spark = vectors.sparkSession
    path = new_path(spark, "compressed")
    shared = spark.sparkContext.broadcast(codebook)
    rows = _usable(vectors, dim).select(
        F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("product_id").cast("bigint").alias("product_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            if batch.num_rows:
                numbers = _matrix(batch.column("embedding"), dim, L2_SQUARED)
                matrix = _units(numbers) if measure == COSINE else numbers
                cells = book.cells_of(matrix)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), batch.column("product_id"), _packed(numbers.astype("<f4")),
                     pa.array(cells.astype(np.int32)), _packed(book.codes_of(matrix, cells))],
                    ["chunk_id", "product_id", "numbers", "cell", "codes"],
                )

    coded = rows.mapInArrow(encode, "chunk_id bigint, product_id bigint, numbers binary, cell int, codes binary")
    coded.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
    centres = [(0, cell, -1, row.tolist()) for cell, row in enumerate(codebook.centres)]
    entries = [(1, i, j, row.tolist()) for i, part in enumerate(codebook.entries) for j, row in enumerate(part)]
    book = spark.createDataFrame([*centres, *entries], "kind int, first int, second int, numbers array<double>")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    return CompressedIndex(path, codebook, dim, measure)


def open_compressed(spark: SparkSession, path: str, dim: int, measure: str = L2_SQUARED) -> CompressedIndex:
    """An index that was written before."""
    rows = spark.read.parquet(f"{path}/codebook").orderBy("kind", "first", "second").collect()
    centres = np.array([row.numbers for row in rows if row.kind == 0])
    entries = [row for row in rows if row.kind == 1]
    parts = 1 + max(row.first for row in entries)
    book = np.array([row.numbers for row in entries]).reshape(parts, len(entries) // parts, -1)
    return CompressedIndex(path, Codebook(centres, book), dim, measure)


class _Best:
    """The best estimates seen in one task, as flat arrays; ``wanted`` for each query."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, self.worst = wanted, np.full(len(wanted), np.inf)
        self.rows = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]

    def add(self, query: np.ndarray, estimate: np.ndarray, chunk: np.ndarray, cell: np.ndarray) -> None:
        query, estimate, chunk, cell = (np.concatenate(pair) for pair in zip(self.rows, (query, estimate, chunk, cell)))
        order = np.lexsort((chunk, estimate, query))
        query, estimate, chunk, cell = (column[order] for column in (query, estimate, chunk, cell))
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.wanted)))[query]
        last = place == self.wanted[query] - 1
        self.worst[query[last]] = estimate[last]
        kept = place < self.wanted[query]
        self.rows = [column[kept] for column in (query, estimate, chunk, cell)]


def _estimates(index: CompressedIndex, stored: DataFrame, table: pa.Table, probes: int, shortlist: int) -> DataFrame:
    """(query_id, chunk_id, cell, estimate): each task's best estimates for a block of queries."""
    matrix = _matrix(table.column("embedding"), index.dim, index.measure)
    probed = index.codebook.cells_of(matrix, probes)
    order = np.argsort(probed.ravel(), kind="stable")
    cells, starts = np.unique(probed.ravel()[order], return_index=True)
    asking = dict(zip(cells.tolist(), np.split(order // probes, starts[1:])))
    wanted = np.asarray(table.column("k")).astype(np.int64) * shortlist
    shared = stored.sparkSession.sparkContext.broadcast((index.codebook, matrix, asking, wanted, np.asarray(table.column("query_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, queries, asking, wanted, ids = shared.value
        best = _Best(wanted)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, chunk = np.asarray(batch.column("cell")), np.asarray(batch.column("chunk_id"))
            codes = _unpacked(batch.column("codes"), "u1")
            found = []
            for one in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == one)
                asked = asking.get(one, np.empty(0, np.int64))
                for cut in range(0, len(asked), _QUERIES):
                    some = asked[cut : cut + _QUERIES]
                    tables = book.tables(queries[some], one)
                    total = np.zeros((len(some), len(rows)))
                    for part in range(codes.shape[1]):
                        total += tables[:, part][:, codes[rows, part]]
                    total = np.round(total, _DECIMALS)
                    q, v = np.nonzero(total <= best.worst[some][:, None])
                    found.append((some[q], total[q, v], chunk[rows[v]], cell[rows[v]].astype(np.int64)))
            if found:
                best.add(*(np.concatenate(column) for column in zip(*found)))
        query, estimate, chunk, cell = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query].astype(np.int64)), pa.array((wanted[query]).astype(np.int64)), pa.array(chunk),
             pa.array(cell.astype(np.int32)), pa.array(estimate)], ["query_id", "wanted", "chunk_id", "cell", "estimate"],
        )

    read = stored.where(F.col("cell").isin(cells.tolist())) if len(cells) < len(index.codebook.centres) else stored
    hits = read.select("chunk_id", "cell", "codes").mapInArrow(
        run, "query_id bigint, wanted bigint, chunk_id bigint, cell int, estimate double"
    )
    ranked = top_k_per_group(hits, ["query_id"], ["estimate", "chunk_id"], int(wanted.max()), "nth")
    return ranked.where(F.col("nth") <= F.col("wanted")).select("query_id", "chunk_id", "cell")


def _compared(index: CompressedIndex, pairs: DataFrame, table: pa.Table) -> DataFrame:
    """(query_id, k, chunk_id, product_id, distance) of (query_id, chunk_id, product_id, numbers), exactly."""
    table = table.sort_by("query_id")
    queries = _matrix(table.column("embedding"), index.dim, L2_SQUARED)
    shared = pairs.sparkSession.sparkContext.broadcast((queries, *(np.asarray(table.column(name)) for name in ("query_id", "k"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, k = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.searchsorted(ids, np.asarray(batch.column("query_id")))
            a, b = queries[place], _unpacked(batch.column("numbers"), "<f4").astype(np.float64)
            if index.measure == COSINE:
                norms = np.sqrt((a**2).sum(1) * (b**2).sum(1))
                distance = 1.0 - (a * b).sum(1) / np.where(norms == 0, np.inf, norms)
            else:
                distance = ((a - b) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array(k[place].astype(np.int32)), batch.column("chunk_id"),
                 batch.column("product_id"), pa.array(np.round(distance, _DECIMALS) + 0.0)],
                ["query_id", "k", "chunk_id", "product_id", "distance"],
            )

    return pairs.mapInArrow(run, "query_id bigint, k int, chunk_id bigint, product_id bigint, distance double")


def search_compressed(
    index: CompressedIndex, queries: DataFrame, probes: int | None = None, shortlist: int = SHORTLIST,
    max_broadcast_numbers: int = MAX_BROADCAST_NUMBERS,
) -> DataFrame:
    """(query_id, chunk_id, product_id, distance, rank): up to k hits per query, from its ``probes`` nearest cells.

    ``queries`` has (query_id, k, embedding). Distances are exact; with all cells probed and a short list of all
    vectors the result is exact too. Ties go to the smaller chunk_id. Queries that are null, of another length or
    not finite, and those with k below 1, get no rows. Queries are broadcast in blocks of bounded size.
    """
    spark = queries.sparkSession
    stored = spark.read.parquet(f"{index.path}/vectors")
    cells = len(index.codebook.centres)
    number = min(cells, probes or max(LEAST_PROBED, round(cells * PROBED_SHARE)))
    asked = _usable(queries.where("k >= 1"), index.dim).select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("k").cast("int").alias("k"), "embedding"
    )
    found = None
    for table in query_blocks(asked, index.dim, max(1, max_broadcast_numbers // index.dim)):
        if not table.num_rows:
            continue
        short = _estimates(index, stored, table, number, shortlist)
        if int(np.asarray(table.column("k")).sum()) * shortlist <= MAX_KEPT_ROWS:
            short = F.broadcast(short)  # few narrow rows, so the vectors need not move
        pairs = stored.select("chunk_id", "product_id", "cell", "numbers").join(short, ["cell", "chunk_id"])
        exact = _compared(index, pairs.select("query_id", "chunk_id", "product_id", "numbers"), table)
        ranked = top_k_per_group(exact, ["query_id"], ["distance", "chunk_id"], int(np.asarray(table.column("k")).max()))
        ranked = ranked.where(F.col("rank") <= F.col("k")).drop("k")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, chunk_id bigint, product_id bigint, distance double, rank int")
    return found
