"""Near-duplicate vectors by cosine, in tiles that stop early.

Vectors are scaled to length 1 and turned into the axes of their principal components, which changes no
product. Tiles are intervals along the first axis; two tiles whose intervals lie further apart than two linked
vectors can are never compared. In a pair of tiles the leading axes are multiplied first. What the other axes
can still add is at most the product of the two remaining lengths (Cauchy-Schwarz); pairs whose cosine can no
longer reach the threshold stop, the others take further axes, and the few that are left are computed exactly
in double precision.

Equal vectors are one class with a number of copies. A pair of tiles gives every class its number of linked
vectors and one link towards its local component, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of, summed, written
from shelfseek.llm.components import components

#: Most vectors of a tile, on average; a group holds two tiles.
TILE = 4096
#: Most intervals along the first axis. Longer tables cut every interval into several tiles by hash.
STRIPS = 512
#: Axes that are multiplied before each test.
STEP = 16
_ROWS, _COLUMNS = 512, 2048
#: More than the error of single-precision products of vectors of length 1.
_SLACK = 1e-4
#: Below this share of pairs left, they are followed one by one instead of as a block.
_SPARSE = 0.02
_PAIRS = 1 << 18


def is_valid(embedding: Column) -> Column:
    """Not null, not empty, only finite items, and not all of them zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no square can overflow or vanish
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Columns: the axes along which the unit vectors' products spread most, first ones first."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches_of(frame):
            units = _units(batch.column("embedding"), dim)
            total += units.T @ units
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["part"])

    moments = np.array(summed(classes.select("embedding").mapInArrow(run, "part array<double>")))
    return np.linalg.eigh(moments.reshape(dim, dim))[1][:, ::-1]


class _Links:
    """Linked vectors and local components of the classes of one group."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.links, self.parent = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.copies)
        self.links += np.bincount(a, weights=self.copies[b], minlength=n).astype(np.int64)
        self.links += np.bincount(b, weights=self.copies[a], minlength=n).astype(np.int64)
        while True:
            u, v = self.parent[a], self.parent[b]
            apart = u != v
            if not apart.any():
                return
            np.minimum.at(self.parent, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
            while (self.parent != self.parent[self.parent]).any():
                self.parent = self.parent[self.parent]


def _remaining(turned: np.ndarray) -> np.ndarray:
    """[row, step]: the length of what comes after each step's axes."""
    squares = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
    ends = [*range(STEP, turned.shape[1], STEP)]
    return np.sqrt(np.concatenate([squares[:, ends], np.zeros((len(turned), 1))], axis=1)).astype(np.float32)


def _block(a, b, rest_a, rest_b, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks (single precision) whose product may reach ``limit``."""
    dim = a.shape[1]
    done = min(STEP, dim)
    product = a[:, :done] @ b[:, :done].T
    step = 0
    while True:
        possible = product + rest_a[:, step, None] * rest_b[None, :, step] >= limit
        left = np.count_nonzero(possible)
        if done == dim or left <= _SPARSE * possible.size:
            break
        more = slice(done, min(done + STEP, dim))
        product += a[:, more] @ b[:, more].T
        done, step = more.stop, step + 1
    i, j = np.divmod(np.flatnonzero(possible), len(b))
    partial = product[i, j]
    while done < dim and len(i):
        more = slice(done, min(done + STEP, dim))
        partial = partial + np.einsum("ij,ij->i", a[i, more], b[j, more])
        done, step = more.stop, step + 1
        kept = partial + rest_a[i, step] * rest_b[j, step] >= limit
        i, j, partial = i[kept], j[kept], partial[kept]
    return i, j


def compare(left: np.ndarray, right: np.ndarray | None, axes: np.ndarray, threshold: float, links: _Links) -> None:
    """Link unit vectors: of ``left`` among themselves, or with ``right``, whose rows follow in ``links``."""
    a = left @ axes
    b = a if right is None else right @ axes
    exact_b, shift = (left, 0) if right is None else (right, len(left))
    rest_a, rest_b = _remaining(a), _remaining(b)
    a, b = a.astype(np.float32), b.astype(np.float32)
    limit = threshold - _SLACK
    for top in range(0, len(a), _ROWS):
        for start in range(0 if right is not None else top - top % _COLUMNS, len(b), _COLUMNS):
            rows, columns = slice(top, top + _ROWS), slice(start, start + _COLUMNS)
            i, j = _block(a[rows], b[columns], rest_a[rows], rest_b[columns], limit)
            i, j = i + top, j + start
            if right is None:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), _PAIRS):
                p, q = i[cut : cut + _PAIRS], j[cut : cut + _PAIRS]
                near = np.einsum("ij,ij->i", left[p], exact_b[q]) >= threshold
                if near.any():
                    links.add(p[near], q[near] + shift)


def _tiles(classes: DataFrame, axes: np.ndarray, dim: int, threshold: float, tile: int) -> DataFrame:
    """The classes once for every pair of tiles they take part in: (pair, left, id, embedding, copies)."""
    first = np.ascontiguousarray(axes[:, 0])

    def place(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            at = pa.array(_units(batch.column("embedding"), dim) @ first)
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*batch.schema.names, "at"])

    placed = classes.select("id", "embedding", "copies").mapInArrow(
        place, classes.select("id", "embedding", "copies").schema.add("at", "double")
    )
    rows = classes.count()
    tiles = max(1, -(-rows // tile))
    strips = min(tiles, STRIPS)
    slots = -(-tiles // strips)
    shares = [i / strips for i in range(1, strips)]
    cuts = placed.agg(F.percentile_approx("at", shares)).first()[0] if shares else []
    low, high = [-1.0, *cuts], [*cuts, 1.0]
    reach = float(np.sqrt(2 - 2 * threshold)) + _SLACK
    # the last strip that each strip must meet; at most STRIPS numbers
    last = [max(t for t in range(strips) if low[t] - high[s] <= reach) for s in range(strips)]
    strip = _count_below(cuts, F.col("at"))
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    numbered = placed.withColumn("tile", (strip * slots + slot).cast("bigint"))
    met = F.array(*[F.lit((t + 1) * slots - 1) for t in last])
    total = strips * slots
    firsts = [min(s for s in range(strips) if last[s] >= t) * slots for t in range(strips)]
    since = F.array(*[F.lit(f) for f in firsts])
    own = F.floor(F.col("tile") / slots).cast("int")
    as_left = F.sequence(F.col("tile"), F.element_at(met, own + 1).cast("bigint"))
    as_right = F.filter(F.sequence(F.element_at(since, own + 1).cast("bigint"), F.col("tile")), lambda t: t < F.col("tile"))
    pairs = F.concat(
        F.transform(as_left, lambda t: F.struct((F.col("tile") * total + t).alias("pair"), F.lit(True).alias("left"))),
        F.transform(as_right, lambda t: F.struct((t * total + F.col("tile")).alias("pair"), F.lit(False).alias("left"))),
    )
    return numbered.select("id", "embedding", "copies", F.explode(pairs).alias("p")).select(
        "p.pair", "p.left", "id", "embedding", "copies", (F.col("pair") % (total + 1) == 0).alias("same")
    )


def _count_below(cuts: list[float], at: Column) -> Column:
    """How many of the ascending ``cuts`` are below ``at``."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < at))


_FOUND = "id bigint, links bigint, peer bigint"


def _tile_links(paired: DataFrame, axes: np.ndarray, dim: int, threshold: float) -> DataFrame:
    """(id, links, peer) of the classes with links, from every pair of tiles."""
    shared = paired.sparkSession.sparkContext.broadcast(axes)  # dim * dim numbers

    def run(group: pa.Table) -> pa.Table:
        left = np.asarray(group.column("left"))
        order = np.argsort(~left, kind="stable")
        group = group.take(pa.array(order))
        n_left = int(left.sum())
        ids, copies = np.asarray(group.column("id")), np.asarray(group.column("copies"))
        units = _units(group.column("embedding").combine_chunks(), dim)
        links = _Links(copies)
        within = bool(group.column("same")[0].as_py())
        compare(units[:n_left], None if within else units[n_left:], shared.value, threshold, links)
        some = np.flatnonzero(links.links)
        arrays = [pa.array(ids[some]), pa.array(links.links[some]), pa.array(ids[links.parent[some]])]
        return pa.Table.from_arrays(arrays, ["id", "links", "peer"])

    return paired.groupBy("pair").applyInArrow(run, _FOUND)


def linked_classes(classes: DataFrame, dim: int, threshold: float, tile: int = TILE) -> DataFrame:
    """(id, links, peer) rows for distinct vectors ``classes`` (id, embedding, copies) of one length."""
    axes = principal_axes(classes, dim)
    return _tile_links(_tiles(classes, axes, dim, threshold, tile), axes, dim, threshold)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Two vectors of one length are linked if their cosine, in double precision, reaches ``threshold``.
    n_links counts the other rows linked directly, component_id is the smallest vec_id that a chain of links
    reaches, kept marks the row that carries it. Vectors that are null, empty, zero or hold null or non-finite
    items are linked with nothing. A null vec_id counts as a vector but names no component unless alone.
    Repeated rows are vectors of their own, with equal results. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    valid = rows.where(is_valid(F.col("embedding")))
    grouped = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    grouped = grouped.withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id())
    classes = written(grouped, "vector-classes")  # the numbers hold from here on
    found = spark.createDataFrame([], _FOUND)
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        found = found.unionByName(linked_classes(classes.where(F.col("dim") == dim), dim, threshold, tile))
    found = written(found, "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")), "vector-components")
    stars = stars.withColumnRenamed("node", "id")
    joined = classes.select("id", "least", "copies").join(sums, "id", "left").join(stars, "id", "left")
    joined = joined.withColumn("component", F.coalesce("component", "id"))
    joined = written(joined.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "vector-joined")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = joined.join(named, "component").select("id", "n_links", "component_id")
    by_vector = classes.select("id", "embedding").join(by_class, "id").drop("id")
    linked = valid.join(by_vector, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~is_valid(F.col("embedding"))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
