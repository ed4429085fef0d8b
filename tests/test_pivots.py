from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfseek.operators import pivots as P
from shelfseek.operators.nearest import COSINE, L2_SQUARED, nearest
from shelfseek.operators.pivots import nearest_join
from test_vectors import DIM, QUERIES, VECTORS, _table, as_set, brute_force, world  # noqa: F401


@pytest.mark.parametrize("way,measure", [
    ("one slot a cell", COSINE), ("many slots and parts", L2_SQUARED), ("many slots and parts", COSINE),
    ("one pivot", L2_SQUARED), ("a pivot per vector", COSINE),
])
def test_join_is_exact(spark, world, way, measure, monkeypatch):  # noqa: F811
    """A third of all vectors are one vector; k goes from 0 to more than there are vectors."""
    vectors, queries = world
    options = {"one pivot": {"pivots": 1}, "a pivot per vector": {"pivots": 700}}.get(way, {})
    if way == "many slots and parts":
        monkeypatch.setattr(P, "SLOT_NUMBERS", 16 * DIM)
        monkeypatch.setattr(P, "PART_QUERIES", 3)
    joined = nearest_join(vectors, queries, DIM, measure, **options)
    assert as_set(joined.hits) == as_set(brute_force(vectors, queries, measure))


def test_many_queries_are_joined(spark, world):  # noqa: F811
    vectors, queries = world
    found = nearest(vectors, queries, DIM, max_broadcast_numbers=4 * DIM)
    assert as_set(found) == as_set(brute_force(vectors, queries, L2_SQUARED))


@pytest.mark.parametrize("length", [1e-12, 1e18, 1e160])
def test_lengths(spark, length):
    """Squares of 1e160 overflow: nothing is pruned then, and cosine still has no finite length to divide by."""
    rng = np.random.default_rng(4)
    rows = [(i, i, [float(x) for x in rng.normal(size=DIM) * (length if i % 3 else 1.0)]) for i in range(90)]
    schema = VECTORS.replace("array<float>", "array<double>")
    vectors = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(i, 5, rows[i][2]) for i in range(12)], QUERIES.replace("array<float>", "array<double>"))
    got, expected = (
        {(r["query_id"], r["rank"], r["chunk_id"]) for r in df.where(~F.isnan("distance") & (F.col("distance") < float("inf"))).collect()}
        for df in (nearest_join(vectors, queries, DIM).hits, brute_force(vectors, queries, L2_SQUARED))
    )
    assert got == expected


def test_empty(spark, world):  # noqa: F811
    vectors, queries = world
    assert nearest_join(vectors, queries.where("false"), DIM).hits.count() == 0
    assert nearest_join(vectors.where("false"), queries, DIM).hits.count() == 0
    assert nearest_join(vectors.where("chunk_id > 600"), queries, DIM).hits.count() == 0


def test_clusters_are_pruned(spark):
    """100,000 x 100,000: a query sees a few of the cells; every hundredth is compared with the plain search."""
    rng, dim, n = np.random.default_rng(1), 16, 100_000
    centres = rng.normal(size=(500, dim))

    def table(seed, key):
        own = np.random.default_rng(seed)
        points = centres[own.integers(0, 500, n)] + 0.1 * own.normal(size=(n, dim))
        ids = np.arange(n)
        items = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, points.astype(np.float32).ravel())
        return spark.createDataFrame(pa.table({key: ids, "product_id": ids, "embedding": items}))

    vectors, queries = table(2, "chunk_id"), table(3, "query_id").withColumn("k", F.lit(5))
    joined = nearest_join(vectors, queries, dim)
    assert joined.query_copies < n * joined.cells / 20
    assert joined.vector_copies <= 2 * n
    hits = joined.hits.select("query_id", "rank", "chunk_id", "product_id", "distance").persist()
    assert hits.count() == 5 * n
    few = nearest(vectors, queries.where("query_id % 100 = 0"), dim)
    assert as_set(hits.where("query_id % 100 = 0")) == as_set(few)
    hits.unpersist()
