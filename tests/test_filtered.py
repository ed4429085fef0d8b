from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfseek.operators.nearest import COSINE, nearest
from shelfseek.plans import ann, filtered

DIM = 16


@pytest.fixture(scope="module")
def world(spark):
    """6,000 vectors in sixty clusters; category 0 is common, 1 holds one in a hundred, 2 seven, 3 only two."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, DIM))
    n = 6000
    points = (centres[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, DIM))).astype(np.float32)
    category = np.where(np.arange(n) % 100 == 5, 1, 0)
    category[[10, 800, 1600, 2400, 3200, 4000, 4800]] = 2
    category[[77, 5077]] = 3
    items = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * DIM, points.ravel())
    ids = np.arange(n)
    table = pa.table({"chunk_id": ids, "product_id": ids, "category_id": category.astype(np.int64), "embedding": items})
    vectors = spark.createDataFrame(table)
    queries = vectors.where("chunk_id % 150 = 0").select(
        F.col("chunk_id").alias("query_id"), F.lit(5).alias("k"), "embedding"
    ).crossJoin(spark.range(4).select(F.col("id").alias("category_id")))
    queries = queries.withColumn("query_id", F.col("query_id") * 4 + F.col("category_id"))
    index = filtered.write_filtered_cells(vectors, ann.sampled_centres(vectors, DIM), DIM)
    truth = set()
    for one in range(4):
        found = nearest(vectors.where(F.col("category_id") == one), queries.where(F.col("category_id") == one), DIM, COSINE)
        truth |= {tuple(r) for r in found.select("query_id", "rank", "chunk_id").collect()}
    return index, queries, truth


def _found(df):
    return {tuple(r) for r in df.select("query_id", "rank", "chunk_id").collect()}


def test_exact_when_asked(world):
    index, queries, truth = world
    assert _found(filtered.search_filtered_cells(index, queries, DIM, exact=True)) == truth


def test_recall_and_full_answers(world):
    """Every query gets as many hits as exist, most of them the right ones, for rare categories as well."""
    index, queries, truth = world
    got = _found(filtered.search_filtered_cells(index, queries, DIM))
    for category in range(4):
        mine = {(q, c) for q, _, c in got if q % 4 == category}
        right = {(q, c) for q, _, c in truth if q % 4 == category}
        assert len(mine) == len(right)
        assert len(mine & right) / len(right) >= 0.95


def test_odd_queries(world):
    index, queries, _ = world
    odd = queries.limit(2).withColumn("category_id", F.when(F.col("query_id") == -1, 1))
    assert filtered.search_filtered_cells(index, odd, DIM).count() == 0
    assert filtered.search_filtered_cells(index, queries.limit(3).withColumn("category_id", F.lit(99)), DIM).count() == 0
    assert filtered.search_filtered_cells(index, queries.where("false"), DIM).count() == 0
