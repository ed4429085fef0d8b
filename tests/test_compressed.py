"""Compressed cells: exact when nothing is left out, good recall when something is, whole on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfseek.operators.nearest import COSINE, L2_SQUARED, nearest
from shelfseek.plans import compressed as C

DIM = 18  # not a multiple of the parts' width


@pytest.fixture(scope="module")
def world(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(25, DIM))
    rows = centres[draw.integers(0, 25, 1500)] + 0.3 * draw.normal(size=(1500, DIM))
    rows[1400:1450] = rows[0]  # ties
    table = [(i, i % 7, [float(x) for x in row]) for i, row in enumerate(rows)]
    table += [(5000, 1, None), (5001, 1, [1.0]), (5002, 1, [float("nan")] * DIM), (5003, 1, [0.0] * DIM)]
    vectors = spark.createDataFrame(table, "chunk_id bigint, product_id bigint, embedding array<float>")
    asked = [(i, [7, 1, 30][i % 3], [float(x) for x in rows[i * 13] + 0.05]) for i in range(60)]
    asked += [(900, 5, None), (901, 5, [1.0]), (902, 0, asked[0][2]), (903, 3, [0.0] * DIM)]
    queries = spark.createDataFrame(asked, "query_id bigint, k int, embedding array<float>")
    return vectors, queries


def shown(hits):
    return {(r["query_id"], r["rank"]): (r["chunk_id"], r["product_id"], r["distance"]) for r in hits.collect()}


@pytest.mark.parametrize("measure", [L2_SQUARED, COSINE])
def test_exact_with_all_cells_and_a_full_short_list(spark, world, measure):
    vectors, queries = world
    index = C.write_compressed(vectors, C.learn(vectors, DIM, cells=9, measure=measure), DIM, measure)
    again = C.open_compressed(spark, index.path, DIM, measure)
    assert (again.codebook.centres == index.codebook.centres).all() and (again.codebook.entries == index.codebook.entries).all()
    found = shown(C.search_compressed(again, queries, probes=9, shortlist=2000))
    assert found == shown(nearest(vectors, queries, DIM, measure))


@pytest.mark.parametrize("measure", [L2_SQUARED, COSINE])
def test_recall(world, measure):
    vectors, queries = world
    index = C.write_compressed(vectors, C.learn(vectors, DIM, measure=measure), DIM, measure)
    near = {(r["query_id"], r["chunk_id"]) for r in nearest(vectors, queries, DIM, measure).where("query_id < 900").collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in C.search_compressed(index, queries).where("query_id < 900").collect()}
    assert len(near & found) >= 0.95 * len(near)
    few = C.search_compressed(index, queries, probes=2, shortlist=3)
    assert few.where("distance is null or rank > 30").count() == 0


def test_blocks_of_queries_do_not_show(world):
    vectors, queries = world
    index = C.write_compressed(vectors, C.learn(vectors, DIM, cells=9), DIM)
    whole = shown(C.search_compressed(index, queries, probes=3))
    assert shown(C.search_compressed(index, queries, probes=3, max_broadcast_numbers=8 * DIM)) == whole


def test_few_or_no_vectors(spark, world):
    vectors, queries = world
    for n in (0, 1, 3):
        some = vectors.where(F.col("chunk_id") < n)
        index = C.write_compressed(some, C.learn(some, DIM), DIM)
        again = C.open_compressed(spark, index.path, DIM)
        assert shown(C.search_compressed(again, queries)) == shown(nearest(some, queries, DIM))


def test_vectors_are_not_shuffled_and_only_probed_cells_are_read(world):
    vectors, queries = world
    index = C.write_compressed(vectors, C.learn(vectors, DIM, cells=40), DIM)
    plan = C.search_compressed(index, queries.limit(2), probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "In(cell" in plan and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<chunk_id:bigint,codes:binary,cell:int>" in plan or "codes" in plan


def test_codes_are_the_nearest_entries(world):
    vectors, _ = world
    book = C.learn(vectors, DIM, cells=9)
    rows = C.first_vectors(vectors, DIM, 50)
    cells = book.cells_of(rows)[:, 0]
    assert cells.tolist() == [int(((book.centres - row) ** 2).sum(1).argmin()) for row in rows]
    codes, left = book.codes_of(rows, cells), book.parts_of(rows - book.centres[cells])
    for i in range(len(rows)):
        for part, entries in enumerate(book.entries):
            gaps = ((entries - left[i, part]) ** 2).sum(1)
            assert gaps[codes[i, part]] <= gaps.min() + 1e-12
