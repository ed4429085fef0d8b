from __future__ import annotations

import tracemalloc

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfseek.functions import vectors as V
from shelfseek.operators import embedding as E
from shelfseek.operators import nearest as X
from shelfseek.operators.catalog import within_cutoff
from shelfseek.operators.embedding import embed, embed_in_batches
from shelfseek.operators.nearest import COSINE, L2_SQUARED, nearest
from shelfseek.operators.quality import check_vectors
from shelfseek.operators.topk import best_hit_per_product, page_of, paginate
from shelfseek.plans import ann
from shelfseek.plans.search import search

DIM = 8
VECTORS = "chunk_id bigint, product_id bigint, embedding array<float>"
QUERIES = "query_id bigint, k int, embedding array<float>"


def _table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def world(spark):
    """Random vectors of which a third are copies of one, with zero vectors and broken ones among them."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        vector = np.full(DIM, 0.5) if i % 3 == 0 else rng.normal(size=DIM)
        rows.append((i, i % 7, [float(np.float32(x)) for x in vector]))
    rows += [(600, 1, [0.0] * DIM), (601, 1, None), (602, 1, [1.0] * (DIM - 1)), (603, 1, [float("nan")] * DIM)]
    queries = [(i, 1 + i * 4, [float(np.float32(x)) for x in rng.normal(size=DIM)]) for i in range(20)]
    queries += [(20, 250, [0.5] * DIM), (21, 1000, [0.0] * DIM), (22, 0, [1.0] * DIM), (23, 3, None)]
    return _table(spark, rows, VECTORS), _table(spark, queries, QUERIES)


def brute_force(vectors, queries, measure):
    """The same by pairwise expressions; only for a small fixture."""
    v = vectors.where(V.is_valid(F.col("embedding"), DIM)).withColumnRenamed("embedding", "e")
    q = queries.where(V.is_valid(F.col("embedding"), DIM) & (F.col("k") > 0))
    pair = V.l2_squared(F.col("embedding"), F.col("e")) if measure == L2_SQUARED else 1 - V.cosine(F.col("embedding"), F.col("e"))
    scored = q.join(v, F.lit(True)).withColumn("distance", F.round(pair, 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return scored.withColumn("rank", rank).where("rank <= k").select("query_id", "chunk_id", "product_id", "distance", "rank")


def as_set(df):
    return {(r["query_id"], r["rank"], r["chunk_id"], r["product_id"], round(r["distance"], 6)) for r in df.collect()}


@pytest.mark.parametrize("measure", [L2_SQUARED, COSINE])
@pytest.mark.parametrize("way", ["one block", "many blocks", "few hits a block", "many partitions"])
def test_nearest_is_exact(spark, world, measure, way, monkeypatch):
    vectors, queries = world
    expected = as_set(brute_force(vectors, queries, measure))
    options = {}
    if way == "many blocks":
        options["max_broadcast_numbers"] = 8 * DIM
    if way == "few hits a block":
        monkeypatch.setattr(X, "MAX_KEPT_ROWS", 600)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if way == "many partitions":
        spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        assert as_set(nearest(vectors, queries, DIM, measure, **options)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_batches_and_blocks(spark, world, monkeypatch):
    vectors, queries = world
    monkeypatch.setattr(X, "_QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(X, "_PAIRS_PER_STEP", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for measure in (L2_SQUARED, COSINE):
            assert as_set(nearest(vectors, queries, DIM, measure)) == as_set(brute_force(vectors, queries, measure))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_very_long_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, [float(np.float32(x)) for x in rng.normal(size=DIM) * (1e18 if i % 2 else 3e19)]) for i in range(60)]
    vectors = _table(spark, rows, VECTORS)
    queries = _table(spark, [(i, 5, rows[i][2]) for i in range(10)], QUERIES)
    for measure in (L2_SQUARED, COSINE):
        got = {(q, r, c) for q, r, c, _, _ in as_set(nearest(vectors, queries, DIM, measure))}
        assert got == {(q, r, c) for q, r, c, _, _ in as_set(brute_force(vectors, queries, measure))}


def test_one_very_large_k_changes_neither_rows_nor_plan(spark, world):
    vectors, queries = world
    few = queries.where("k < 1000")
    large = few.limit(1).select((F.col("query_id") + 1000).alias("query_id"), F.lit(1_000_001).alias("k"), "embedding")
    both = few.unionByName(large)
    found = nearest(vectors, both, DIM)
    assert as_set(found) == as_set(brute_force(vectors, both, L2_SQUARED))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in text and "Generate explode" not in text and "MapInArrow" in text


def test_no_queries_and_no_vectors(spark, world):
    vectors, queries = world
    assert nearest(vectors, queries.where("false"), DIM).count() == 0
    assert nearest(vectors.where("false"), queries, DIM).count() == 0


def test_k_beyond_the_table_pads_nothing(spark, world):
    vectors, queries = world
    hits = nearest(vectors, queries.where("k = 1000"), DIM)
    assert hits.count() == 601


def test_measures(spark):
    df = _table(spark, [(1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 0.0], [0.0, 0.0])], "i int, a array<float>, b array<float>")
    rows = df.orderBy("i").select(V.l2_squared(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(2.0, 0.0), (1.0, 0.0)]


def test_cutoff_keeps_exactly_two(spark):
    hits = _table(spark, [(1, 2.0), (2, 2.0000001), (3, 0.0)], "i int, distance double")
    assert {r["i"] for r in within_cutoff(hits).collect()} == {1, 3}


def test_best_hit_and_rank(spark):
    hits = _table(
        spark, [(1, 10, 5, 0.3, 1), (1, 11, 5, 0.1, 2), (1, 12, 6, 0.2, 3), (2, 13, 5, 0.0, 1)],
        "query_id bigint, chunk_id bigint, product_id bigint, distance double, rank int",
    )
    best = best_hit_per_product(hits).select("query_id", "product_id", "chunk_id", "rank")
    assert {tuple(r) for r in best.collect()} == {(1, 5, 11, 1), (1, 6, 12, 2), (2, 5, 13, 1)}


@pytest.mark.parametrize("n", [0, 1, 10, 11, 100])
def test_pages_cover_all(spark, n):
    ranked = _table(spark, [(1, i + 1) for i in range(n)], "query_id bigint, rank int")
    paged = paginate(ranked)
    pages = -(-n // 10)
    assert paged.count() == n
    for page in range(1, pages + 1):
        rows = page_of(paged, page).collect()
        assert sorted(r["rank"] for r in rows) == list(range((page - 1) * 10 + 1, min(page * 10, n) + 1))
        assert all(r["has_more"] == (page < pages) and r["n_pages"] == pages for r in rows)


def test_search_rules(spark):
    """All hits in one product, a product that is gone, a blank query and a far vector."""
    texts = [(1, "alpha", 3), (2, "  ", 3), (3, "alpha", 10), (4, "alpha", 0)]
    requests = _table(spark, [(i, text, k, 1) for i, text, k in texts], "query_id bigint, query string, k int, user_id int")
    embedded = embed(requests.where("query_id = 1").select(F.col("query").alias("t")), "t", DIM).first()["embedding"]
    near = [float(x) for x in embedded]
    opposite = [-x for x in near]
    vectors = _table(
        spark,
        [(1, 10, near), (2, 10, near), (3, 10, near), (4, 11, near), (5, 99, near), (6, 12, opposite)], VECTORS,
    )
    products = _table(spark, [(10, "a", float("nan")), (11, "b", 2.0), (12, "c", 3.0)], "product_id bigint, title string, price double")
    rows = search(requests, vectors, products, DIM).select("query_id", "rank", "product_id", "price").collect()
    assert {tuple(r) for r in rows} == {(1, 1, 10, None), (3, 1, 10, None), (3, 2, 11, 2.0)}


def test_contract(spark, world):
    good, bad = check_vectors(world[0], DIM)
    assert good.count() == 601
    assert {(r["chunk_id"], r["reason"]) for r in bad.collect()} == {
        (601, "null vector"), (602, "wrong dimension"), (603, "not finite"),
    }


def test_embedding(spark):
    df = _table(spark, [(1, "Red red BLUE"), (2, ""), (3, None), (4, "..."), (5, "éa red")], "i int, t string")
    rows = {r["i"]: r["embedding"] for r in embed(df, "t", 16).collect()}
    assert all(len(vector) == 16 for vector in rows.values())
    assert [round(float(np.linalg.norm(rows[i])), 5) for i in range(1, 6)] == [1.0, 0.0, 0.0, 0.0, 1.0]
    assert sorted(round(x, 4) for x in rows[1] if x) == [0.4472, 0.8944]


def test_batches_of_thirty(spark):
    def make():
        return lambda texts: [[float(len(texts))] for _ in texts]

    df = spark.range(70).select("id", F.lit("x").alias("t")).coalesce(1)
    sizes = [r["embedding"][0] for r in embed_in_batches(df, "id", "t", make).orderBy("id").collect()]
    assert sizes == [30.0] * 60 + [10.0] * 10


def test_sampled_centres_are_few(spark, world):
    vectors = world[0]
    usable = vectors.where(V.is_valid(F.col("embedding"), DIM))
    centres = ann.sampled_centres(vectors, DIM)
    assert centres.shape == (round(usable.count() ** 0.5), DIM)
    assert (ann.sampled_centres(vectors.repartition(5), DIM) == centres).all()


def test_stream_search_has_few_cells(spark, sf_dir, monkeypatch):
    written, whole = [], ann.write_cells
    monkeypatch.setattr(ann, "write_cells", lambda *given: written.append(whole(*given)) or written[-1])
    entry.queries()["s1_stream_search_cells"](spark, sf_dir)
    n_vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert [len(index.centres) for index in written] == [round(n_vectors ** 0.5)]


def test_cells_recall(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, DIM))
    rows = [(i, i, [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=DIM)]) for i in range(900)]
    queries = [(i, 10, [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=DIM)]) for i in range(12)]
    vectors, asked = _table(spark, rows, VECTORS), _table(spark, queries, QUERIES)
    written = ann.write_cells(vectors, ann.train_centres(vectors, DIM, cells=6), DIM)
    index = ann.open_cells(spark, written.path)
    assert (index.centres == written.centres).all()
    exact = {(r["query_id"], r["chunk_id"]) for r in nearest(vectors, asked, DIM, COSINE).collect()}
    some = {(r["query_id"], r["chunk_id"]) for r in ann.search_cells(index, asked, DIM, probes=2).collect()}
    every = {(r["query_id"], r["chunk_id"]) for r in ann.search_cells(index, asked, DIM, probes=6).collect()}
    assert every == exact
    assert len(some & exact) >= 0.8 * len(exact)


@pytest.mark.parametrize("k", [20, 100])
def test_a_task_holds_little_beside_the_hits_it_keeps(k):
    """A large batch is scored some rows at a time; so many rows at once took 34 and 44 MB here."""
    def table(vectors, **columns):
        ends = np.arange(0, vectors.size + 1, 64, dtype=np.int32)
        return {**columns, "embedding": pa.ListArray.from_arrays(ends, vectors.astype(np.float32).ravel())}

    rng, ids = np.random.default_rng(1), np.arange(10000)
    batch = pa.RecordBatch.from_pydict(table(rng.normal(size=(10000, 64)), chunk_id=ids, product_id=ids))
    queries = pa.table(table(rng.normal(size=(400, 64)), query_id=ids[:400], k=np.full(400, k, np.int32)))
    tracemalloc.start()
    found = list(X._scan([batch, batch], queries, 64, L2_SQUARED))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(part.num_rows for part in found) == 400 * k
    assert peak < 27e6


def test_texts_of_a_large_batch_are_embedded_in_steps(spark, monkeypatch):
    texts = [" ".join(f"w{i % 7 * j}" for j in range(i % 5)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").coalesce(1)
    whole = E.embed(docs, "t", 16).orderBy("i").collect()
    monkeypatch.setattr(E, "_ROWS_PER_STEP", 7)
    assert E.embed(docs, "t", 16).orderBy("i").collect() == whole
