"""A third of all rows under one key: results stay whole."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfseek.operators import catalog as C
from shelfseek.operators import quality as Q
from shelfseek.operators import reports as R
from shelfseek.operators import upsert as U
from shelfseek.operators.keys import positional_ids

N = 6000


def _key(i: int) -> int:
    return 0 if i % 3 == 0 else i % 97


@pytest.fixture(scope="module")
def links(spark):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)
    return spark.range(N).select("id", key.alias("product_id"), (F.col("id") % 11).alias("store_id")).repartition(6)


@pytest.fixture(scope="module", params=[-1, 10 * 2**20], ids=["shuffled joins", "small sides sent out"])
def join_limit(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(request.param))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _products(spark, first=0):
    return spark.range(first, 97).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("title"))


def test_stores(spark, links, join_limit):
    stores = spark.range(11).select(F.col("id").alias("store_id"), F.lit("s").alias("store"))
    rows = C.products_with_stores(_products(spark), links, stores).collect()
    assert {(r["product_id"], r["store_id"]): r["n_children"] for r in rows} == Counter((_key(i), i % 11) for i in range(N))


def test_orphans(spark, links, join_limit):
    rows = Q.orphans(links, "product_id", _products(spark, first=1), "product_id").collect()
    assert [tuple(r) for r in rows] == [(0, sum(_key(i) == 0 for i in range(N)))]


def test_bridge_and_history(spark, links, join_limit):
    log = spark.range(11).select(F.col("id").alias("query_id"), F.lit("q").alias("query_text"))
    bridge = links.select(F.col("store_id").alias("query_id"), "product_id")
    expected = {(i % 11, _key(i)) for i in range(N)}
    joined = C.through_bridge(log, bridge, _products(spark), "query_id", "product_id")
    assert sorted((r["query_id"], r["product_id"]) for r in joined.collect()) == sorted(expected)
    history = {r["query_id"]: r["n_results"] for r in R.search_history(log, bridge).collect()}
    assert history == Counter(query for query, _ in expected)


def test_appends_and_deletes(spark, links, join_limit):
    target = _products(spark, first=50)
    incoming = links.select("product_id", F.col("id").cast("string").alias("title"), F.col("id").alias("o"))
    first = {}
    for i in range(N):
        first.setdefault(_key(i), str(i))
    merged = {r["product_id"]: r["title"] for r in U.insert_ignore(target, incoming, ["product_id"], ["o"]).collect()}
    assert merged == {k: f"p{k}" if k >= 50 else title for k, title in first.items()} | {k: f"p{k}" for k in range(50, 97)}
    left = U.delete_cascade(links, spark.createDataFrame([(0,)], "product_id bigint"), "product_id")
    assert left.count() == sum(_key(i) != 0 for i in range(N))


def test_ids(spark, links):
    rows = positional_ids(links.select("product_id", "id"), ["product_id", "id"], "n").collect()
    assert sorted((r["product_id"], r["id"]) for r in rows) == [(r["product_id"], r["id"]) for r in sorted(rows, key=lambda r: r["n"])]
    assert sorted(r["n"] for r in rows) == list(range(N))
