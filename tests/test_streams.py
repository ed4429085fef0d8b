from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfseek.plans.search import search
from shelfseek.registered import views as W
from shelfseek.schemas import QUERY_LOG, QUERY_LOG_PRODUCT, SEARCH_REQUEST
from shelfseek.streaming import requests as Z
from shelfseek.workspace import new_path


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM


def _requests(spark, rows):
    return spark.createDataFrame(rows, SEARCH_REQUEST)


def test_stream_equals_batch_over_several_runs(spark, sf_dir, tables):
    folder, out, progress = (new_path(spark, name) for name in ("in", "out", "progress"))
    asked = W.requests(spark, sf_dir, 30).select(*[F.col(f.name).cast(f.dataType) for f in SEARCH_REQUEST.fields])
    for half in (0, 1):
        asked.where(F.col("query_id") % 2 == half).write.mode("append").parquet(folder)
        stream = Z.request_stream(spark, folder, SEARCH_REQUEST)
        Z.stream_search(stream, *tables, out, progress).awaitTermination()
    columns = ["query_id", "rank", "product_id", "chunk_id"]
    got = {tuple(r) for r in spark.read.parquet(out).select(*columns).collect()}
    assert got == {tuple(r) for r in search(asked, *tables).select(*columns).collect()}
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2


def test_replayed_batch_changes_nothing(spark, tables):
    out = new_path(spark, "log")
    batch = _requests(spark, [(1, "alpha", 5, 1), (2, " ", 5, 1), (3, "beta", 5, 2)])
    results = search(batch, *tables)

    def contents():
        entries = Z.read_batches(spark, f"{out}/query_log", QUERY_LOG).select("query_id", "query_text", "user_id")
        bridge = Z.read_batches(spark, f"{out}/query_log_product", QUERY_LOG_PRODUCT)
        return sorted(map(tuple, entries.collect())), sorted(map(tuple, bridge.collect()))

    assert contents() == ([], [])
    Z.log_batch(batch, results, out, 7)
    first = contents()
    Z.log_batch(batch, results, out, 7)
    assert contents() == first
    assert sorted(text for _, text, _ in first[0]) == ["alpha", "beta"]
    Z.log_batch(_requests(spark, [(4, "gamma", 1, 1)]), results.where("false"), out, 8)
    assert len(contents()[0]) == 3 and contents()[1] == first[1]


def test_a_request_is_logged_once(spark, tables):
    """Repeated within a file, in a later batch and after a restart; a new request in between is logged."""
    folder, out, progress = (new_path(spark, name) for name in ("in", "log", "progress"))
    rounds = [
        [[(1, "alpha", 5, 1), (1, "alpha", 5, 1), (2, "beta", 5, 1)], [(2, "beta", 5, 1), (3, "gamma", 5, 2)]],
        [[(1, "alpha", 5, 1), (4, "delta", 5, 2), (3, "gamma", 5, 2)]],
        [[(4, "delta", 5, 2)]],
    ]
    logged = []
    for files in rounds:
        for rows in files:
            _requests(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = Z.request_stream(spark, folder, SEARCH_REQUEST, files_per_batch=1)
        Z.stream_query_log(stream, *tables, out, progress).awaitTermination()
        entries = Z.read_batches(spark, f"{out}/query_log", QUERY_LOG).select("query_text").collect()
        logged.append(sorted(r["query_text"] for r in entries))
    bridge = Z.read_batches(spark, f"{out}/query_log_product", QUERY_LOG_PRODUCT)
    assert bridge.groupBy("query_id", "product_id").count().where("count > 1").count() == 0
    assert logged == [["alpha", "beta", "gamma"], ["alpha", "beta", "delta", "gamma"], ["alpha", "beta", "delta", "gamma"]]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_volume_does_not_depend_on_the_session_zone(spark, zone):
    folder, out, progress = (new_path(spark, name) for name in ("in", "out", "progress"))
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "q", 1, start + dt.timedelta(hours=i)) for i in range(60)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        spark.createDataFrame(rows, QUERY_LOG).coalesce(1).write.parquet(folder)
        stream = spark.readStream.schema(QUERY_LOG).parquet(folder)
        Z.stream_query_volume(stream, out, progress).awaitTermination()
        got = {tuple(r) for r in Z.read_query_volume(spark, out).collect()}
        late = [(100, "q", 1, start + dt.timedelta(hours=59)), (101, "q", 1, start + dt.timedelta(hours=80))]
        spark.createDataFrame(late, QUERY_LOG).coalesce(1).write.mode("append").parquet(folder)
        again = spark.readStream.schema(QUERY_LOG).parquet(folder)
        Z.stream_query_volume(again, out, progress).awaitTermination()
        then = {tuple(r) for r in Z.read_query_volume(spark, out).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    days = [start + dt.timedelta(days=i) for i in range(4)]
    assert got == {(days[0], "q", 24), (days[1], "q", 24), (days[2], "q", 12)}
    assert then == {(days[0], "q", 24), (days[1], "q", 24), (days[2], "q", 13), (days[3], "q", 1)}
