"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfseek.functions import text as T
from shelfseek.operators import chunking as K
from shelfseek.operators import quality as Q
from shelfseek.operators.catalog import join_products
from shelfseek.operators.nearest import nearest
from shelfseek.operators.topk import top_k_per_group
from shelfseek.operators.upsert import first_per_key
from shelfseek.plans.search import request_vectors, search
from shelfseek.registered import views as W

import __spark_entry__ as entry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_has_no_cross_join(spark, sf_dir):
    found = search(W.requests(spark, sf_dir, 10), W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM)
    text = plan(found)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert "WindowGroupLimit" in text
    assert "MapInArrow" in text or "PythonMapInArrow" in text


def test_search_reads_only_needed_columns(spark, sf_dir):
    hits = nearest(W.vectors(spark, sf_dir), request_vectors(W.requests(spark, sf_dir, 10), W.DIM), W.DIM)
    products = W.products(spark, sf_dir).select("product_id", "title")
    text = join_products(hits, products)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


@pytest.mark.parametrize("name", [
    "g1_clean_or_fallback", "g7_clean_description", "g8_clean_text", "g9_ui_clean_text", "g10_first_image",
    "t2_paragraph_chunks", "t3_sentence_split", "t4_word_tokens", "h1_insert_ignore", "h7_constraint_report",
    "c4_bridge_join", "d5_search_history", "e2_topk_per_query",
])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert not re.search("Python|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_chunking_and_cleaning_do_not_shuffle(spark, sf_dir):
    docs = W.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), "text")
    for df in (
        K.character_chunks(docs), K.paragraph_chunks(docs),
        docs.select(T.clean_description(F.col("text")), T.clean_text(F.col("text"))),
    ):
        assert "Exchange" not in plan(df)


def test_explode_evaluates_its_array_once(spark, sf_dir):
    docs = W.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), "text")
    assert plan(K.paragraph_chunks(docs)).count("aggregate(") <= 2


def test_groups_are_cut_before_the_shuffle(spark, sf_dir):
    items = W.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice")
    text = plan(top_k_per_group(items, ["l_partkey"], [F.desc("l_extendedprice"), "l_orderkey"], 3))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


@pytest.mark.parametrize("partitions", [8, 200, 2000])
def test_one_row_per_key_takes_one_shuffle(spark, sf_dir, partitions):
    lines = W.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        text = plan(first_per_key(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"]))
        ranked = plan(top_k_per_group(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"], 3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min_by" in text
    assert ranked.count("Exchange hashpartitioning") == 1


def test_foreign_keys_are_counted_before_the_join(spark, sf_dir):
    lines, part = W.table(spark, sf_dir, "lineitem"), W.table(spark, sf_dir, "part")
    text = plan(Q.orphans(lines, "l_partkey", part, "p_partkey"))
    assert "LeftAnti" in text and "partial_count" in text


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(W.products(spark, sf_dir).where("product_id = 7"))
    assert "EqualTo(p_partkey,7)" in text
