"""Counts and listings over the log and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions import display as D


def matched_products(results: DataFrame) -> DataFrame:
    return results.select("query_id", "product_id").distinct()


def search_history(log: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every logged query with its number of matched products; links are counted before the join."""
    links = bridge.select("query_id", "product_id").distinct()
    counts = links.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    joined = log.join(counts, "query_id", "left")
    return joined.select(*log.columns, F.coalesce("n", F.lit(0)).alias("n_results"))


def popular_queries(log: DataFrame, n: int) -> DataFrame:
    """The most frequent query texts, case and outer spaces ignored; ties in text order."""
    text = F.lower(F.trim("query_text")).alias("query_text")
    counted = log.groupBy(text).agg(F.count(F.lit(1)).alias("n_searches"))
    return counted.orderBy(F.desc("n_searches"), "query_text").limit(n)


def category_listing(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(F.count(F.lit(1)).alias("n_products"))


def cards(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        D.store_label(F.col("store")).alias("store"),
        D.price_label(F.col("price")).alias("price"),
        D.star_bar(F.col("average_rating")).alias("stars"),
        D.rating_label(F.col("average_rating")).alias("rating"),
        D.reviews_label(F.col("rating_number")).alias("reviews"),
    )


def query_volume(log: DataFrame, ts: Column, width: str) -> DataFrame:
    """Searches per time window and query text; works on a batch and on a stream."""
    return log.groupBy(F.window(ts, width).alias("w"), "query_text").agg(F.count(F.lit(1)).alias("n_searches"))
