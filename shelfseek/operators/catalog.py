"""Filters, lookups and joins on the catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions.numbers import sanitize
from shelfseek.functions.text import clean_description, has_text, snippet
from shelfseek.operators.upsert import apply_defaults

MAX_DISTANCE = 2.0
# What a request that leaves them out gets.
REQUEST_DEFAULTS = {"k": 5, "user_id": 1}


def complete_rows(raw: DataFrame) -> DataFrame:
    """Keep raw products with a price, features, a description and a main category."""
    return raw.where(
        F.col("price").isNotNull()
        & (F.size("features") > 0)
        & (F.size("description") > 0)
        & F.col("main_category").isNotNull()
    )


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are null in every row; one pass counts all of them."""
    counts = df.agg(*[F.count(F.col(name)).alias(name) for name in df.columns]).first()
    return df.select(*[name for name in df.columns if counts[name] > 0])


def product_by_id(products: DataFrame, product_id: int) -> DataFrame:
    return sanitize(products.where(F.col("product_id") == product_id))


def products_by_id(products: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole rows of all wanted ids that exist."""
    return sanitize(products.join(wanted.select("product_id").distinct(), "product_id", "left_semi"))


def titles_by_id(products: DataFrame, wanted: DataFrame) -> DataFrame:
    """(product_id, title) per wanted id, null title where there is no such product."""
    ids = wanted.select("product_id").distinct()
    return ids.join(products.select("product_id", "title"), "product_id", "left")


def within_cutoff(hits: DataFrame, limit: float = MAX_DISTANCE) -> DataFrame:
    return hits.where(~(F.col("distance") > limit))


def in_categories(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Narrow to categories. Applied before a top-k it changes which rows are found."""
    return rows.where(F.col("category").isin(categories))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and rejected ones with the reason. Absent settings get their defaults first."""
    given = {name: value for name, value in REQUEST_DEFAULTS.items() if name in requests.columns}
    reason = F.when(~F.coalesce(has_text(F.col("query")), F.lit(False)), "blank query").when(
        F.col("k") < 1, "k below 1"
    )
    judged = apply_defaults(requests, given).withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def join_products(hits: DataFrame, products: DataFrame) -> DataFrame:
    """Product columns for each hit; hits of products that are gone are dropped."""
    return sanitize(hits.join(products, "product_id", "inner"))


def result_rows(hits: DataFrame) -> DataFrame:
    """The card of a hit; its description is a cleaned snippet of the chunk."""
    return hits.select(
        "query_id", "rank", "product_id", "title",
        clean_description(snippet(F.col("chunk_text"))).alias("description"),
        "price", "average_rating", "rating_number", "store",
    )


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many: left rows with the right rows the bridge links them to.

    Duplicate links go first, so that neither join multiplies them.
    """
    links = bridge.select(left_key, right_key).distinct()
    return links.join(right, right_key).join(left, left_key)


def resolve_roles(users: DataFrame, admins: DataFrame, curators: DataFrame, end_users: DataFrame) -> DataFrame:
    """Users with the role their sub-type table gives them."""
    def flagged(df: DataFrame, flag: str) -> DataFrame:
        return df.select("user_id", F.lit(True).alias(flag))

    joined = (
        users.join(flagged(admins, "_admin"), "user_id", "left")
        .join(flagged(curators, "_curator"), "user_id", "left")
        .join(end_users.select("user_id", "last_activity"), "user_id", "left")
    )
    role: Column = F.when(F.col("_admin"), "admin").when(F.col("_curator"), "curator").otherwise("enduser")
    return joined.select(*users.columns, role.alias("role"), "last_activity")


def products_with_stores(products: DataFrame, supplied: DataFrame, stores: DataFrame) -> DataFrame:
    """Products with their stores and how many child rows each pair has.

    Child rows are counted per (product, store) before any join, so a product with very many of them
    still is one row per store afterwards.
    """
    pairs = supplied.groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("n_children"))
    return pairs.join(products, "product_id").join(stores, "store_id")


def child_rows(products: DataFrame, values: Column, name: str) -> DataFrame:
    """(product_id, place, value): the items of an array as rows; products without items give none."""
    return products.select("product_id", F.posexplode(values).alias("place", name))
