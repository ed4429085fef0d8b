"""Load a catalog: clean the rows, resolve categories and keys, publish both tables together."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.functions import numbers as N
from shelfseek.functions.semistructured import json_or_empty
from shelfseek.functions.text import UNTITLED, clean_or, description_or_title
from shelfseek.operators import upsert as U
from shelfseek.operators.keys import continue_ids
from shelfseek.schemas import CATEGORY, PRODUCT, PRODUCT_EMBEDDINGS
from shelfseek.sources.publish import publish, published_or_empty


@dataclass
class Load:
    products: DataFrame
    new_products: DataFrame
    categories: DataFrame
    new_categories: DataFrame
    metrics: DataFrame


def clean_rows(raw: DataFrame) -> DataFrame:
    """Cleaned catalog columns; ``description`` stays null where a row has no text at all."""
    return raw.withColumns(
        {
            "description": description_or_title(F.col("description"), F.col("title")),
            "title": clean_or(F.col("title"), UNTITLED),
            "price": N.price(F.col("price")),
            "average_rating": N.rating(F.col("average_rating")),
            "rating_number": N.count(F.col("rating_number")),
            **{name: clean_or(F.col(name)) for name in ("store", "details", "features", "images")},
        }
    )


def product_rows(named: DataFrame, kept: list[str], at: dt.datetime | None = None) -> DataFrame:
    """Product columns of cleaned rows with a category id, not yet processed, plus the ``kept`` ones."""
    given = {
        "processed": F.lit(False), "timestamp": U.load_time(at), "type": F.lit(None), "source": F.lit(None),
        "added_by": F.lit(None),
    }
    full = named.withColumns({name: c for name, c in given.items() if name not in named.columns})
    fields = [f for f in PRODUCT.fields if f.name != "product_id"]
    return full.select(*kept, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def insert_products(
    named: DataFrame, products: DataFrame, order_by: list[str], at: dt.datetime | None = None
) -> DataFrame:
    """The new product rows with the keys that follow the existing ones, in ``order_by`` order."""
    numbered = continue_ids(product_rows(named, order_by, at), products, order_by, "product_id")
    return numbered.select(*PRODUCT.names)


def seed(
    raw: DataFrame, products: DataFrame, categories: DataFrame, order_by: list[str],
    at: dt.datetime | None = None,
) -> Load:
    """Everything a load of ``raw`` rows adds. ``order_by`` names the columns that fix the row order.

    A row without any text adds no product, but its category is created all the same.
    """
    cleaned = clean_rows(raw)
    all_categories, new_categories = U.get_or_create_categories(cleaned, categories)
    texted = cleaned.where(F.col("description").isNotNull())
    added = insert_products(U.with_category(texted, all_categories), products, order_by, at)
    read = cleaned.agg(F.count(F.lit(1)).alias("read"), F.count("description").alias("inserted"))
    counts = read.withColumn("created", F.lit(0)).unionByName(
        new_categories.agg(F.count(F.lit(1)).alias("created")), allowMissingColumns=True
    )
    metrics = counts.agg(
        F.sum("read").alias("rows_read"),
        F.sum("inserted").alias("products_inserted"),
        (F.sum("read") - F.sum("inserted")).alias("rows_skipped"),
        F.sum("created").alias("categories_created"),
    )
    return Load(products.unionByName(added), added, all_categories, new_categories, metrics)


def seed_and_publish(raw: DataFrame, base: str, order_by: list[str], at: dt.datetime | None = None) -> Load:
    """Load rows into the published catalog, which may be empty yet.

    Ids and categories continue the published ones. Only new rows are written, and both tables show them
    together or not at all.
    """
    spark = raw.sparkSession
    products = published_or_empty(spark, base, "product", PRODUCT)
    categories = published_or_empty(spark, base, "category", CATEGORY)
    load = seed(raw, products, categories, order_by, at)
    publish(spark, base, {"product": load.new_products, "category": load.new_categories}, append=True)
    return load


def insert_with_embeddings(
    incoming: DataFrame, products: DataFrame, embeddings: DataFrame, order_by: list[str],
    at: dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(product, embedding) rows that an insert of products with their vectors adds.

    ``incoming`` has its product ids already. Each table ignores the keys it holds. Complex images,
    features and details are stored as JSON text.
    """
    one_each = U.first_per_key(incoming, ["product_id"], order_by)
    as_json = {name: json_or_empty(F.col(name)) for name in ("images", "features", "details")}
    typed = one_each.withColumns({**as_json, "price": N.nan_to_null(F.col("price"))})
    new_products = product_rows(typed, ["product_id"], at).select(*PRODUCT.names).join(
        products.select("product_id"), "product_id", "left_anti"
    )
    pairs = one_each.select("product_id", "description", "embedding").join(
        embeddings.select("product_id"), "product_id", "left_anti"
    )
    numbered = continue_ids(pairs, embeddings, ["product_id"], "embedding_id")
    return new_products.select(*PRODUCT.names), numbered.withColumn("created_at", U.load_time(at))


def publish_with_embeddings(incoming: DataFrame, base: str, order_by: list[str], at: dt.datetime | None = None) -> None:
    """Add products and their vectors to the published tables, in one version."""
    spark = incoming.sparkSession
    products = published_or_empty(spark, base, "product", PRODUCT)
    embeddings = published_or_empty(spark, base, "product_embeddings", PRODUCT_EMBEDDINGS)
    rows, embedded = insert_with_embeddings(incoming, products, embeddings, order_by, at)
    publish(spark, base, {"product": rows, "product_embeddings": embedded}, append=True)
