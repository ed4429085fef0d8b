"""First writer wins: appends that never touch an existing key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions.text import UNCATEGORIZED, clean_or
from shelfseek.operators.keys import continue_ids


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; pre-aggregated in every task, then one shuffle.

    ``order`` should tell the rows of a key apart; of rows that tie, any one is kept.
    """
    kept = F.struct(*[F.col(name) for name in rows.columns])
    first = rows.groupBy(*[F.col(name).alias(f"_{name}") for name in key]).agg(
        F.min_by(kept, F.struct(*order)).alias("_first")
    )
    return first.select("_first.*")


def insertable(target: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The incoming rows that an insert with "on conflict do nothing" would really add."""
    return first_per_key(incoming, key, order).join(target.select(*key), key, "left_anti")


def insert_ignore(target: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    added = insertable(target, incoming, key, order)
    return target.unionByName(added.select(*target.columns))


def category_title(main_category: Column) -> Column:
    return clean_or(main_category, UNCATEGORIZED)


def get_or_create_categories(rows: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all categories, the new ones) after every title of ``rows`` has got an id, in title order."""
    titles = rows.select(category_title(F.col("main_category")).alias("title")).distinct()
    missing = titles.join(categories.select("title"), "title", "left_anti")
    created = continue_ids(missing, categories, ["title"], "category_id")
    return categories.unionByName(created), created


def with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Resolve each row's category title to its id."""
    named = rows.withColumn("_title", category_title(F.col("main_category")))
    lookup = categories.select(F.col("title").alias("_title"), F.col("category_id").alias("main_category_id"))
    return named.join(lookup, "_title").drop("_title")


def missing_parents(referenced: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Placeholder rows for keys that are referenced but not there yet."""
    return referenced.dropDuplicates([key]).join(parents.select(key), key, "left_anti")


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What is left of a child table after its parents were deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def load_time(at: dt.datetime | None = None) -> Column:
    """The insert time, without zone; fixed where the caller gives one."""
    return F.localtimestamp() if at is None else F.lit(at.isoformat(" ")).cast("timestamp_ntz")
