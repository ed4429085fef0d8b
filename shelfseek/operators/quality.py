"""Constraint checks as one report of (table, rule, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions import vectors as V


def _labelled(counted: DataFrame, table: str, rule: str) -> DataFrame:
    return counted.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
        F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations"),
    )


def duplicate_keys(df: DataFrame, table: str, rule: str, key: list[str], long_text: bool = False) -> DataFrame:
    """How many key values occur more than once. Long texts are compared and shuffled as SHA-256 digests."""
    parts = [F.unhex(F.sha2(F.col(name), 256)).alias(name) if long_text else F.col(name) for name in key]
    repeated = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _labelled(repeated.agg(F.count(F.lit(1)).alias("violations")), table, rule)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n_rows) of child keys without a parent; a hot key is counted before it is joined."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def foreign_key(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, table: str, rule: str
) -> DataFrame:
    lost = orphans(child, child_key, parent, parent_key)
    return _labelled(lost.agg(F.sum("n_rows").alias("violations")), table, rule)


def row_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """All rules that look at one row only, in a single pass; each column says what is wrong."""
    totals = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    pairs = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(rules)]
    )
    return totals.select(F.inline(pairs)).select(F.lit(table).alias("table_name"), "rule", "violations")


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_vectors(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors that keep the contract, and the others with the reason."""
    reason = (
        F.when(F.col("embedding").isNull(), "null vector")
        .when(F.size("embedding") != dim, "wrong dimension")
        .when(~V.is_valid(F.col("embedding"), dim), "not finite")
    )
    judged = vectors.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
