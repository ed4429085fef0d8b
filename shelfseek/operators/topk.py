"""First rows per group, best hit per product, and result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PAGE = 10


def top_k_per_group(
    df: DataFrame, group: list[str], order: list[Column | str], k: int, rank_col: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group, with their rank.

    Spark cuts each task's rows to ``k`` per group before the one shuffle, so a hot group brings at most k
    rows from every task to the task that ranks it.
    """
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank_col, position).where(F.col(rank_col) <= k)


def best_hit_per_product(hits: DataFrame) -> DataFrame:
    """Keep the nearest chunk of every product of a query and rank the products anew.

    ``hits`` holds at most k rows per query.
    """
    order = [F.col("distance"), F.col("chunk_id")]
    nearest = F.row_number().over(Window.partitionBy("query_id", "product_id").orderBy(*order))
    best = hits.withColumn("_nth", nearest).where("_nth = 1").drop("_nth", "rank")
    return rerank(best)


def rerank(hits: DataFrame) -> DataFrame:
    """Rank the hits of each query by distance, ties by chunk."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return hits.withColumn("rank", place)


def paginate(ranked: DataFrame, page_size: int = ROWS_PER_PAGE) -> DataFrame:
    """Add the page of each ranked row, the number of pages and whether more pages follow."""
    results = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return (
        ranked.withColumn("n_results", results)
        .withColumn("page", F.ceil(F.col("rank") / page_size).cast("bigint"))
        .withColumn("n_pages", F.ceil(F.col("n_results") / page_size).cast("bigint"))
        .withColumn("has_more", F.col("page") * page_size < F.col("n_results"))
    )


def page_of(paged: DataFrame, page: int) -> DataFrame:
    return paged.where(F.col("page") == page)
