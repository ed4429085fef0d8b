"""Search over cells among the vectors of one category.

An index of cells keeps each vector's ``category_id`` and the number of vectors per cell and category. A query
walks its cells from the nearest on and skips those that hold nothing of its category, so a rare category is
looked for in more cells than a common one, and only in cells where it occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfseek.operators.nearest import COSINE, nearest
from shelfseek.plans.ann import PROBED_SHARE, CellIndex, nearest_cells, write_cells

SPARE = 8


def _group(cell: Column, category: Column) -> Column:
    """One number for a cell and a category; the id of a category must fit 31 bits."""
    fits = (category >= 0) & (category < 2**31)
    checked = F.when(fits, category.cast("bigint")).otherwise(F.raise_error(F.lit("category_id beyond 31 bits")))
    return cell.cast("bigint") * 2**31 + checked.cast("bigint")


def write_filtered_cells(vectors: DataFrame, centres: np.ndarray, dim: int) -> CellIndex:
    """Write (chunk_id, product_id, category_id, embedding) by cells, with the counts; no category, no entry."""
    index = write_cells(vectors.where("category_id is not null"), centres, dim)
    stored = vectors.sparkSession.read.parquet(f"{index.path}/vectors")
    stored.groupBy("cell", "category_id").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{index.path}/counts")
    return index


def search_filtered_cells(
    index: CellIndex, queries: DataFrame, dim: int, exact: bool = False, spare: int = SPARE,
    probes: int | None = None, measure: str = COSINE,
) -> DataFrame:
    """The k nearest vectors with the ``category_id`` of the query, as ``nearest`` returns them.

    A query looks into its nearest cells that hold the category until ``spare`` * k vectors of it have been
    seen, and into at least ``probes`` such cells; with ``exact`` into all of them. Either way it gets k hits
    wherever the category has k vectors. A query without a category gets none.
    """
    spark = queries.sparkSession
    cells = len(index.centres)
    least = min(cells, probes or max(1, round(cells * PROBED_SHARE)))
    counts = spark.read.parquet(f"{index.path}/counts")
    near = nearest_cells(F.col("embedding"), index.centres, cells)
    walked = queries.where((F.size("embedding") == dim) & F.col("category_id").isNotNull()).select(
        "query_id", "k", "category_id", F.posexplode(near).alias("place", "cell")
    )
    holding = walked.join(counts, ["cell", "category_id"])
    if not exact:
        way = Window.partitionBy("query_id").orderBy("place")
        seen = holding.withColumn("before", F.sum("n").over(way) - F.col("n")).withColumn("nth", F.row_number().over(way))
        holding = seen.where((F.col("before") < F.col("k") * F.lit(spare).cast("bigint")) | (F.col("nth") <= least))
    wanted = [row[0] for row in holding.select("cell").distinct().collect()]
    chosen = holding.groupBy("query_id").agg(F.collect_set(_group(F.col("cell"), F.col("category_id"))).alias("cells"))
    asked = queries.select("query_id", "k", "embedding").join(chosen, "query_id")
    stored = spark.read.parquet(f"{index.path}/vectors").where(F.col("cell").isin(wanted))
    vectors = stored.withColumn("cell", _group(F.col("cell"), F.col("category_id")))
    return nearest(vectors, asked, dim, measure)
