"""Approximate search: vectors grouped into cells, each query looks into its nearest cells only.

The vector table is written partitioned by cell, next to the cells' centres, so that a later session can open
it again. A search reads only the probed folders. Vectors are never shuffled by cell for a search: a cell with
very many vectors is many files read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.functions import vectors as V
from shelfseek.operators.nearest import COSINE, nearest
from shelfseek.workspace import new_path

#: Share of the cells that a query looks into, if it does not say how many.
PROBED_SHARE = 1 / 8
# Similarities to centres are compared at this resolution; ties go to the smaller cell.
_DECIMALS = 9


@dataclass(frozen=True)
class CellIndex:
    """A written index: where it is, and the centres, one row per cell."""

    path: str
    centres: np.ndarray


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(V.is_valid(F.col("embedding"), dim))


def train_centres(vectors: DataFrame, dim: int, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Cell centres by k-means with the cosine measure, over all usable vectors.

    There are as many cells as the square root of the number of vectors, unless ``cells`` says otherwise:
    then finding cells and looking into one of them cost the same.
    """
    usable = _usable(vectors, dim)
    features = usable.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    number = cells or round(vectors.count() ** 0.5)
    trainer = KMeans(k=max(2, number), seed=seed, distanceMeasure="cosine", maxIter=10)
    return np.array(trainer.fit(features).clusterCenters())


def sampled_centres(vectors: DataFrame, dim: int) -> np.ndarray:
    """As many usable vectors as the square root of their number, by the smallest md5 of their ids, as centres.

    Only they reach the driver, without training; ids decide, so that the same table gives the same centres.
    """
    usable = _usable(vectors, dim)
    number = max(1, round(usable.count() ** 0.5))
    chosen = usable.orderBy(F.md5(F.col("chunk_id").cast("string")), "chunk_id").limit(number)
    return np.array([row["embedding"] for row in chosen.select("embedding").collect()], float)


def _units(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def nearest_cells(embedding: Column, centres: np.ndarray, number: int) -> Column:
    """The ``number`` cells whose centres are most similar, nearest first; the centres are sent out once."""
    units = _units(centres)

    @F.pandas_udf("array<int>")
    def cells(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in vectors:
            if series.empty:
                yield pd.Series([], dtype=object)
                continue
            likeness = np.round(_units(np.stack(series.to_numpy()).astype(float)) @ units.T, _DECIMALS)
            order = np.argsort(-likeness, axis=1, kind="stable")[:, :number]
            yield pd.Series(list(order.astype(np.int32)))

    return cells(embedding)


def write_cells(vectors: DataFrame, centres: np.ndarray, dim: int) -> CellIndex:
    """Write the usable vectors into one folder per cell, and the centres.

    The rebalance hint lets Spark split a large cell over several writers and merge small ones.
    """
    spark = vectors.sparkSession
    path = new_path(spark, "cells")
    own = nearest_cells(F.col("embedding"), centres, 1)[0]
    placed = _usable(vectors, dim).withColumn("cell", own)
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(cell, centre.tolist()) for cell, centre in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return CellIndex(path, centres)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    """An index that was written before."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return CellIndex(path, np.array([row["centre"] for row in rows]))


def search_cells(
    index: CellIndex, queries: DataFrame, dim: int, probes: int | None = None, measure: str = COSINE
) -> DataFrame:
    """The k most similar vectors among each query's ``probes`` nearest cells; other cells are not read.

    A task multiplies the rows of a cell with the queries that probe it, and with no others.
    """
    cells = len(index.centres)
    number = min(cells, probes or max(1, round(cells * PROBED_SHARE)))
    probed = _usable(queries, dim).withColumn("cells", nearest_cells(F.col("embedding"), index.centres, number))
    # at most as many numbers as there are cells
    wanted = [row[0] for row in probed.select(F.explode("cells")).distinct().collect()]
    vectors = queries.sparkSession.read.parquet(f"{index.path}/vectors").where(F.col("cell").isin(wanted))
    return nearest(vectors, probed, dim, measure)
