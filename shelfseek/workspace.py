"""Where intermediate and published tables go.

Everything that must outlive one task is written below the shared folder the session names in
``spark.checkpoint.dir``. Only a session that runs in one process gets a folder of its own without it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FEW_SPLITS = 4


def shared_root(spark: SparkSession) -> str:
    """The shared folder for written tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfseek-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the shared folder."""
    return f"{shared_root(spark)}/shelfseek/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a scan over all cores when the input is at most ``FEW_SPLITS`` splits.

    Meant for plain scans in front of CPU-heavy expressions. What is moved is bounded by the size of so many
    splits, on any number of cores; a larger input passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, FEW_SPLITS + 1):
        return df
    return df.repartition(cores, *keys)
