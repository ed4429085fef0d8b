"""Line dedup over batches of documents, with levelled sorted runs of line hashes.

All line keys seen so far are kept as runs: tables hashed into buckets by line hash and sorted inside
every bucket. A batch of documents reduces its lines to (hash, smallest doc_id), anti-joins them with each
run in turn (a merge join, bucket by bucket, that does not shuffle the runs) and adds what is new as a run
of level 0. As soon as a level holds ``FAN_IN`` runs they are merged into one run of the next level, so
n batches leave about FAN_IN * log(n) runs to look into and every hash is rewritten log(n) times at most.

Batches are ranges of doc_id in ascending order, so the first batch that holds a line also holds the
smallest document with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.llm.common import WHITE, batches_of, text_bytes
from shelfseek.workspace import new_path

FAN_IN = 3
BATCHES = 6
MIN_POINTS = 10


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def _hash(key: bytes) -> bytes:
    """128 bits stand for a key: of 10**12 keys, two meet with a chance of about 10**-15."""
    return blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, points: int) -> bool:
    if len(key) < points:
        return False
    return len(key) >= 4 * points or len(key.decode("utf-8", "replace")) >= points


def line_hashes(docs: DataFrame, points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, h): the hashes of a row's line keys of at least ``points`` code points, each once."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            ids, hashes = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                keys = {key for key in map(line_key, text.split(b"\n")) if _long_enough(key, points)}
                ids += [doc_id] * len(keys)
                hashes += map(_hash, keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "h"]
            )

    return _texts(docs).mapInArrow(run, "doc_id bigint, h binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Runs:
    """The sorted runs of one job: bucketed tables of a database of their own, whose folder lies below the shared one."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.database = f"line_runs_{uuid.uuid4().hex}"
        folder = new_path(spark, "line-runs").replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{folder}'")

    def unseen(self, first: DataFrame) -> DataFrame:
        """The rows whose hash is in no run yet."""
        for level in self.levels:
            for run in level:
                first = first.join(self.spark.table(run).hint("merge"), "h", "left_anti")
        return first

    def add(self, rows: DataFrame, level: int = 0) -> DataFrame:
        """Write the rows as a run of ``level``; returns them as written. Merges full levels."""
        name = f"{self.database}.run_{uuid.uuid4().hex}"
        spread = rows.repartition(self.buckets, "h") if level else rows
        spread.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merge every level that holds ``fan_in`` runs into one run of the next level."""
        for level in range(len(self.levels)):
            full = self.levels[level]
            if len(full) < self.fan_in:
                continue
            merged = self.spark.table(full[0])
            for run in full[1:]:
                merged = merged.unionByName(self.spark.table(run))
            self.add(merged, level + 1)
            self.levels[level] = []
            for run in full:
                self.spark.sql(f"DROP TABLE {run}")

    def close(self) -> None:
        for run in [run for level in self.levels for run in level]:
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database}")


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares)).first()[0] if shares else None
    return sorted(set(cuts or []))


def repeated_lines(
    docs: DataFrame, batches: int = BATCHES, fan_in: int = FAN_IN, points: int = MIN_POINTS
) -> DataFrame:
    """(doc_id, h): the line keys that a document loses because an earlier document holds them."""
    spark = docs.sparkSession
    cuts = _cuts(docs, batches)
    lines_at, lost_at = new_path(spark, "line-hashes"), new_path(spark, "lines-lost")
    number = F.lit(0)
    for cut in cuts:
        number = number + F.coalesce(F.col("doc_id") > cut, F.lit(True)).cast("int")
    line_hashes(docs, points).withColumn("batch", number).write.partitionBy("batch").parquet(lines_at)
    lines = spark.read.schema("doc_id bigint, h binary, batch int").parquet(lines_at)
    runs = Runs(spark, fan_in)
    try:
        for batch in range(len(cuts) + 1):
            own = lines.where(F.col("batch") == batch).select("doc_id", "h")
            first = own.groupBy("h").agg(F.min("doc_id").alias("holder"))
            added = runs.add(runs.unseen(first))
            holds = own["doc_id"].eqNullSafe(added["holder"]) & (own["h"] == added["h"])
            own.join(added, holds, "left_anti").write.mode("append").parquet(lost_at)
            runs.compact()
    finally:
        runs.close()
    return spark.read.schema("doc_id bigint, h binary").parquet(lost_at)


def _without(text: bytes, lost: set[bytes], points: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not lost:
        return len(lines), 0, text
    kept = []
    for line in lines:
        key = line_key(line)
        if not (_long_enough(key, points) and _hash(key) in lost):
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(
    docs: DataFrame,
    columns: list[str] | None = None,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
    points: int = MIN_POINTS,
) -> DataFrame:
    """Every row of ``docs`` with ``doc_id``, ``text`` (without repeated lines), ``n_lines``, ``n_dropped``.

    Texts are split at line feeds; a null or empty text is one empty line and becomes an empty text. Lines
    are equal if their keys are; keys of at least ``points`` code points that several documents hold stay in
    the smallest doc_id among them, with all their repeats there, and go everywhere else. Rows with one
    doc_id are one document; rows without a doc_id are one document after all others. ``columns`` names
    further columns to hand through; they come as the struct ``rest``, so their names cannot clash. An empty
    table gives an empty result.
    """
    lost = repeated_lines(docs, batches, fan_in, points)
    sets = lost.groupBy(F.col("doc_id").alias("owner")).agg(F.collect_set("h").alias("lost"))
    rest = F.struct(*columns) if columns else F.struct(F.lit(0).alias("_"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest")
    )
    joined = rows.join(sets, F.col("doc_id").eqNullSafe(F.col("owner")), "left").drop("owner")

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            losses = [set(lost or ()) for lost in batch.column("lost").to_pylist()]
            found = [_without(t, lost, points) for t, lost in zip(text_bytes(batch), losses, strict=True)]
            n_lines, n_dropped, texts = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch.column("rest"),
                ],
                ["doc_id", "text", "n_lines", "n_dropped", "rest"],
            )

    kind = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id bigint, text string, n_lines bigint, n_dropped bigint, rest {kind}")
