"""Search requests as a stream: results and log entries per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfseek.operators.catalog import split_requests
from shelfseek.operators.embedding import TextEmbedder
from shelfseek.operators.reports import matched_products, query_volume
from shelfseek.operators.upsert import load_time
from shelfseek.plans.ann import CellIndex
from shelfseek.plans.search import search

# How long the log remembers a request's id.
REMEMBER = "7 days"


def request_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _per_batch(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch into its own folder; a replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stream_search(
    stream: DataFrame, vectors: DataFrame | CellIndex, products: DataFrame, dim: int, out: str, checkpoint: str,
    embedder: TextEmbedder | None = None, probes: int | None = None,
) -> StreamingQuery:
    """Append the results of every request to ``out``.

    With an index of cells a micro-batch reads the cells that its requests probe, not all vectors.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(search(batch, vectors, products, dim, embedder=embedder, probes=probes), out, batch_id)

    return _per_batch(stream, checkpoint, write)


def log_key(request_id: Column) -> Column:
    """A log id that is the same again when a batch is replayed."""
    return F.xxhash64(request_id)


def log_batch(batch: DataFrame, results: DataFrame, out: str, batch_id: int) -> None:
    """Write the log rows and the bridge rows of one batch of requests."""
    accepted, _ = split_requests(batch)
    entries = accepted.select(
        log_key(F.col("query_id")).alias("query_id"), F.col("query").alias("query_text"), "user_id",
        load_time().alias("timestamp"),
    )
    bridge = matched_products(results).withColumn("query_id", log_key(F.col("query_id")))
    _replace_batch(entries, f"{out}/query_log", batch_id)
    _replace_batch(bridge, f"{out}/query_log_product", batch_id)


def first_requests(stream: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """The requests of a stream without those whose query_id has come before, by time of arrival."""
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return arrived.dropDuplicatesWithinWatermark(["query_id"]).drop("_arrived")


def stream_query_log(
    stream: DataFrame, vectors: DataFrame, products: DataFrame, dim: int, out: str, checkpoint: str,
    embedder: TextEmbedder | None = None, remember: str = REMEMBER,
) -> StreamingQuery:
    """Search every request and log it with its matched products, once per query_id.

    A request that comes again, in the same batch, a later one or after a restart, is neither searched nor logged
    if the first came at most ``remember`` ago; the first to arrive counts. The ids are kept as keyed state next to
    the stream's progress and dropped when they are older. A null id is an id like any other. Many millions of ids
    want the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log_batch(batch, search(batch, vectors, products, dim, embedder=embedder), out, batch_id)

    return _per_batch(first_requests(stream, remember), checkpoint, write)


def stream_query_volume(
    stream: DataFrame, out: str, checkpoint: str, width: str = "1 day", lateness: str = "1 hour"
) -> StreamingQuery:
    """Searches per window and text, written again in every batch that changes them.

    Open windows are written too. A batch has a folder of its own that a replay replaces; the count of a
    window is the one of its last batch, see ``read_query_volume``. The log time has no zone and a watermark
    needs one, so the time is taken as UTC meanwhile.
    """
    zone = F.current_timezone()
    zoned = stream.withColumn("ts", F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), zone))
    counted = query_volume(zoned.withWatermark("ts", lateness), F.col("ts"), width).select(
        F.to_utc_timestamp("w.start", zone).cast("timestamp_ntz").alias("start"), "query_text", "n_searches"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(batch, out, batch_id)

    return (
        counted.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_VOLUME = "start timestamp_ntz, query_text string, n_searches bigint, batch_id bigint"


def read_query_volume(spark: SparkSession, out: str) -> DataFrame:
    """(start, query_text, n_searches): the latest count of every window."""
    versions = read_batches(spark, out, T.StructType.fromDDL(_VOLUME))
    return versions.groupBy("start", "query_text").agg(F.max_by("n_searches", "batch_id").alias("n_searches"))


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything the batches have written so far; empty before the first one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
