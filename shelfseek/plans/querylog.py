"""Log searches: one row per accepted request and one per matched product."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.operators.keys import continue_ids
from shelfseek.operators.reports import matched_products
from shelfseek.operators.upsert import load_time
from shelfseek.schemas import QUERY_LOG
from shelfseek.sources.publish import publish, published_or_empty


def log_queries(
    accepted: DataFrame, results: DataFrame, log: DataFrame, at: dt.datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """(log rows, bridge rows) to append. ``accepted`` and ``results`` share ``query_id``, the request.

    A request without results is logged too. Log ids continue the existing ones in request order.
    """
    requests = accepted.select(F.col("query_id").alias("request_id"), F.col("query").alias("query_text"), "user_id")
    numbered = continue_ids(requests, log, ["request_id"], "query_id")
    entries = numbered.select("query_id", "query_text", "user_id", load_time(at).alias("timestamp"))
    matched = matched_products(results).withColumnRenamed("query_id", "request_id")
    bridge = matched.join(numbered.select("request_id", "query_id"), "request_id")
    return entries, bridge.select("query_id", "product_id")


def publish_log(accepted: DataFrame, results: DataFrame, base: str, at: dt.datetime | None = None) -> None:
    """Add the log rows and the bridge rows of some searches to the published tables, in one version."""
    spark = accepted.sparkSession
    log = published_or_empty(spark, base, "query_log", QUERY_LOG)
    entries, bridge = log_queries(accepted, results, log, at)
    publish(spark, base, {"query_log": entries, "query_log_product": bridge}, append=True)
