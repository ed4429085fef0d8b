"""Publish several tables at once, and read what was published last.

Every run writes its tables into folders of its own. One small manifest row per table, written in a
single final job, makes all of them visible together; a run that fails before that leaves nothing that
readers can see, and readers of an earlier version keep their files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfseek.workspace import new_path

_MANIFEST = "name string, path string, fingerprint string"


def _versions(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_MANIFEST}, version bigint").json(f"{base}/_manifests")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest(spark: SparkSession, base: str) -> dict[str, tuple[list[str], str]]:
    """Name → (paths, fingerprint) of the tables published last."""
    versions = _versions(spark, base)
    if versions is None:
        return {}
    newest = versions.agg(F.max("version").alias("version"))
    tables: dict[str, tuple[list[str], str]] = {}
    for row in versions.join(newest, "version").orderBy("path").collect():
        paths, _ = tables.get(row["name"], ([], ""))
        tables[row["name"]] = ([*paths, row["path"]], row["fingerprint"])
    return tables


def publish(
    spark: SparkSession,
    base: str,
    tables: dict[str, DataFrame],
    fingerprint: str = "",
    replace_all: bool = False,
    append: bool = False,
) -> None:
    """Write the tables and make them the published version together.

    Tables of the previous version that are not given stay published, unless ``replace_all``. With ``append``
    the given rows are added to the published ones: the table gets one more path and nothing is written again.
    A run that finds its version's manifest in place fails. The check comes before the write, so runs that
    publish at the very same time need a lock of their own.
    """
    versions = _versions(spark, base)
    last = versions.agg(F.max("version")).first()[0] if versions is not None else None
    kept = {} if replace_all else latest(spark, base)
    for name, df in tables.items():
        path = f"{base}/runs/{new_path(spark, name).rsplit('/', 1)[1]}"
        df.write.parquet(path)
        earlier = kept[name][0] if append and name in kept else []
        kept[name] = ([*earlier, path], fingerprint)
    entries = [(name, path, mark) for name, (paths, mark) in kept.items() for path in paths]
    manifest = spark.createDataFrame(entries, _MANIFEST).coalesce(1)
    manifest.write.mode("errorifexists").json(f"{base}/_manifests/version={(last or 0) + 1}")


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(*latest(spark, base)[name][0])


def published_or_empty(spark: SparkSession, base: str, name: str, schema: StructType) -> DataFrame:
    """The published table, or one without rows before anything was published."""
    found = latest(spark, base).get(name)
    return spark.read.schema(schema).parquet(*found[0]) if found else spark.createDataFrame([], schema)


def fingerprint(df: DataFrame, key: str, *content: str) -> str:
    """Row count, largest key and order-free checksums of the content.

    Rows that occur an even number of times vanish from the xor, but not from the sums.
    """
    hashed = F.xxhash64(key, *content)
    wide = F.sum(hashed.cast("decimal(38,0)"))
    other = F.sum(F.xxhash64(F.lit("other"), key, *content).cast("decimal(38,0)"))
    seen = df.agg(F.count(F.lit(1)), F.max(key), F.bit_xor(hashed), wide, other).first()
    return "/".join(str(value) for value in seen)


def response_documents(results: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON document per query with its results in rank order (at most k of them)."""
    items = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    grouped = results.groupBy("query_id", "query").agg(items.alias("items"))
    listed = F.transform("items", lambda item: F.struct(*[item[c].alias(c) for c in columns]))
    body = F.struct(F.col("query"), listed.alias("results"))
    return grouped.select("query_id", F.to_json(body).alias("response"))
