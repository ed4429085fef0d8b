"""Read catalogs: parquet, CSV, folders of text files, JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.functions.text import has_text, has_text_sql
from shelfseek.operators.keys import positional_ids

# Cell texts that mean "no value" in the catalog CSV.
NO_VALUE = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

MAX_BROADCAST_FILES = 100_000


def parquet_scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read parquet with a known schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def catalog_scan(products: DataFrame, ordered: bool = False) -> DataFrame:
    """The products with a description. Sorting a whole catalog is left to those who need it."""
    found = products.where(has_text_sql(F.col("description"))).select("product_id", "title", "description")
    return found.orderBy("product_id") if ordered else found


def csv_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV with a header and quoted, possibly multi-line cells; every column is text.

    A multi-line file is read by one task; give a large catalog as many files.
    """
    raw = (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE")
        .csv(path)
    )
    cells = [F.when(~F.col(name).isin(NO_VALUE), F.col(name)).alias(name) for name in schema.names]
    return raw.select(*cells)


def csv_rows(spark: SparkSession, path: str, schema: T.StructType, row_col: str = "row_number") -> DataFrame:
    """``csv_scan`` plus each row's 0-based position, files taken in name order.

    A file is read by one task, in which ids grow with the row, so a row's place in its file is its
    distance from the file's first id.
    """
    rows = csv_scan(spark, path, schema).select(
        F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_name").alias("_file"), "*"
    )
    files = rows.groupBy("_file").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    # One row per file, and the driver has listed the files anyway.
    small = len(rows.inputFiles()) <= MAX_BROADCAST_FILES
    placed = rows.join(F.broadcast(starts) if small else starts, "_file")
    position = F.col("_start") + F.col("_id") - F.col("_first")
    return placed.select(position.alias(row_col), *schema.names)


def csv_descriptions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(product_id, text): the described rows of a CSV, numbered by their position among all rows."""
    rows = csv_rows(spark, path, schema, "product_id")
    return rows.where(has_text(F.col("description"))).select("product_id", F.col("description").alias("text"))


def text_files(spark: SparkSession, folder: str, folder_pattern: str = "([^/]*)/[^/]*$") -> DataFrame:
    """(product_id, folder, text): every ``.txt`` file, numbered by its place among all files.

    ``folder`` is what the first group of ``folder_pattern`` finds in the file's path.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    texts = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    # The two readers print a path differently (file:/x and file:///x).
    plain = F.regexp_replace("path", r"^([a-z0-9]+):/+", "$1:/")
    numbered = positional_ids(listing.select(plain.alias("path")), ["path"], "product_id")
    return texts.withColumn("path", plain).join(numbered, "path").select(
        "product_id", F.regexp_extract("path", folder_pattern, 1).alias("folder"), "text"
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_documents(
    products: DataFrame, csv_path: str, csv_schema: T.StructType, text_folder: str, text_col: str = "title"
) -> DataFrame:
    """(product_id, text) from the catalog if it has rows, else the CSV if there is one, else text files."""
    spark = products.sparkSession
    catalog = catalog_scan(products)
    if not catalog.isEmpty():
        return catalog.select("product_id", F.col(text_col).alias("text"))
    if path_exists(spark, csv_path):
        return csv_descriptions(spark, csv_path, csv_schema)
    return text_files(spark, text_folder).select("product_id", "text")


def jdbc_options(
    url: str, table: str, user: str, password: str, lower: int, upper: int, partitions: int,
    key: str = "product_id",
) -> dict[str, str]:
    """Options for a partitioned JDBC read of a catalog table."""
    return {
        "url": url, "dbtable": table, "user": user, "password": password, "partitionColumn": key,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def jdbc_sink(rows: DataFrame, options: dict[str, str]) -> None:
    """Append rows to a database table, one connection per partition."""
    rows.write.format("jdbc").options(**options).mode("append").save()


def jdbc_scan(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
