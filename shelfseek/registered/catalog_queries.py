"""Sources, sinks, filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.operators import catalog as C
from shelfseek.operators.chunking import paragraph_chunks
from shelfseek.operators.upsert import category_title
from shelfseek.plans.seeding import seed
from shelfseek.registered import views as W
from shelfseek.registered.registry import query
from shelfseek.registered.text_queries import clean_description_sql
from shelfseek.schemas import CATEGORY, PRODUCT
from shelfseek.sources import scan
from shelfseek.sources.csv_ranges import split_csv_descriptions, split_csv_rows
from shelfseek.workspace import new_path


def _described(spark, sf_dir) -> DataFrame:
    """All documents as products, plus products without a description for each of them."""
    docs = W.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("title"), "text"
    )
    shapes = [F.col("text"), F.lit(None).cast("string"), F.lit("   "), F.lit("\t")]
    shaped = W.variants(docs, "description", shapes)
    return shaped.select((F.col("doc_id") * 4 + F.col("variant")).alias("product_id"), "title", "description")


_DESCRIBED = """described AS (
  SELECT doc_id * 4 + unnest(range(4)) AS product_id, source AS title, unnest([text, NULL, '   ', chr(9)]) AS description
  FROM documents)"""


@query("a1_catalog_scan", f"""WITH {_DESCRIBED}
SELECT product_id, title, description FROM described WHERE description IS NOT NULL AND trim(description, ' ') <> ''""")
def a1(spark, sf_dir):
    return scan.catalog_scan(_described(spark, sf_dir))


_CSV = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "title", "description", "store")])


def _csv_folder(spark, sf_dir) -> str:
    """Write the parts as a catalog CSV in key order: quotes, line breaks and "no value" cells included."""
    part = W.table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("key"),
        F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n'), "p_brand").alias("title"),
        F.when(F.col("p_type") == "PROMO", "NA").when(F.col("p_type") == "SMALL", "  ")
        .otherwise(F.col("p_name")).alias("description"),
        F.when(F.col("p_type") == "LARGE", "null").when(F.col("p_type") == "MEDIUM", " ")
        .otherwise(F.col("p_brand")).alias("store"),
    )
    path = new_path(spark, "csv")
    ordered = rows.repartitionByRange(8, F.col("key").cast("bigint")).sortWithinPartitions(F.col("key").cast("bigint"))
    ordered.write.options(
        header=True, escape='"', quote='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


_A2_SQL = """SELECT p_partkey::VARCHAR AS key, p_name || ', "' || p_type || '"' || chr(10) || p_brand AS title,
  CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN '  ' ELSE p_name END AS description,
  CASE p_type WHEN 'LARGE' THEN NULL WHEN 'MEDIUM' THEN ' ' ELSE p_brand END AS store FROM part"""
_A3_SQL = """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS product_id, p_name AS text
FROM part QUALIFY p_type NOT IN ('PROMO', 'SMALL')"""


@query("a2_csv_scan", _A2_SQL)
def a2(spark, sf_dir):
    return scan.csv_scan(spark, _csv_folder(spark, sf_dir), _CSV)


@query("a2_csv_ranges", _A2_SQL)
def a2_csv_ranges(spark, sf_dir):
    """Every file by as many tasks as it has byte ranges."""
    return split_csv_rows(spark, _csv_folder(spark, sf_dir), _CSV).drop("row_number")


@query("a3_csv_description_scan", _A3_SQL)
def a3(spark, sf_dir):
    return scan.csv_descriptions(spark, _csv_folder(spark, sf_dir), _CSV)


@query("a3_csv_description_ranges", _A3_SQL)
def a3_csv_description_ranges(spark, sf_dir):
    return split_csv_descriptions(spark, _csv_folder(spark, sf_dir), _CSV)


def _text_folder(spark, sf_dir) -> str:
    """The documents as text files, in a folder per source."""
    path = new_path(spark, "texts")
    docs = W.table(spark, sf_dir, "documents").select("source", F.col("text").alias("value"))
    docs.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(path)
    return path


@query("a4_text_dir_scan", """WITH d AS (SELECT source, sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY source)
SELECT *, row_number() OVER (ORDER BY source) AS place FROM d""")
def a4(spark, sf_dir):
    """Documents written as text files per source and read back file by file, numbered in path order.

    The ids of all files follow each other without gaps, so a source's place is that of its smallest id.
    """
    files = scan.text_files(spark, _text_folder(spark, sf_dir), "source=(.*)/")
    found = files.groupBy(F.col("folder").alias("source")).agg(
        F.sum(F.length("text")).alias("n_chars"), F.min("product_id").alias("_first"), F.max("product_id").alias("_last"),
        F.countDistinct("product_id").alias("_ids"), F.count(F.lit(1)).alias("_files"),
    )
    # files of one source are neighbours: their ids are a range of their own
    whole = found.where("_ids = _files and _last - _first + 1 >= _files")
    place = F.row_number().over(Window.orderBy("_first")).cast("bigint")
    return whole.withColumn("place", place).select("source", "n_chars", "place")


@query("a5_document_source_fallback", f"""WITH {_DESCRIBED}
SELECT product_id, title AS text FROM described WHERE trim(description, ' ') <> ''
UNION ALL
SELECT product_id, p_name FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS product_id, p_name, p_type FROM part)
WHERE p_type NOT IN ('PROMO', 'SMALL')
UNION ALL SELECT -1, sum(length(text) + 1)::BIGINT::VARCHAR FROM documents""")
def a5(spark, sf_dir):
    """The catalog answers when it has described rows; with none of them, the CSV does; else the text files."""
    described = _described(spark, sf_dir)
    csv = _csv_folder(spark, sf_dir)
    none = described.withColumn("description", F.lit(None).cast("string"))
    full = scan.load_documents(described, csv, _CSV, csv)
    files = scan.load_documents(none, new_path(spark, "nothing"), _CSV, _text_folder(spark, sf_dir))
    letters = files.agg(F.sum(F.length("text")).cast("string").alias("text")).select(F.lit(-1).cast("bigint").alias("product_id"), "text")
    return full.unionByName(scan.load_documents(none, csv, _CSV, csv)).unionByName(letters)


@query("a6_raw_parquet_scan", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def a6(spark, sf_dir):
    schema = "p_partkey bigint, p_name string, p_type string, p_retailprice double"
    return scan.parquet_scan(spark, f"{sf_dir}/part.parquet", schema)


def _raw(spark, sf_dir) -> DataFrame:
    part = W.table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.when(F.col("p_size") > 3, F.col("p_retailprice")).alias("price"),
        F.filter(F.split("p_name", " "), lambda w: ~w.startswith("r")).alias("features"),
        F.filter(F.array("p_type"), lambda t: t != "PROMO").alias("description"),
        F.nullif("p_brand", F.lit("Brand#7")).alias("main_category"),
    )


@query("b2_raw_catalog_clean", """SELECT p_partkey, p_retailprice AS price, p_brand AS main_category FROM part
WHERE p_size > 3 AND len(list_filter(string_split(p_name, ' '), lambda w: NOT starts_with(w, 'r'))) > 0
  AND p_type <> 'PROMO' AND p_brand <> 'Brand#7'""")
def b2(spark, sf_dir):
    return C.complete_rows(_raw(spark, sf_dir)).select("p_partkey", "price", "main_category")


@query("b3_drop_null_columns", "SELECT * FROM part")
def b3(spark, sf_dir):
    empty = {name: F.lit(None).cast("string") for name in ("bought_together", "subtitle", "author")}
    return C.drop_null_columns(W.table(spark, sf_dir, "part").withColumns(empty))


def _wanted(spark, sf_dir) -> DataFrame:
    """Ids asked for: every label and, shifted by a large number, ids that no product has."""
    labels = W.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("product_id"))
    return labels.unionByName(labels.select((F.col("product_id") + 10**9).alias("product_id")))


@query("b4_product_by_id", f"WITH {W.PRODUCTS} SELECT * FROM products WHERE product_id IN (SELECT label FROM embeddings)")
def b4(spark, sf_dir):
    return C.products_by_id(W.products(spark, sf_dir), _wanted(spark, sf_dir))


@query("b5_title_by_id", """SELECT DISTINCT label::BIGINT AS product_id, p_name AS title FROM embeddings JOIN part ON p_partkey = label
UNION ALL SELECT DISTINCT label::BIGINT + 1000000000, NULL FROM embeddings""")
def b5(spark, sf_dir):
    return C.titles_by_id(W.products(spark, sf_dir), _wanted(spark, sf_dir))


@query("b7_blank_query_reject", """WITH r AS (
  SELECT item_id, unnest(range(6)) AS variant, unnest([text, '', '   ', chr(160), text, text]) AS query,
         unnest([5, 5, 5, 5, 0, -1]) AS k FROM benchmark)
SELECT item_id * 6 + variant AS query_id, query,
       CASE WHEN variant IN (1, 2, 3) THEN 'blank query' WHEN k < 1 THEN 'k below 1' END AS reason FROM r""")
def b7(spark, sf_dir):
    asked = W.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "sent")
    shapes = [F.col("sent"), F.lit(""), F.lit("   "), F.lit("\u00a0"), F.col("sent"), F.col("sent")]
    shaped = W.variants(asked, "query", shapes).select(
        (F.col("item_id") * 6 + F.col("variant")).alias("query_id"), "query",
        F.element_at(F.array(*[F.lit(k) for k in (5, 5, 5, 5, 0, -1)]), F.col("variant") + 1).alias("k"),
    )
    accepted, rejected = C.split_requests(shaped)
    both = accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("query_id", "query", "reason")


@query("b8_skip_no_text", """SELECT p_type AS category, count(*) AS n_rows,
  count_if(p_type <> 'PROMO' AND p_brand <> 'Brand#3') AS n_products FROM part GROUP BY p_type""")
def b8(spark, sf_dir):
    """A load adds no product for rows without any text; their category is created all the same."""
    part = W.table(spark, sf_dir, "part")
    textless = (F.col("p_type") == "PROMO") | (F.col("p_brand") == "Brand#3")
    given = {name: F.lit(None).cast("string") for name in ("store", "details", "features", "images", "average_rating", "rating_number")}
    raw = part.select(
        F.col("p_partkey").alias("row"), F.col("p_type").alias("main_category"), F.lit("\u00a0 ").alias("description"),
        F.when(textless, F.lit(" ")).otherwise(F.col("p_name")).alias("title"), F.lit("1").alias("price"),
    ).withColumns(given)
    load = seed(raw, spark.createDataFrame([], PRODUCT), spark.createDataFrame([], CATEGORY), ["row"])
    rows = raw.groupBy(category_title(F.col("main_category")).alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))
    added = load.products.groupBy(F.col("main_category_id").alias("category_id")).agg(F.count(F.lit(1)).alias("n"))
    counted = load.categories.join(added, "category_id", "left")
    return counted.select(F.col("title").alias("category"), F.coalesce("n", F.lit(0)).alias("n_products")).join(rows, "category")


@query("b10_result_projection", f"""WITH RECURSIVE {W.paragraphs_sql()}, {W.PRODUCTS},
h AS (SELECT product_id AS query_id, chunk_idx + 1 AS rank, product_id % (SELECT count(*) FROM part) AS product_id, chunk_text
      FROM chunks)
SELECT query_id, rank::BIGINT AS rank, product_id, title, {clean_description_sql('substr(chunk_text, 1, 300)')} AS description,
       price, average_rating, rating_number, store
FROM h JOIN products USING (product_id)""")
def b10(spark, sf_dir):
    """The chunks of a document as the ranked hits of one query, shown as cards."""
    products = W.products(spark, sf_dir)
    chunks = paragraph_chunks(W.documents(spark, sf_dir))
    hits = chunks.select(
        F.col("product_id").alias("query_id"), (F.col("chunk_idx") + 1).cast("bigint").alias("rank"),
        (F.col("product_id") % products.count()).alias("product_id"), "chunk_text",
    )
    return C.result_rows(C.join_products(hits, products))
