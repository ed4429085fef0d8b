"""The given tables read as the canonical catalog tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.functions.arrays import item_rows
from shelfseek.workspace import spread

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("store"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_size") / 10).alias("average_rating"),
        F.col("p_size").cast("bigint").alias("rating_number"),
    )


PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS title, p_type AS category, p_brand AS store,
         p_retailprice AS price, p_size / 10.0::DOUBLE AS average_rating, p_size::BIGINT AS rating_number
  FROM part)"""


def documents(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """(product_id, text, …) of all documents; a small file is spread over the cores."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), "text", *kept)
    return spread(docs, "product_id")


def requests(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(k).alias("k"),
        F.lit(1).alias("user_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("product_id"), "embedding"
    )


def variants(df: DataFrame, name: str, values: list[Column]) -> DataFrame:
    """Every row once per value, numbered: the given texts plus shapes that they do not contain."""
    return item_rows(df, F.array(*values), "variant", name)


def hashed(source: str, key: str, text: str, name: str, dim: int = DIM) -> str:
    """SQL for the hashed unit vectors of a text column: ``name(key, e FLOAT[])``."""
    return f"""{name}_words AS (
  SELECT {key}, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
{name}_counts AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b, count(*) AS n
  FROM {name}_words WHERE w <> '' GROUP BY ALL),
{name}_norms AS (SELECT {key}, sqrt(sum(n * n)) AS z FROM {name}_counts GROUP BY ALL),
{name}_places AS (SELECT {key}, unnest(range({dim})) AS b FROM {source}),
{name} AS (
  SELECT {key}, list(coalesce(n / z, 0)::FLOAT ORDER BY b) AS e
  FROM {name}_places LEFT JOIN {name}_counts USING ({key}, b) LEFT JOIN {name}_norms USING ({key})
  GROUP BY {key})"""


def hits(k: int, vectors_sql: str = "embeddings", distance: str | None = None) -> str:
    """SQL for the k nearest vectors of every search text: ``hits(query_id, chunk_id, product_id, …)``."""
    measure = distance or "pow(list_distance(q.e::DOUBLE[], v.embedding::DOUBLE[]), 2)"
    return f"""{hashed('benchmark', 'item_id', 'text', 'q')},
pairs AS (
  SELECT q.item_id AS query_id, v.vec_id AS chunk_id, v.label::BIGINT AS product_id,
         round({measure}, 9) AS distance
  FROM q, {vectors_sql} v),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
                 FROM pairs) WHERE rank <= {k})"""


BEST = """best AS (
  SELECT * EXCLUDE (rank, nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY distance, chunk_id) AS nth
    FROM hits WHERE NOT distance > 2.0) WHERE nth = 1)"""

RANK = "row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)"

_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def sql_space() -> str:
    return _SPACE


def sentences_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""split AS (
  SELECT {key} AS product_id, list_filter(string_split(
    regexp_replace(trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'), ' '), '([.!?]) ', '\\1' || chr(1), 'g'),
    chr(1)), lambda s: s <> '') AS a FROM {source}),
sents AS (
  SELECT product_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM split)"""


def paragraphs_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """``chunks(product_id, chunk_idx, chunk_text)``: sentences packed up to 100 words. Needs RECURSIVE."""
    return f"""{sentences_sql(source, key, text)},
sized AS MATERIALIZED (
  SELECT *, len(list_filter(string_split(s, ' '), lambda w: w <> '')) AS n FROM sents),
walk AS (
  SELECT product_id, i, 0 AS chunk_idx, n AS words, s FROM sized WHERE i = 1
  UNION ALL
  SELECT z.product_id, z.i, CASE WHEN w.words + z.n > 100 THEN w.chunk_idx + 1 ELSE w.chunk_idx END,
         CASE WHEN w.words + z.n > 100 THEN z.n ELSE w.words + z.n END, z.s
  FROM walk w JOIN sized z ON z.product_id = w.product_id AND z.i = w.i + 1),
chunks AS (
  SELECT product_id, chunk_idx, string_agg(s, ' ' ORDER BY i) AS chunk_text FROM walk GROUP BY ALL)"""


def character_chunks_sql() -> str:
    """``chunks(product_id, chunk_idx, chunk_text)``: character windows of documents. Needs RECURSIVE.

    Covers what the documents hold: lines, and words shorter than a window; no empty lines. ``full_at`` says
    where a window that starts at s overflows, ``again`` from where the next one may start.
    """
    return f"""lines AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE length(text) > 512)),
cut AS (
  SELECT doc_id, i, CASE WHEN i > 1 THEN chr(10) || line ELSE line END AS line FROM lines),
runs AS (
  SELECT *, 2 * count_if(length(line) >= 512) OVER (PARTITION BY doc_id ORDER BY i) + (length(line) < 512)::INT AS seg
  FROM cut WHERE line <> ''),
pieces AS (
  SELECT doc_id, seg, i, 0 AS w, line AS piece FROM runs WHERE seg % 2 = 1
  UNION ALL
  SELECT doc_id, seg, i, w, CASE WHEN w > 1 THEN ' ' || word ELSE word END FROM (
    SELECT doc_id, seg, i, unnest(a) AS word, generate_subscripts(a, 1) AS w
    FROM (SELECT doc_id, seg, i, string_split(line, ' ') AS a FROM runs WHERE seg % 2 = 0))
  WHERE w > 1 OR word <> ''),
numbered AS (
  SELECT doc_id, seg, piece, length(piece) AS n, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i, w) AS j,
         sum(length(piece)) OVER (PARTITION BY doc_id, seg ORDER BY i, w) AS upto FROM pieces),
lists AS (SELECT doc_id, seg, list(piece ORDER BY j) AS a, max(j) AS last FROM numbered GROUP BY ALL),
full_at AS (
  SELECT s.doc_id, s.seg, s.j AS s, min(e.j) AS e
  FROM numbered s JOIN numbered e ON e.doc_id = s.doc_id AND e.seg = s.seg AND e.j > s.j AND e.j <= s.j + 513
    AND e.upto - s.upto + s.n > 512 GROUP BY ALL),
again AS (
  SELECT e.doc_id, e.seg, e.j AS e, coalesce(min(s.j), e.j) AS back
  FROM numbered e LEFT JOIN numbered s ON e.doc_id = s.doc_id AND e.seg = s.seg AND s.j < e.j AND s.j >= e.j - 51
    AND e.upto - e.n - s.upto + s.n <= least(50, 512 - e.n) GROUP BY e.doc_id, e.seg, e.j),
jumps AS (SELECT doc_id, seg, s, e, greatest(s, back) AS next FROM full_at JOIN again USING (doc_id, seg, e)),
walk AS (
  SELECT doc_id, seg, 1::BIGINT AS s FROM lists
  UNION ALL
  SELECT w.doc_id, w.seg, next FROM walk w JOIN jumps j ON j.doc_id = w.doc_id AND j.seg = w.seg AND j.s = w.s),
texts AS (
  SELECT w.doc_id, w.seg, w.s, array_to_string(list_slice(a, w.s, coalesce(j.e - 1, last)), '') AS chunk
  FROM walk w JOIN lists l USING (doc_id, seg) LEFT JOIN jumps j ON j.doc_id = w.doc_id AND j.seg = w.seg AND j.s = w.s
  UNION ALL
  SELECT doc_id, 0, 0, text FROM documents WHERE length(text) <= 512),
stripped AS (SELECT doc_id, seg, s, regexp_replace(chunk, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS chunk_text FROM texts),
chunks AS (
  SELECT doc_id AS product_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg, s) - 1)::INT AS chunk_idx, chunk_text
  FROM stripped WHERE chunk_text <> '')"""
