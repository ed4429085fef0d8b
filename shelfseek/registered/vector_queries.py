"""Chunks, vectors and search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions import vectors as V
from shelfseek.functions.arrays import item_rows
from shelfseek.functions.text import sentences, squash, word_tokens
from shelfseek.operators import catalog as C
from shelfseek.operators import chunking as K
from shelfseek.operators import embedding as E
from shelfseek.operators import latent as LT
from shelfseek.operators import sentences as S
from shelfseek.operators import topk as R
from shelfseek.operators.nearest import COSINE, nearest
from shelfseek.operators.pivots import nearest_join
from shelfseek.operators.quality import check_vectors
from shelfseek.operators.reports import matched_products
from shelfseek.plans import ann, compressed, filtered
from shelfseek.plans.index import CHUNKS, build_index, chunk_vectors
from shelfseek.plans.search import request_vectors, search
from shelfseek.registered import views as W
from shelfseek.registered.registry import query
from shelfseek.sources.publish import publish, read_published, response_documents
from shelfseek.workspace import new_path

def shown_distance() -> Column:
    return F.round("distance", 6).alias("distance")


def _hits(spark, sf_dir, k: int, **options) -> DataFrame:
    return nearest(W.vectors(spark, sf_dir), request_vectors(W.requests(spark, sf_dir, k), W.DIM), W.DIM, **options)


# --- chunks -----------------------------------------------------------------------------------------


@query("t1_recursive_chunks", f"WITH RECURSIVE {W.character_chunks_sql()} SELECT * FROM chunks")
def t1(spark, sf_dir):
    return K.character_chunks(W.documents(spark, sf_dir)).select("product_id", "chunk_idx", "chunk_text")


@query("t1_recursive_chunks_whole_text", f"""SELECT doc_id AS product_id, 0::BIGINT AS n_too_long,
  regexp_replace(text, '{W.sql_space()}+', '', 'g') AS letters FROM documents
WHERE regexp_replace(text, '{W.sql_space()}+', '', 'g') <> ''""")
def t1_whole(spark, sf_dir):
    """Without overlap the chunks of a text hold each of its letters once, in order, none longer than 512."""
    chunks = K.character_chunks(W.documents(spark, sf_dir), overlap=0)
    letters = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_text"))), lambda c: c["chunk_text"]), ""
    )
    grouped = chunks.groupBy("product_id").agg(
        F.count_if(F.length("chunk_text") > K.CHUNK_SIZE).alias("n_too_long"), letters.alias("joined")
    )
    return grouped.select("product_id", "n_too_long", F.replace(squash(F.col("joined")), F.lit(" "), F.lit("")).alias("letters"))


@query("t2_paragraph_chunks", f"""WITH RECURSIVE {W.paragraphs_sql()}
SELECT product_id, chunk_idx::BIGINT AS chunk_idx, chunk_text FROM chunks""")
def t2(spark, sf_dir):
    chunks = K.paragraph_chunks(W.documents(spark, sf_dir))
    return chunks.select("product_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_text")


@query("t3_sentence_split", f"""WITH {W.sentences_sql()}
SELECT product_id, i::BIGINT AS position, s AS sentence FROM sents""")
def t3(spark, sf_dir):
    rows = item_rows(W.documents(spark, sf_dir), sentences(F.col("text")), "place", "sentence")
    return rows.select("product_id", (F.col("place") + 1).cast("bigint").alias("position"), "sentence")


def _logs_sql(hits: str, total: str, share: str) -> str:
    return f"""(CASE WHEN {hits} > 0 THEN {hits} * ln(greatest({share}, 1e-300)) ELSE 0 END
  + CASE WHEN {total} - {hits} > 0 THEN ({total} - {hits}) * ln(greatest(1 - ({share}), 1e-300)) ELSE 0 END)"""


def _trained_sql() -> str:
    """``trained(product_id, i, w, ends)``: the words of every document and whether each closes a sentence."""
    opening, closing = S.OPENING.replace("'", "''"), S.CLOSING.replace("'", "''")
    return f"""words AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '{W.sql_space()}+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS a
  FROM documents),
tokens AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM words),
stems AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(w, '{opening}', ''), '{closing}', '')), '\\.$', '') AS stem,
  ends_with(regexp_replace(w, '{opening}', ''), '.') AS point FROM tokens),
typed AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(stem, '^[0-9]+$') THEN '{S.NUMBER}' ELSE stem END AS type FROM stems),
counts AS (SELECT type, (count(*) FILTER (WHERE point))::DOUBLE AS p, (count(*) FILTER (WHERE NOT point))::DOUBLE AS q FROM typed WHERE type <> '' GROUP BY type),
sums AS (SELECT sum(p + q) AS n, sum(p) AS points FROM counts),
abbreviations AS (SELECT type FROM (
  SELECT type, p, q, length(type) - length(replace(type, '.', '')) AS inner_, length(replace(type, '.', ''))::DOUBLE AS letters,
    2 * ({_logs_sql('p', '(p + q)', f'{S.POINT_SHARE}::DOUBLE')} - {_logs_sql('p', '(p + q)', '(points / n)')}) AS ratio FROM counts, sums)
  WHERE p > 0 AND p + q >= {S.LEAST_SEEN} AND (regexp_matches(type, '\\p{{L}}') OR type = '{S.NUMBER}')
  AND ratio * exp(-letters) * (inner_ + 1) * pow(letters, -q) >= {S.ABBREVIATION_FROM}),
judged AS MATERIALIZED (SELECT *, regexp_matches(w, '[!?]$') OR (ends_with(w, '.') AND type NOT IN (SELECT type FROM abbreviations)
  AND NOT regexp_matches(type, '{S.INITIAL}')) AS sure FROM typed),
neighbours AS MATERIALIZED (SELECT *, lag(sure) OVER (PARTITION BY doc_id ORDER BY i) AS follows, lead(type) OVER (PARTITION BY doc_id ORDER BY i) AS next_type,
  lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next_word FROM judged),
firsts AS (SELECT type, count(*)::DOUBLE AS f FROM neighbours WHERE follows AND type <> '' GROUP BY type),
starters AS (SELECT type FROM (
  SELECT type, f, p + q AS seen, sum(f) OVER () AS breaks, n FROM firsts JOIN counts USING (type), sums)
  WHERE f / breaks > seen / n AND regexp_matches(type, '^\\p{{L}}') AND 2 * (
    {_logs_sql('f', 'breaks', '(f / breaks)')} + {_logs_sql('(seen - f)', '(n - breaks)', '((seen - f) / (n - breaks))')}
    - {_logs_sql('f', 'breaks', '(seen / n)')} - {_logs_sql('(seen - f)', '(n - breaks)', '(seen / n)')}) >= {S.STARTER_FROM}),
trained AS (SELECT doc_id AS product_id, i, w, sure OR (ends_with(w, '.') AND coalesce(
  regexp_matches(regexp_replace(next_word, '{opening}', ''), '^\\p{{Lu}}') AND next_type IN (SELECT type FROM starters), false)) AS ends FROM neighbours)"""


@query("t3_sentence_split_trained", f"""WITH {_trained_sql()},
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY product_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS position
  FROM trained)
SELECT product_id, position::BIGINT AS position, string_agg(w, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY product_id, position""")
def t3_trained(spark, sf_dir):
    """Abbreviations, ordinals and sentence starters learned from all documents."""
    docs = W.documents(spark, sf_dir)
    model = S.learn(docs)
    rows = item_rows(docs, S.split_sentences(F.col("text"), model), "place", "sentence")
    return rows.select("product_id", (F.col("place") + 1).cast("bigint").alias("position"), "sentence")


def spaced_sql(c: str) -> str:
    """SQL for text with one space between tokens; the same rules as the Spark chain."""
    steps = [
        (W.sql_space() + "+", " "), ("([:,])([^0-9])", r" \1 \2"), ("([:,])$", r" \1 "), (r"(\.{2,})", r" \1 "),
        ("([;@#$%&?!()<>])", r" \1 "), ("(--)", r" \1 "), (r"([^. ])\.( |$)", r"\1 . "),
        (r"(?i)\b(can)(not)\b", r"\1 \2"), (r"(?i)\b(gim|lem)(me)\b", r"\1 \2"),
        (r"(?i)\b(gon|wan)(na)\b", r"\1 \2"), (r"(?i)\b(got)(ta)\b", r"\1 \2"), (" +", " "),
    ]
    for pattern, replacement in steps:
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return f"trim({c}, ' ')"


@query("t4_word_tokens", f"""WITH t AS (SELECT doc_id, {spaced_sql("text")} AS s FROM documents)
SELECT doc_id AS product_id, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END::BIGINT AS n_tokens,
       s AS tokens FROM t""")
def t4(spark, sf_dir):
    rows = W.documents(spark, sf_dir).select("product_id", word_tokens(F.col("text")).alias("t"))
    return rows.select(
        "product_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query("d2_indexed_product_count", f"""WITH RECURSIVE {W.paragraphs_sql()}
SELECT count(DISTINCT product_id) AS products_indexed FROM chunks""")
def d2(spark, sf_dir):
    return K.indexed_products(K.paragraph_chunks(W.documents(spark, sf_dir)))


@query("d4_chunks_per_product", f"""WITH RECURSIVE {W.paragraphs_sql()}
SELECT product_id, count(*) AS n_chunks FROM chunks GROUP BY product_id""")
def d4(spark, sf_dir):
    return K.chunks_per_product(K.paragraph_chunks(W.documents(spark, sf_dir)))


@query("f1_distinct_chunk_texts", f"""WITH RECURSIVE {W.paragraphs_sql()}
SELECT DISTINCT chunk_text FROM chunks""")
def f1(spark, sf_dir):
    return K.distinct_texts(K.paragraph_chunks(W.documents(spark, sf_dir)))


# --- vectors ----------------------------------------------------------------------------------------

@query("v1_embed_chunks", f"""WITH {W.hashed('documents', 'doc_id', 'text', 'd')}
SELECT doc_id AS product_id, b AS place, round(x, 6) AS weight
FROM (SELECT doc_id, unnest(range({W.DIM})) AS b, unnest(e)::DOUBLE AS x FROM d) WHERE x <> 0""")
def v1(spark, sf_dir):
    embedded = E.embed(W.documents(spark, sf_dir), "text", W.DIM)
    places = item_rows(embedded, F.col("embedding"), "place", "x").where("x <> 0")
    return places.select(
        "product_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("x").cast("double"), 6).alias("weight")
    )


#: Given axes of the latent embedder: the entry of a place along an axis is a rule over small whole numbers.
LATENT_PLACES, LATENT_DIM = 4096, 4


def _given_axes() -> np.ndarray:
    place, axis = np.mgrid[:LATENT_PLACES, :LATENT_DIM]
    return ((place * 31 + axis * 17) % 13 - 6).astype(np.float64)


@query("v1_latent_given_axes", f"""WITH words AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
counts AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {LATENT_PLACES} AS p, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL),
held AS (SELECT p, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS rarity FROM counts GROUP BY p),
along AS (
  SELECT doc_id, axis, sum(ln(1 + n) * rarity * ((p * 31 + axis * 17) % 13 - 6)) AS x
  FROM counts JOIN held USING (p), range({LATENT_DIM}) t(axis) GROUP BY ALL),
sizes AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM along GROUP BY ALL)
SELECT d.doc_id AS product_id, a.axis::BIGINT AS axis, round(coalesce(x / size, 0)::FLOAT::DOUBLE, 5) AS weight
FROM documents d CROSS JOIN range({LATENT_DIM}) a(axis) LEFT JOIN along USING (doc_id, axis) LEFT JOIN sizes USING (doc_id)""")
def v1_latent_given_axes(spark, sf_dir):
    """The learned embedder's expression with the rarity of all documents' words and axes that are given."""
    docs = W.documents(spark, sf_dir)
    rarity = LT.place_rarity(docs.select(E.word_hashes(F.coalesce("text", F.lit(""))).alias("hashes")), LATENT_PLACES)
    embedded = docs.select("product_id", LT.latent_vector(F.col("text"), rarity, _given_axes()).alias("embedding"))
    places = item_rows(embedded, F.col("embedding"), "axis", "x")
    weight = F.round(F.col("x").cast("double"), 5)
    return places.select("product_id", F.col("axis").cast("bigint").alias("axis"), weight.alias("weight"))


@query("v1_learned_embedding", """SELECT doc_id AS product_id, 64::BIGINT AS dim,
  CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS size FROM documents""")
def v1_learned_embedding(spark, sf_dir):
    """Axes learned from all documents; the SQL knows of the vectors that they are of unit length."""
    docs = W.documents(spark, sf_dir)
    model = LT.learn(docs, "text", 64, places=1 << 15)
    embedded = docs.select("product_id", model.embedder("latent-64").vector(F.col("text")).alias("embedding"))
    return embedded.select(
        "product_id", F.size("embedding").cast("bigint").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("size")
    )


@query("v3_knn_l2_squared", f"""WITH {W.hits(10)}
SELECT query_id, chunk_id, product_id, rank, round(distance, 6) AS distance FROM hits""")
def v3(spark, sf_dir):
    return _hits(spark, sf_dir, 10).select(
        "query_id", "chunk_id", "product_id", F.col("rank").cast("bigint").alias("rank"), shown_distance()
    )


@query("c7_query_by_vector_cross", f"""WITH {W.hits(50)}
SELECT query_id, chunk_id, round(distance, 6) AS distance FROM hits""")
def c7(spark, sf_dir):
    """Every query against every vector without broadcasting either table: a join pruned by pivots."""
    return _hits(spark, sf_dir, 50, max_broadcast_numbers=32 * W.DIM).select(
        "query_id", "chunk_id", shown_distance()
    )


@query("c7_pivot_join", """WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
    round(pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2), 9) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs)
SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 10""")
def c7_join(spark, sf_dir):
    """Every twentieth vector as a query against all."""
    vectors = W.vectors(spark, sf_dir)
    queries = vectors.where(F.col("chunk_id") % 20 == 0).select(
        F.col("chunk_id").alias("query_id"), F.lit(10).alias("k"), "embedding"
    )
    return nearest_join(vectors, queries, W.DIM).hits.select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), shown_distance()
    )


@query("b11_filtered_cells", """WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label::BIGINT AS category_id,
    round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs)
SELECT query_id, chunk_id, category_id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 10""")
def b11_cells(spark, sf_dir):
    """Every twentieth vector asks for the nearest ones of its own category, in all cells that hold it."""
    vectors = W.vectors(spark, sf_dir).withColumn("category_id", F.col("product_id"))
    index = filtered.write_filtered_cells(vectors, ann.sampled_centres(vectors, W.DIM), W.DIM)
    queries = vectors.where(F.col("chunk_id") % 20 == 0).select(
        F.col("chunk_id").alias("query_id"), F.lit(10).alias("k"), "category_id", "embedding"
    )
    found = filtered.search_filtered_cells(index, queries, W.DIM, exact=True)
    return found.select(
        "query_id", "chunk_id", F.col("product_id").alias("category_id"), F.col("rank").cast("bigint").alias("rank"),
        shown_distance(),
    )


@query("v4_knn_l2_ids", f"""WITH {W.hits(5)}
SELECT query_id, chunk_id, rank, round(sqrt(distance), 6) AS distance FROM hits""")
def v4(spark, sf_dir):
    return _hits(spark, sf_dir, 5).select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"),
        F.round(F.sqrt("distance"), 6).alias("distance"),
    )


_COSINE = "1 - list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[])"


@query("v5_similar_idx", f"""WITH {W.hits(1, distance=_COSINE)}
SELECT query_id, chunk_id, round(1 - distance, 6) AS similarity FROM hits""")
def v5(spark, sf_dir):
    return _hits(spark, sf_dir, 1, measure=COSINE).select(
        "query_id", "chunk_id", F.round(1 - F.col("distance"), 6).alias("similarity")
    )


def _with_bad_vectors(vectors: DataFrame) -> DataFrame:
    """Every vector, and for each of them a null, a short and a NaN vector under other ids."""
    e = F.col("embedding")
    shapes = [
        e, F.lit(None).cast("array<float>"), F.slice(e, 1, W.DIM - 1),
        F.transform(e, lambda x, i: F.when(i == 0, float("nan")).otherwise(x).cast("float")),
    ]
    mixed = W.variants(vectors, "v", shapes)
    return mixed.select((F.col("chunk_id") * 4 + F.col("variant")).alias("chunk_id"), "product_id", F.col("v").alias("embedding"))


@query("v6_knn_cosine_guarded", f"""WITH {W.hits(5, distance=_COSINE)}
SELECT query_id, chunk_id * 4 AS chunk_id, rank, round(1 - distance, 6) AS similarity FROM hits""")
def v6(spark, sf_dir):
    vectors = _with_bad_vectors(W.vectors(spark, sf_dir))
    queries = request_vectors(W.requests(spark, sf_dir, 5), W.DIM).where(V.norm(F.col("embedding")) > 0)
    return nearest(vectors, queries, W.DIM, COSINE).select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"),
        F.round(1 - F.col("distance"), 6).alias("similarity"),
    )


@query("v7_ann_topk")
def v7(spark, sf_dir):
    """Learned centres and codebooks; the estimates' best are compared exactly."""
    vectors = W.vectors(spark, sf_dir)
    written = compressed.write_compressed(vectors, compressed.learn(vectors, W.DIM, measure=COSINE), W.DIM, COSINE)
    index = compressed.open_compressed(spark, written.path, W.DIM, COSINE)
    found = compressed.search_compressed(index, request_vectors(W.requests(spark, sf_dir, 10), W.DIM))
    return found.select("query_id", "chunk_id", "rank", shown_distance())


_FIRST = """counted AS (SELECT round(sqrt(count(*)))::BIGINT AS cells FROM embeddings),
firsts AS (SELECT vec_id, embedding::DOUBLE[] AS c, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS nth FROM embeddings),
centres AS (SELECT nth AS cell, c FROM firsts, counted WHERE nth < cells),
placed AS (SELECT vec_id, embedding::DOUBLE[] AS e, arg_min(cell, (round(pow(list_distance(embedding::DOUBLE[], c), 2), 9), cell)) AS cell
           FROM embeddings, centres GROUP BY vec_id, embedding)"""


@query("v7_compressed_given_codebook", f"""WITH {_FIRST},
lefts AS (SELECT vec_id, cell, c, e, list_transform(e, lambda x, i: x - c[i]) AS l FROM placed JOIN centres USING (cell)),
parts AS (SELECT vec_id, m, l[m * 8 + 1:m * 8 + 8] AS p FROM lefts, range(8) AS r(m)),
entries AS (SELECT m, nth - cells AS j, p AS b FROM parts JOIN firsts USING (vec_id), counted WHERE nth >= cells AND nth < cells + 16),
coded AS (SELECT vec_id, m, arg_min(b, (round(pow(list_distance(p, b), 2), 9), j)) AS b FROM parts JOIN entries USING (m) GROUP BY vec_id, m),
known AS (SELECT vec_id, cell, list_transform(any_value(c), lambda x, i: x + flatten(list(b ORDER BY m))[i]) AS about
  FROM coded JOIN lefts USING (vec_id) GROUP BY vec_id, cell),
{W.hashed('benchmark', 'item_id', 'text', 'q')},
probed AS (SELECT item_id, cell FROM q, centres
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(pow(list_distance(e::DOUBLE[], c), 2), 9), cell) <= 4),
short AS (SELECT item_id, vec_id FROM q JOIN probed USING (item_id) JOIN known USING (cell)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(pow(list_distance(e::DOUBLE[], about), 2), 9), vec_id) <= 30),
pairs AS (SELECT item_id AS query_id, vec_id AS chunk_id, round(pow(list_distance(q.e::DOUBLE[], v.embedding::DOUBLE[]), 2), 9) AS distance
  FROM short JOIN q USING (item_id) JOIN embeddings v USING (vec_id)),
hits AS (SELECT *, {W.RANK} AS rank FROM pairs)
SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM hits WHERE rank <= 10""")
def v7_compressed_given(spark, sf_dir):
    """The first vectors by md5 are the centres, the next sixteen give the codebooks; four cells, thirty exact comparisons."""
    vectors = W.vectors(spark, sf_dir)
    cells = round(vectors.count() ** 0.5)
    rows = compressed.first_vectors(vectors, W.DIM, cells + 16)
    blank = compressed.Codebook(rows[:cells], np.zeros((8, 1, 8)))
    others = rows[cells:]
    entries = blank.parts_of(others - blank.centres[blank.cells_of(others)[:, 0]]).transpose(1, 0, 2)
    index = compressed.write_compressed(vectors, compressed.Codebook(rows[:cells], entries), W.DIM)
    asked = request_vectors(W.requests(spark, sf_dir, 10), W.DIM)
    found = compressed.search_compressed(index, asked, probes=4, shortlist=3)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), shown_distance())


@query("v7_ann_topk_all_cells", f"""WITH {W.hits(10, distance=_COSINE)}
SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM hits""")
def v7_all(spark, sf_dir):
    """Looking into every cell is exact."""
    vectors = W.vectors(spark, sf_dir)
    index = ann.write_cells(vectors, ann.train_centres(vectors, W.DIM, cells=16), W.DIM)
    asked = request_vectors(W.requests(spark, sf_dir, 10), W.DIM)
    found = ann.search_cells(index, asked, W.DIM, probes=16)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), shown_distance())


@query("v7_ann_given_centres", f"""WITH centres AS (
  SELECT nth AS cell, c FROM (SELECT embedding AS c, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS nth FROM embeddings)
  WHERE nth < (SELECT round(sqrt(count(*))) FROM embeddings)),
placed AS (SELECT vec_id, arg_max(cell, (round(list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[]), 9), -cell)) AS cell
           FROM embeddings, centres GROUP BY vec_id),
{W.hashed('benchmark', 'item_id', 'text', 'q')},
probed AS (
  SELECT item_id, cell, row_number() OVER (PARTITION BY item_id ORDER BY
    round(coalesce(CASE WHEN list_sum(e) <> 0 THEN list_cosine_similarity(e::DOUBLE[], c::DOUBLE[]) END, 0), 9) DESC, cell) AS nth FROM q, centres),
pairs AS (
  SELECT q.item_id AS query_id, v.vec_id AS chunk_id, round({_COSINE}, 9) AS distance
  FROM q JOIN probed p ON p.item_id = q.item_id AND nth <= 3 JOIN placed USING (cell) JOIN embeddings v USING (vec_id)),
hits AS (SELECT *, {W.RANK} AS rank FROM pairs)
SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM hits WHERE rank <= 10""")
def v7_given(spark, sf_dir):
    """Some of the vectors are the centres; every query looks into three cells."""
    vectors = W.vectors(spark, sf_dir)
    index = ann.write_cells(vectors, ann.sampled_centres(vectors, W.DIM), W.DIM)
    found = ann.search_cells(index, request_vectors(W.requests(spark, sf_dir, 10), W.DIM), W.DIM, probes=3)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), shown_distance())


@query("v9_vector_contract", f"""SELECT reason, count(*) AS n_vectors FROM (
  SELECT unnest(['ok', 'null vector', 'wrong dimension', 'not finite']) AS reason FROM embeddings)
GROUP BY reason""")
def v9(spark, sf_dir):
    good, bad = check_vectors(_with_bad_vectors(W.vectors(spark, sf_dir)), W.DIM)
    judged = good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason"))
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n_vectors"))


# --- search -----------------------------------------------------------------------------------------


@query("b6_distance_cutoff", f"""WITH {W.hits(400)}
SELECT query_id, chunk_id, round(distance, 6) AS distance FROM hits WHERE NOT distance > 2.0""")
def b6(spark, sf_dir):
    return C.within_cutoff(_hits(spark, sf_dir, 400)).select("query_id", "chunk_id", shown_distance())


@query("e3_best_hit_per_product", f"""WITH {W.hits(100)}, {W.BEST}
SELECT query_id, product_id, chunk_id, {W.RANK} AS rank FROM best""")
def e3(spark, sf_dir):
    best = R.best_hit_per_product(C.within_cutoff(_hits(spark, sf_dir, 100)))
    return best.select("query_id", "product_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query("d3_matched_ids", f"""WITH {W.hits(100)}, {W.BEST}
SELECT DISTINCT query_id, product_id FROM best""")
def d3(spark, sf_dir):
    return matched_products(C.within_cutoff(_hits(spark, sf_dir, 100)))


_SEARCH = f"""{{hits}}, {W.BEST}, {W.PRODUCTS},
found AS (SELECT b.query_id, {W.RANK.replace('query_id', 'b.query_id')} AS rank, p.*, distance, chunk_id
          FROM best b JOIN products p USING (product_id) {{where}})"""


def search_sql(k: int, where: str = "") -> str:
    return _SEARCH.format(hits=W.hits(k), where=where)


_CARD = "query_id, rank, product_id, title, category, store, price, average_rating, rating_number"


def card(results: DataFrame) -> DataFrame:
    names = [name.strip() for name in _CARD.split(",")]
    return results.withColumn("rank", F.col("rank").cast("bigint")).select(*names, shown_distance())


def semantic_search(spark, sf_dir, k: int = 100) -> DataFrame:
    found = search(W.requests(spark, sf_dir, k), W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM)
    return card(found)


@query("v8_semantic_search", f"WITH {search_sql(100)} SELECT {_CARD}, round(distance, 6) AS distance FROM found")
def v8(spark, sf_dir):
    return semantic_search(spark, sf_dir)


@query("v8_semantic_search_k400", f"WITH {search_sql(400)} SELECT {_CARD}, round(distance, 6) AS distance FROM found")
def v8_deep(spark, sf_dir):
    return semantic_search(spark, sf_dir, 400)


_TEXT_SEARCH = f"""WITH {W.hashed('benchmark', 'item_id', 'text', 'q')},
{W.hashed('documents', 'doc_id', 'text', 'd')},
pairs AS (
  SELECT q.item_id AS query_id, d.doc_id AS product_id,
         round(pow(list_distance(q.e::DOUBLE[], d.e::DOUBLE[]), 2), 9) AS distance FROM q, d),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, product_id) AS rank FROM pairs)
SELECT query_id, rank, product_id, source AS title, round(distance, 6) AS distance
FROM hits JOIN documents ON doc_id = product_id WHERE rank <= 10 AND NOT distance > 2.0"""


@query("v8_text_search", _TEXT_SEARCH)
def v8_text(spark, sf_dir):
    """Search texts against whole documents, one vector per document."""
    docs = W.documents(spark, sf_dir)
    vectors = E.embed(docs, "text", W.DIM).withColumn("chunk_id", F.col("product_id"))
    titles = W.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("product_id"), F.col("source").alias("title")
    )
    found = search(W.requests(spark, sf_dir, 10), vectors, titles, W.DIM)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "product_id", "title", shown_distance())


@query("v8_chunk_search", f"""WITH RECURSIVE {W.paragraphs_sql()},
keyed AS (SELECT product_id * 16777216 + chunk_idx AS chunk_id, product_id, chunk_text FROM chunks),
{W.hashed('benchmark', 'item_id', 'text', 'q')},
{W.hashed('keyed', 'chunk_id', 'chunk_text', 'd')},
pairs AS (
  SELECT q.item_id AS query_id, chunk_id, product_id,
         round(pow(list_distance(q.e::DOUBLE[], d.e::DOUBLE[]), 2), 9) AS distance FROM q, d JOIN keyed USING (chunk_id)),
hits AS (
  SELECT * FROM (SELECT *, {W.RANK} AS rank FROM pairs) WHERE rank <= 20),
{W.BEST}
SELECT query_id, {W.RANK} AS rank, product_id, chunk_id, source AS title, round(distance, 6) AS distance
FROM best JOIN documents ON doc_id = product_id""")
def v8_chunks(spark, sf_dir):
    """From texts to results in one plan: documents are chunked, embedded and searched."""
    vectors = chunk_vectors(W.documents(spark, sf_dir), W.DIM, K.paragraph_chunks)
    titles = W.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("product_id"), F.col("source").alias("title")
    )
    found = search(W.requests(spark, sf_dir, 20), vectors, titles, W.DIM)
    return found.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "product_id", "chunk_id", "title", shown_distance()
    )


@query("v10_build_vector_table", f"""WITH RECURSIVE {W.character_chunks_sql()}
SELECT product_id * 16777216 + chunk_idx AS chunk_id, product_id, chunk_idx, chunk_text,
       CASE WHEN regexp_matches(chunk_text, '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM chunks""")
def v10(spark, sf_dir):
    built = chunk_vectors(W.documents(spark, sf_dir), W.DIM)
    return built.select(
        "chunk_id", "product_id", "chunk_idx", "chunk_text", F.round(V.norm(F.col("embedding")), 4).alias("norm")
    )


@query("v10_build_vector_table_paragraphs", f"""WITH RECURSIVE {W.paragraphs_sql()},
keyed AS (SELECT product_id * 16777216 + chunk_idx AS chunk_id, product_id, chunk_text FROM chunks),
{W.hashed('keyed', 'chunk_id', 'chunk_text', 'd')}
SELECT chunk_id, product_id, length(chunk_text) AS n_chars, len(list_filter(e, lambda x: x <> 0))::BIGINT AS n_places,
       round(list_sum(e::DOUBLE[]), 5) AS total, round(list_sum(list_transform(range({W.DIM}), lambda i: i * e[i + 1]::DOUBLE)), 4) AS moment
FROM d JOIN keyed USING (chunk_id)""")
def v10_paragraphs(spark, sf_dir):
    built = chunk_vectors(W.documents(spark, sf_dir), W.DIM, K.paragraph_chunks)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    weights = F.transform("embedding", lambda x: x.cast("double"))
    return built.select(
        "chunk_id", "product_id", F.length("chunk_text").cast("bigint").alias("n_chars"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("n_places"),
        F.round(add(weights), 5).alias("total"),
        F.round(add(F.transform(weights, lambda x, i: x * i)), 4).alias("moment"),
    )


@query("b9_existing_products_only", f"WITH {search_sql(100, chr(10) + 'WHERE p.category <> ' + chr(39) + 'ECONOMY' + chr(39))} "
       f"SELECT {_CARD}, round(distance, 6) AS distance FROM found")
def b9(spark, sf_dir):
    """The catalog no longer has the products of one category; their hits vanish and ranks close up."""
    left = W.products(spark, sf_dir).where("category <> 'ECONOMY'")
    return card(search(W.requests(spark, sf_dir, 100), W.vectors(spark, sf_dir), left, W.DIM))


_FILTERED = "(SELECT e.* FROM embeddings e JOIN part ON p_partkey = label WHERE p_type IN ('ECONOMY', 'SMALL'))"


@query("b11_category_filter", f"""WITH {W.hits(10, _FILTERED)}
SELECT query_id, chunk_id, product_id, rank, round(distance, 6) AS distance FROM hits""")
def b11(spark, sf_dir):
    wanted = C.in_categories(W.products(spark, sf_dir), ["ECONOMY", "SMALL"])
    vectors = W.vectors(spark, sf_dir).join(wanted.select("product_id"), "product_id", "left_semi")
    found = nearest(vectors, request_vectors(W.requests(spark, sf_dir, 10), W.DIM), W.DIM)
    return found.select("query_id", "chunk_id", "product_id", F.col("rank").cast("bigint").alias("rank"), shown_distance())


@query("c1_hits_join_products", f"""WITH {W.hits(20)}, {W.PRODUCTS}
SELECT query_id, chunk_id, product_id, title, price FROM hits JOIN products USING (product_id)""")
def c1(spark, sf_dir):
    joined = C.join_products(_hits(spark, sf_dir, 20), W.products(spark, sf_dir))
    return joined.select("query_id", "chunk_id", "product_id", "title", "price")


@query("c2_chunk_to_product", f"""WITH {W.hits(20)}
SELECT query_id, chunk_id, label::BIGINT AS product_id FROM hits JOIN embeddings ON vec_id = chunk_id""")
def c2(spark, sf_dir):
    hits = _hits(spark, sf_dir, 20).select("query_id", "chunk_id")
    return hits.join(W.vectors(spark, sf_dir).select("chunk_id", "product_id"), "chunk_id").select(
        "query_id", "chunk_id", "product_id"
    )


@query("e4_paginate", f"""WITH {W.hits(100)},
n AS (SELECT query_id, count(*) AS n_results FROM hits GROUP BY query_id)
SELECT query_id, chunk_id, rank, n_results, ceil(rank / 10)::BIGINT AS page, ceil(n_results / 10)::BIGINT AS n_pages,
       ceil(rank / 10) * 10 < n_results AS has_more FROM hits JOIN n USING (query_id)""")
def e4(spark, sf_dir):
    paged = R.paginate(_hits(spark, sf_dir, 100))
    return paged.select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "n_results", "page", "n_pages", "has_more"
    )


@query("a10_result_json_sink", f"""WITH {search_sql(100)},
docs AS (SELECT query_id, list({{'product_id': product_id, 'title': title, 'store': store}} ORDER BY rank) AS results
         FROM found GROUP BY query_id)
SELECT query_id, to_json({{'query': text, 'results': results}})::VARCHAR AS response
FROM docs JOIN benchmark ON item_id = query_id""")
def a10(spark, sf_dir):
    asked = W.requests(spark, sf_dir, 100)
    found = search(asked, W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM)
    documents = response_documents(
        found.join(asked.select("query_id", "query"), "query_id"), ["product_id", "title", "store"]
    )
    path = new_path(spark, "responses")
    documents.write.json(path)
    return spark.read.schema("query_id bigint, response string").json(path)


# --- published vector tables ------------------------------------------------------------------------

_CHUNK_ROWS = f"""WITH RECURSIVE {W.paragraphs_sql()}
SELECT product_id * 16777216 + chunk_idx AS chunk_id, product_id, chunk_idx::BIGINT AS chunk_idx, chunk_text,
       {W.DIM}::BIGINT AS dim FROM chunks"""


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id", "product_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_text",
        F.size("embedding").cast("bigint").alias("dim"),
    )


@query("a7_chunk_artifact_sink", _CHUNK_ROWS)
def a7(spark, sf_dir):
    base = new_path(spark, "index")
    publish(spark, base, {CHUNKS: chunk_vectors(W.documents(spark, sf_dir), W.DIM, K.paragraph_chunks)})
    return _chunk_rows(read_published(spark, base, CHUNKS))


@query("a8_reuse_or_build", f"""WITH RECURSIVE {W.paragraphs_sql()},
n AS (SELECT product_id, count(*) AS n_chunks FROM chunks GROUP BY product_id)
SELECT product_id, n_chunks, true AS built_first, false AS built_again FROM n""")
def a8(spark, sf_dir):
    base = new_path(spark, "index")
    docs = W.documents(spark, sf_dir)
    _, first = build_index(docs, base, W.DIM, K.paragraph_chunks)
    chunks, again = build_index(docs, base, W.DIM, K.paragraph_chunks)
    return K.chunks_per_product(chunks).select(
        "product_id", "n_chunks", F.lit(first).alias("built_first"), F.lit(again).alias("built_again")
    )


_CHANGED = """changed AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'Changed. ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 1)"""


@query("a8_follow_changes", f"""WITH RECURSIVE {_CHANGED}, {W.paragraphs_sql('changed')}
SELECT product_id, count(*) AS n_chunks, bool_or(starts_with(chunk_text, 'Changed.')) AS changed FROM chunks GROUP BY product_id""")
def a8_changes(spark, sf_dir):
    """Some documents go and some change between two builds; the second one follows."""
    base = new_path(spark, "index")
    docs = W.documents(spark, sf_dir)
    build_index(docs, base, W.DIM, K.paragraph_chunks)
    text = F.when(F.col("product_id") % 10 == 3, F.concat(F.lit("Changed. "), "text")).otherwise(F.col("text"))
    chunks, _ = build_index(docs.where("product_id % 7 <> 1").withColumn("text", text), base, W.DIM, K.paragraph_chunks)
    return chunks.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(F.col("chunk_text").startswith("Changed.")).alias("changed")
    )


def _shape_model() -> E.Embedder:
    """A stand-in for a trained model: four plain measures of a text."""
    return lambda texts: [[len(t) / 4096, t.count("e") / 512, t.count("\n") / 64, t.count(" ") / 1024] for t in texts]


def _shape_sql(source: str, key: str, name: str) -> str:
    counted = ", ".join(
        f"(length(text) - length(replace(text, {sign}, ''))) / {scale}.0" for sign, scale in (("'e'", 512), ("chr(10)", 64), ("' '", 1024))
    )
    return f"{name} AS (SELECT {key}, [length(text) / 4096.0, {counted}]::FLOAT[] AS e FROM {source})"


@query("v8_model_search", f"""WITH {_shape_sql('benchmark', 'item_id', 'q')}, {_shape_sql('documents', 'doc_id', 'd')},
pairs AS (SELECT q.item_id AS query_id, d.doc_id AS product_id,
  round(list_sum(list_transform(list_zip(q.e, d.e), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))), 9) AS distance FROM q, d),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, product_id) AS rank FROM pairs)
SELECT query_id, rank, product_id, round(distance, 6) AS distance FROM hits WHERE rank <= 10 AND NOT distance > 2.0""")
def v8_model(spark, sf_dir):
    """An index and a search with a model of the user's."""
    model = E.from_model("shape-1", 4, _shape_model)
    docs = W.documents(spark, sf_dir)
    whole = lambda df: df.select(
        F.col("product_id").alias("chunk_id"), "product_id", F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk_text")
    )
    vectors, _ = build_index(docs, new_path(spark, "index"), 4, whole, embedder=model, settings="whole texts")
    found = search(W.requests(spark, sf_dir, 10), vectors, docs.select("product_id"), 4, embedder=model)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "product_id", shown_distance())
