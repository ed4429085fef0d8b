"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.llm import (
    collocations, licences, linededup, mixing, packing, periodicity, quality, sentencepieces, simhash, topk, toxicity,
    vectordedup, warc,
)
from shelfseek.llm.common import crc_remainder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


OP5_SQL = """WITH rows AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, r, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM rows),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
holders AS (SELECT k, min(doc_id) AS holder, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT keyed.*, coalesce(n > 1 AND doc_id <> holder, false) AS gone FROM keyed LEFT JOIN holders USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r"""


#: What the registered mixture asks for: four domains dealt by the source's number, weights by level.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "fr": 2, "de": 2, "es": 1}


def mixture_domain() -> Column:
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    return F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string"))


def mixture_weights() -> dict[str, Column]:
    def by(name: str, weights: dict[str, int]) -> Column:
        column = F.lit(1)
        for key, weight in weights.items():
            column = F.when(F.col(name) == key, weight).otherwise(column)
        return column

    return {"domain": by("domain", DOMAIN_WEIGHTS), "lang": by("lang", LANGUAGE_WEIGHTS), "source": F.lit(1)}


def _sql_level(name: str, parent: str, child: str, weight: str) -> str:
    """SQL that deals the budgets of table ``parent`` to the nodes ``child``, as table ``name``."""
    keys = {"domain": ["domain"], "lang": ["domain", "lang"], "source": ["domain", "lang", "source"]}[child]
    over = f"PARTITION BY {', '.join(keys[:-1])}" if keys[:-1] else ""
    link = f"JOIN {parent} USING ({', '.join(keys[:-1])})" if keys[:-1] else f"CROSS JOIN {parent}"
    before = f"OVER ({over} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_in AS (SELECT {', '.join(keys)}, sum(3 * supply)::DOUBLE AS cap, any_value({weight})::DOUBLE AS w
  FROM leaves GROUP BY {', '.join(keys)}),
{name}_level AS (SELECT *, (budget - coalesce(sum(cap) {before}, 0)) / (sum(w) OVER ({over}) - coalesce(sum(w) {before}, 0)) AS level
  FROM {name}_in {link}),
{name} AS (SELECT {', '.join(keys)},
  least(cap, coalesce(max(level) FILTER (WHERE cap / w > level) OVER ({over}), 'infinity'::DOUBLE) * w) AS budget
  FROM {name}_level)"""


def _sql_weights(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


OP1_SQL = f"""WITH measured AS (
  SELECT doc_id, 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) AS domain, lang, source,
         ceil(strlen(text) / 4)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM measured GROUP BY ALL),
root AS (SELECT floor(sum(supply) * 0.8::DOUBLE)::DOUBLE AS budget FROM leaves),
{_sql_level('domains', 'root', 'domain', _sql_weights('domain', DOMAIN_WEIGHTS))},
{_sql_level('langs', 'domains', 'lang', _sql_weights('lang', LANGUAGE_WEIGHTS))},
{_sql_level('sources', 'langs', 'source', '1')},
plan AS (SELECT domain, lang, source, supply, round(budget)::BIGINT AS budget,
  least(floor(round(budget) / supply), 3)::INT AS whole FROM leaves JOIN sources USING (domain, lang, source)),
placed AS (SELECT *, budget - whole * supply AS part,
  ('0x' || substr(md5('11:' || whole || ':' || doc_id), 1, 15))::BIGINT AS place FROM measured JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed),
copies AS (SELECT *, unnest(range(whole + (before < part)::INT)) AS epoch FROM summed)
SELECT doc_id, epoch::INT AS epoch, domain, lang, source, n_tokens, budget FROM copies"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixture_weights(), mixture_domain(), share_of_supply=0.8, max_epochs=3, seed=11)


TOXIC_FROM = 0.3
GOOD_FROM = 0.3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the rows that are not held out."""
    learned = labels.where(crc_remainder(F.col("doc_id"), 4) != 2)
    return toxicity.fit(docs, learned.select("doc_id", F.col("toxic").alias("label")))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_restored",
    )


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = crc_remainder(F.col("doc_id"), 5)
    labelled = labels.select("doc_id", F.col("quality").alias("label"))
    scored = quality.quality_scores(docs, labelled, learn_from=remainder != 0)
    return scored.select(
        "doc_id", (remainder == 0).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


def tokenizer_path() -> str:
    """The public byte-level vocabulary of the contract, from the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_vector_dedup")
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


OP10_SQL = """WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""


@query("op10_topk", OP10_SQL)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op4_warc_derivatives")
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return records.withColumnRenamed("key", "page_id").drop("header")


@query("op6_licences", licences.recognise_sql())
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.recognise(table(spark, sf_dir, "documents"))


def every_tenth_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the words of one document of ten repeat from some word on.

    With h the crc32 of the key as text and n words, the documents with h % 10 = 0 repeat from word
    a = h / 10 % n on with the period 1 + (n - a) / (3 + h / 10 % 8), all in whole numbers.
    """
    g = F.expr("h div 10")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " "))

    hashed = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.transform(F.array(words), repeated)[0])
    return hashed.select("doc_id", text.otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.periodic_runs(every_tenth_repeated(table(spark, sf_dir, "documents")))
    longest = F.reduce(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, run: F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best),
    )
    lines = F.transform("runs", lambda run: F.concat_ws(",", run.start, run.length, run.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def piece_model_path() -> str:
    """The public SentencePiece model of the contract, from the installed package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), piece_model_path())
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


OP11_SQL = """WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
  SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
counts AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
covers AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS f FROM (
  SELECT lang, w, a, k, unnest(generate_series(1, size - k + 1)) AS i
  FROM (SELECT *, unnest(generate_series(2, size - 1)) AS k FROM candidates WHERE size > 2)) GROUP BY ALL),
stay AS (SELECT c.* FROM candidates c LEFT JOIN covers USING (lang, phrase)
  WHERE f IS NULL OR 100::HUGEINT * f < 80::HUGEINT * a),
cuts AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM stay),
scored AS (SELECT x.lang, x.phrase, x.a, k, l.a AS l, r.a AS r,
  ((2000000::HUGEINT * x.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), at_least=30, first=2000)
