"""A training corpus from the table of documents, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet
and read again before the next one. All but the last return the columns of ``documents``; the last returns
the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.llm import linededup, mixing, packing, queries, simhash, toxicity
from shelfseek.llm.common import table
from shelfseek.workspace import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that reach the mixing stage that it hands on.
MIXED_SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores at ``TOXIC_FROM`` or more go, the others stay as they are."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, columns=["lang", "source", "n_chars"])
    return scored.where(F.col("score") < queries.TOXIC_FROM).select("doc_id", "text", "rest.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its lines stays with an empty text."""
    kept = linededup.dedup_lines(docs, columns=["lang", "source"])
    return kept.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.near_duplicates_dropped(docs, 4, 4, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights, every document once at most."""
    weights, domain = queries.mixture_weights(), queries.mixture_domain()
    mixed = mixing.mix(docs, weights, domain, share_of_supply=MIXED_SHARE, seed=11, columns=["text", "n_chars"])
    return mixed.select("doc_id", "rest.text", "lang", "source", "rest.n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the scores, SimHash groups or packing; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
