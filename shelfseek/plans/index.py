"""Build the table of chunk vectors, reuse it while its source is unchanged, and follow changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.operators.chunking import character_chunks
from shelfseek.operators.embedding import DIM, TextEmbedder, hashing
from shelfseek.sources.publish import fingerprint, latest, publish, read_published

CHUNKS = "chunk_vectors"
SOURCES = "chunk_sources"

Chunker = Callable[[DataFrame], DataFrame]


def chunk_vectors(
    docs: DataFrame, dim: int = DIM, chunker: Chunker = character_chunks, embedder: TextEmbedder | None = None
) -> DataFrame:
    """(product_id, text) → one embedded row per chunk, in one pass and without a shuffle."""
    chunks = chunker(docs.select("product_id", "text"))
    vector = (embedder or hashing(dim)).vector
    return chunks.withColumn("embedding", vector(F.coalesce("chunk_text", F.lit(""))))


def _settings(dim: int, chunker: Chunker, embedder: TextEmbedder | None, settings: str) -> str:
    """What the vectors depend on beside the texts. Give ``settings`` where a chunker's name does not say it."""
    named = settings or getattr(chunker, "__qualname__", "")
    if not named or "<" in named:
        raise ValueError("name the chunker and its sizes with settings=")
    return f"{(embedder or hashing(dim)).name}/{named}"


def build_index(
    docs: DataFrame,
    base: str,
    dim: int = DIM,
    chunker: Chunker = character_chunks,
    rebuild: bool = False,
    embedder: TextEmbedder | None = None,
    settings: str = "",
) -> tuple[DataFrame, bool]:
    """(chunk vectors, whether anything was built now).

    The published table is used again if it was built from exactly these documents with these settings. If
    only documents have changed, only new and changed ones are chunked and embedded again, and the rows of
    changed and removed ones go. ``product_id`` names a document; rows that share it are one document.
    """
    spark = docs.sparkSession
    how = _settings(dim, chunker, embedder, settings)
    mark = f"{how}/{fingerprint(docs, 'product_id', 'text')}"
    published = latest(spark, base).get(CHUNKS)
    if published is not None and published[1] == mark and not rebuild:
        return read_published(spark, base, CHUNKS), False
    texts = docs.groupBy("product_id").agg(F.sum(F.xxhash64("text").cast("decimal(38,0)")).alias("text_hash"))
    changed, kept = docs, None
    if published is not None and published[1].startswith(f"{how}/") and not rebuild:
        same = texts.join(read_published(spark, base, SOURCES), ["product_id", "text_hash"], "left_semi")
        changed = docs.join(same.select("product_id"), "product_id", "left_anti")
        kept = read_published(spark, base, CHUNKS).join(same.select("product_id"), "product_id", "left_semi")
    built = chunk_vectors(changed, dim, chunker, embedder)
    every = built if kept is None else built.unionByName(kept)
    publish(spark, base, {CHUNKS: every, SOURCES: texts}, mark)
    return read_published(spark, base, CHUNKS), True
