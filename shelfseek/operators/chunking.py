"""Cut texts into chunks: overlapping character windows, or paragraphs of whole sentences."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions.arrays import item_rows
from shelfseek.functions.text import has_text, sentences, strip
from shelfseek.operators.keys import chunk_key

CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
PARAGRAPH_WORDS = 100
# Where a text is cut, coarsest first; the last one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cuts(text: str, mark: str) -> Iterator[str]:
    """Cut before every ``mark`` (it stays with what follows); the empty mark cuts between characters."""
    if not mark:
        return iter(text)
    head, *tail = text.split(mark)
    return filter(None, [head, *(mark + rest for rest in tail)])


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Fill windows of at most ``size`` characters that share up to ``overlap`` with the next one."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, level: int = 0) -> list[str]:
    """The chunks of one text. An oversized piece is cut again at the next finer separator."""
    if not text:
        return []
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    chunks: list[str] = []
    waiting: list[str] = []

    def flush() -> None:
        chunks.extend(filter(None, (window.strip() for window in _packed(waiting, size, overlap))))
        waiting.clear()

    for piece in _cuts(text, SEPARATORS[level]):
        if len(piece) < size:
            waiting.append(piece)
            continue
        flush()
        if level + 1 < len(SEPARATORS):
            chunks.extend(split_text(piece, size, overlap, level + 1))
        else:
            chunks.append(piece)
    flush()
    return chunks


def _chunk_rows(df: DataFrame, pieces: Column) -> DataFrame:
    kept = [name for name in df.columns if name != "text"]
    rows = item_rows(df, pieces, "chunk_idx", "chunk_text")
    key = chunk_key(F.col("product_id"), F.col("chunk_idx"))
    return rows.select(key.alias("chunk_id"), *kept, "chunk_idx", "chunk_text")


def character_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(product_id, text, …) → one row per chunk; a blank text gives none. No shuffle.

    A text that fits into one chunk is that chunk, stripped, and never leaves the JVM.
    """

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda text: split_text(text, size, overlap))

    long = F.length("text") > size
    whole = F.when(has_text(F.col("text")), F.array(strip(F.col("text"))))
    return _chunk_rows(docs, F.when(long, split(F.when(long, F.col("text")))).otherwise(whole))


def paragraphs(text: Column, target_words: int = PARAGRAPH_WORDS, split: Callable[[Column], Column] = sentences) -> Column:
    """Whole sentences packed in order until the next one would exceed ``target_words``; ``split`` cuts them."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("words"))
    # A sentence has single spaces only, and none at its ends.
    sized = F.transform(
        split(text),
        lambda s: F.struct(s.alias("s"), (F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1).alias("n")),
    )

    def closed(state: Column) -> Column:
        return F.concat(state["done"], F.array(F.array_join(state["open"], " ")))

    def step(state: Column, sentence: Column) -> Column:
        alone, n = F.array(sentence["s"]), sentence["n"]
        full = (state["words"] + n > target_words) & (state["words"] > 0)
        return F.when(
            full, F.struct(closed(state).alias("done"), alone.alias("open"), n.alias("words"))
        ).otherwise(
            F.struct(
                state["done"].alias("done"), F.concat(state["open"], alone).alias("open"),
                (state["words"] + n).alias("words"),
            )
        )

    def finish(state: Column) -> Column:
        return F.when(state["words"] > 0, closed(state)).otherwise(state["done"])

    return F.aggregate(sized, start, step, finish)


def paragraph_chunks(
    docs: DataFrame, target_words: int = PARAGRAPH_WORDS, split: Callable[[Column], Column] = sentences
) -> DataFrame:
    """(product_id, text, …) → one row per paragraph chunk. No shuffle, no Python.

    ``split`` may be a trained splitter, ``lambda text: split_sentences(text, model)``.
    """
    return _chunk_rows(docs, paragraphs(F.col("text"), target_words, split))


def chunks_per_product(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def indexed_products(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("product_id").alias("products_indexed"))


def distinct_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_text").distinct()
