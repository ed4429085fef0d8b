from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfseek.operators import chunking as K
from shelfseek.operators.chunking import split_text
from shelfseek.operators.keys import chunk_key

TEXTS = st.lists(st.sampled_from(["a", "bb", "word" * 5, " ", "\n", "\n\n", "x" * 60, "é"]), max_size=120).map("".join)


@given(TEXTS, st.integers(10, 80), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_split_properties(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(0 < len(chunk) <= size for chunk in chunks)
    assert all(chunk == chunk.strip() and chunk in text for chunk in chunks)
    letters = {c for c in text if not c.isspace()}
    assert letters == {c for chunk in chunks for c in chunk if not c.isspace()}


@given(st.text(alphabet="ab \n", max_size=79))
@settings(max_examples=200, deadline=None)
def test_short_text_is_one_chunk(text):
    assert split_text(text, 80, 10) == ([text.strip()] if text.strip() else [])


def test_split_examples():
    assert split_text("") == [] and split_text(None) == [] and split_text(" \n ") == []
    assert [len(c) for c in split_text("x" * 512)] == [512]
    assert [len(c) for c in split_text("x" * 513)] == [512, 51]
    long_word = split_text("y" * 2000)
    assert [len(c) for c in long_word[:3]] == [512, 512, 512]
    assert sum(len(c) for c in long_word) == 2000 + 50 * (len(long_word) - 1)
    first, second = "p" * 300, "q" * 300
    assert split_text(f"{first}\n\n{second}") == [first, second]


def test_overlap_is_shared():
    text = " ".join(f"w{i:03d}" for i in range(300))
    chunks = split_text(text, 100, 20)
    for left, right in zip(chunks, chunks[1:]):
        shared = max(n for n in range(21) if left.endswith(right[:n]))
        assert 0 < shared <= 20


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "product_id bigint, text string")


def test_character_chunks(spark):
    rows = K.character_chunks(_docs(spark, ["a" * 600, " ", None, "short"])).orderBy("chunk_id").collect()
    assert [(r["product_id"], r["chunk_idx"], len(r["chunk_text"])) for r in rows] == [(0, 0, 512), (0, 1, 138), (3, 0, 5)]
    assert len({r["chunk_id"] for r in rows}) == 3


def _sentence(n, word="w"):
    return " ".join([word] * n) + "."


def test_paragraphs(spark):
    texts = [
        _sentence(120) + " " + _sentence(3),
        _sentence(60) + " " + _sentence(40),
        _sentence(60) + " " + _sentence(41),
        "", None,
    ]
    rows = K.paragraph_chunks(_docs(spark, texts)).orderBy("product_id", "chunk_idx").collect()
    assert [(r["product_id"], len(r["chunk_text"].split())) for r in rows] == [(0, 120), (0, 3), (1, 100), (2, 60), (2, 41)]


def test_paragraphs_against_loop(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(_sentence(rng.randint(1, 70), "ab") for _ in range(rng.randint(0, 30))) for _ in range(40)]

    def packed(text):
        chunks, current, words = [], [], 0
        for sentence in [s + "." for s in text.split(".") if s.strip()]:
            n = len(sentence.split())
            if words + n > 100 and current:
                chunks.append(" ".join(s.strip() for s in current))
                current, words = [], 0
            current.append(sentence)
            words += n
        return chunks + ([" ".join(s.strip() for s in current)] if current else [])

    got = K.paragraph_chunks(_docs(spark, texts)).groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_text"))).alias("c")
    )
    found = {r["product_id"]: [c["chunk_text"] for c in r["c"]] for r in got.collect()}
    assert [found.get(i, []) for i in range(len(texts))] == [packed(text) for text in texts]


def test_chunk_key_order_and_range(spark):
    import pytest

    rows = spark.createDataFrame([(0, 5), (1, 0), (2**39 - 1, 2**24 - 1)], "p bigint, i int")
    keys = [r[0] for r in rows.select(chunk_key(F.col("p"), F.col("i"))).collect()]
    assert keys == sorted(keys) and keys[-1] == 2**63 - 1
    with pytest.raises(Exception, match="out of range"):
        rows.select(chunk_key(F.col("p") + 1, F.col("i"))).collect()
