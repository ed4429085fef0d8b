"""The learned embedder: equal to a dense decomposition, and better than hashing at finding near copies."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfseek.operators.embedding import hashing
from shelfseek.operators.latent import latent_vector, learn
from shelfseek.plans.index import chunk_vectors


def _dense(texts: list[str | None], places: int) -> np.ndarray:
    """The weights row by row, in plain Python."""
    counted = []
    for text in texts:
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        counted.append(Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % places for w in words))
    held = Counter(place for counts in counted for place in counts)
    rows = np.zeros((len(texts), places))
    for row, counts in zip(rows, counted, strict=True):
        for place, n in counts.items():
            row[place] = np.log1p(n) * (np.log((1 + len(texts)) / (1 + held[place])) + 1)
        if row.any():
            row /= np.sqrt(row @ row)
    return rows


@pytest.fixture(scope="module")
def short_texts(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)]
    made = [" ".join(rng.choice(words[topic * 20 : topic * 20 + 25], 30)) for topic in (0, 1, 2, 0, 1, 2, 0, 0) for _ in range(12)]
    return [*made, None, "", "--- !", made[0], "Wörter über 42 w1"]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "product_id bigint, text string").repartition(3)


def _vectors(df, embedder) -> dict[int, np.ndarray]:
    return {r[0]: np.array(r[1]) for r in df.select("product_id", embedder.vector(F.col("text"))).collect()}


def test_axes_equal_a_dense_decomposition(spark, short_texts):
    places, dim = 512, 6
    model = learn(_frame(spark, short_texts), "text", dim, places=places, passes=6)
    dense = _dense(short_texts, places)
    _, singular, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.singular, singular[:dim], rtol=1e-4)
    # the leading, well separated axes up to their sign
    assert np.all(np.abs(np.sum(model.axes[:, :3] * right[:3].T, axis=0)) > 0.999)
    assert np.allclose(model.axes.T @ model.axes, np.eye(dim), atol=1e-4)

    expected = dense @ model.axes
    found = _vectors(_frame(spark, short_texts), model.embedder("latent-test"))
    for row, vector in enumerate(expected):
        size = np.sqrt(vector @ vector)
        wanted = vector / size if size > 0 else vector
        assert np.allclose(found[row], wanted, atol=1e-5), row
        assert (size == 0) == (not re.search(r"\w", short_texts[row] or ""))


@pytest.mark.parametrize("dim", [1, 40])
def test_empty_and_few_texts_give_any_dimension(spark, dim):
    for texts in ([], [None, ""], ["one text", "one text"]):
        model = learn(_frame(spark, texts), "text", dim, places=64, passes=1)
        assert model.axes.shape == (64, dim) and np.isfinite(model.axes).all()
        assert len(_vectors(_frame(spark, texts), model.embedder("x"))) == len(texts)
    with pytest.raises(ValueError, match="dim"):
        learn(_frame(spark, ["a"]), "text", 0)


def test_a_text_of_many_words_is_whole(spark):
    long = " ".join(f"word{i}" for i in range(90_000))
    rng = np.random.default_rng(1)
    rarity, axes = np.ones(4096), rng.standard_normal((4096, 3))
    dense = np.zeros(4096)
    for place, n in Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 4096 for w in long.split()).items():
        dense[place] = np.log1p(n)
    wanted = dense @ axes / np.linalg.norm(dense @ axes)
    found = spark.createDataFrame([(long,)], "t string").select(latent_vector(F.col("t"), rarity, axes)).first()[0]
    assert np.allclose(found, wanted, atol=1e-5)


def test_held_out_near_copies_are_found_and_better_than_by_hashing(spark, sf_dir):
    """Every document is learned from; a copy with every third word gone and words of others added is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("product_id"), "text")
    rows = [r for r in docs.orderBy("product_id").collect() if len((r["text"] or "").split()) >= 20]
    rng = np.random.default_rng(5)
    pool = " ".join(r["text"] for r in rows).split()
    copies = []
    for r in rows:
        words = r["text"].split()[:400]
        kept = [w for w in words if rng.random() > 0.35]
        added = rng.choice(pool, len(words) // 3 + 1).tolist()
        copies.append((r["product_id"], " ".join([*kept, *added])))
    held_out = spark.createDataFrame(copies, "product_id bigint, text string")
    own = spark.createDataFrame([(r["product_id"], " ".join(r["text"].split()[:400])) for r in rows], "product_id bigint, text string")

    def recall(embedder) -> float:
        vectors, asked = _vectors(own, embedder), _vectors(held_out, embedder)
        ids = sorted(vectors)
        scores = np.array([asked[i] for i in ids]) @ np.array([vectors[i] for i in ids]).T
        own_score = scores[np.arange(len(ids)), np.arange(len(ids))]
        # an equal text elsewhere is as good
        return float((own_score >= scores.max(1) - 1e-6).mean())

    learned, hashed = recall(learn(docs, "text", 48, places=1 << 14).embedder("latent")), recall(hashing(48))
    print(f"recall of the copied document, 48 places: learned {learned:.3f}, hashed {hashed:.3f}")
    assert learned >= 0.9 and learned > hashed


def test_the_index_takes_it(spark, short_texts):
    df = _frame(spark, short_texts)
    model = learn(df, "text", 8, places=256, passes=2)
    vectors = chunk_vectors(df.where("text is not null"), embedder=model.embedder("latent-8"))
    assert all(len(r["embedding"]) == 8 for r in vectors.collect())
