"""Periodic runs against a brute-force version that tries every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfseek.llm import periodicity, queries


def plain_runs(words, exponent=4, least=6):
    """Every maximal stretch with period q, kept where no smaller period gives the same stretch."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        while start + q < len(words):
            end = start + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, exponent * q):
                found.setdefault((start, end - start), q)
            start = max(start + 1, end - q + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(word for i, word in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)))


def found_runs(words):
    return periodicity._block_runs([[str(w).encode() for w in words]], 4, 6)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_small_alphabets(words):
    assert found_runs(words) == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_planted_periods_of_every_scale(data):
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    words = []
    for _ in range(rng.randint(1, 4)):
        period = rng.randint(1, 90)
        unit = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(period)]
        words += [rng.randint(0, 60) for _ in range(rng.randint(0, 30))]
        words += [unit[i % period] for i in range(int(period * rng.uniform(2.5, 7)))]
    assert found_runs(words) == plain_runs(words)


def test_texts_of_a_block_do_not_touch():
    rng = random.Random(5)
    texts = [[rng.randint(0, 1) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    texts += [[i % 97 for i in range(97 * 4)], [i % 97 for i in range(97 * 4 - 1)], [7] * 5, [7] * 6]
    rng.shuffle(texts)
    found = periodicity._block_runs([[str(w).encode() for w in words] for words in texts], 4, 6)
    assert found == [plain_runs(words) for words in texts]


def test_fewer_periods_than_the_scales_rely_on_are_refused():
    with pytest.raises(ValueError):
        periodicity.runs_of(np.array([1, -1]), np.array([2]), exponent=3)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert any(len((r.text or "").encode().split()) > 1000 for r in docs)
    expected = [plain_row(r.doc_id, planted(r.doc_id, [w.decode() for w in (r.text or "").encode().split()])) for r in docs]
    found = queries.op12_periodic_runs(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert sum(row[1] for row in expected) > 10


def test_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (11, "a b " * 9), (11, "a b " * 9), (12, "é é " * 6), (None, None)]
    found = periodicity.periodic_runs(documents(rows)).collect()
    expected = []
    for row in rows:
        words = [w.decode() for w in (row[1] or "").encode().split()]
        runs = plain_runs(words) if len(words) < 100 else []
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        expected.append((row[0], len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    shown = [(r.doc_id, r.n_words, [tuple(run) for run in r.runs], r.collapsed) for r in found]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)
    assert periodicity.periodic_runs(documents(rows).where("false")).collect() == []


def test_no_shuffle(spark, sf_dir):
    plan = queries.op12_periodic_runs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
