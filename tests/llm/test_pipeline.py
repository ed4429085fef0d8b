"""Every stage of the pipeline against a brute-force version, on all rows its predecessor kept."""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from shelfseek.llm import packing, queries  # noqa: E402
from shelfseek.workspace import new_path  # noqa: E402
from test_text_operators import deal, plain_fingerprint, plain_lines, roots  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    """The rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.collect())
    return found


def test_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]


def test_toxic_documents_go(spark, sf_dir, tables):
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, sf_dir).collect() if r.predicted}
    assert sorted(map(tuple, tables[1])) == sorted(tuple(r) for r in tables[0] if r.doc_id not in toxic)


def test_repeated_lines_go(tables):
    expected = {doc_id: text for doc_id, _, _, text in plain_lines([(r.doc_id, r.text) for r in tables[1]])}
    assert {r.doc_id: r.text for r in tables[2]} == expected
    assert all(r.n_chars == len(r.text) for r in tables[2])


def test_one_of_each_group_stays(tables):
    rows = sorted(tables[2], key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text, 4) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(rows), links)
    assert sorted(map(tuple, tables[3])) == [tuple(r) for i, r in enumerate(rows) if root[i] == i]


def test_mixture(tables):
    def key(r):
        return (f"domain{int(r.source[3:]) % 4}", r.lang, r.source)

    def tokens(r):
        return -(-len(r.text.encode()) // 4)

    supply = defaultdict(int)
    for r in tables[3]:
        supply[key(r)] += tokens(r)
    budgets = {(): math.floor(sum(supply.values()) * corpus_pipeline.MIXED_SHARE)}
    weights = [lambda k: queries.DOMAIN_WEIGHTS[k], lambda k: queries.LANGUAGE_WEIGHTS[k], lambda k: 1]
    for depth, weight in enumerate(weights):
        below = {}
        for parent, budget in budgets.items():
            children = defaultdict(int)
            for leaf, n in supply.items():
                if leaf[:depth] == parent:
                    children[leaf[: depth + 1]] += n
            below |= deal(budget, {c: (weight(c[-1]), n) for c, n in children.items()})
        budgets = below
    expected = set()
    for leaf, budget in budgets.items():
        own = [r for r in tables[3] if key(r) == leaf]
        whole = round(budget) == supply[leaf]
        order = sorted(own, key=lambda r: (int(hashlib.md5(f"11:0:{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id))
        spent = 0
        for r in own if whole else order:
            if whole or spent < round(budget):
                expected.add(tuple(r))
            spent += tokens(r)
    assert sorted(map(tuple, tables[4])) == sorted(expected)


def test_packed_pieces(tables):
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        tokenizer = packing.TokenIds(file.read()).tokenizer
    expected = []
    for r in tables[4]:
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        expected += [(r.doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in tables[5]) == sorted(expected)
    sequences = defaultdict(list)
    for r in tables[5]:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-sum(r.length for r in tables[5]) // 2048) + 1
