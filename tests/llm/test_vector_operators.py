from __future__ import annotations

import numpy as np
import pytest

from shelfseek.llm import topk, vectordedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, links bigint, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA)

    return build


def clusters(n=240, dim=20, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(30, dim))
    rows = []
    for i in range(n):
        noise = draw.choice([0.0, 0.1, 0.25])
        rows.append((1000 - i, (centres[draw.integers(30)] + noise * draw.normal(size=dim)).astype(np.float32).tolist()))
    return rows


ODD = [
    (1, None), (2, []), (3, [0.0] * 20), (4, [float("nan")] * 20), (5, [float("inf")] + [1.0] * 19), (6, [None] + [1.0] * 19),
    (7, [1.0]), (8, [2.0]), (9, [-1.0]), (None, [1.0, 2.0]), (10, [2.0, 4.0]), (10, [2.0, 4.0]), (11, [1e-30] * 20), (12, [1e30] * 20),
]


def plain(rows, threshold):
    def cosine(v, w):
        if v is None or w is None or len(v) != len(w) or not v or None in v or None in w:
            return -2
        a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
        if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return -2
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))

    n = len(rows)
    linked = [{j for j in range(n) if j != i and cosine(rows[i][1], rows[j][1]) >= threshold} for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in linked[i])]) for i in range(n)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vec_id, len(linked[i]), least, vec_id == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [16, 50, 4096])
def test_links_are_those_of_all_pairs(vectors, tile):
    rows = clusters() + clusters()[:20] + ODD
    found = vectordedup.near_vectors(vectors(rows), 0.95, tile).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str) == plain(rows, 0.95)


def test_many_strips_and_slots(vectors, monkeypatch):
    monkeypatch.setattr(vectordedup, "STRIPS", 5)
    rows = clusters(seed=3)
    found = vectordedup.near_vectors(vectors(rows), 0.9, 12).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str) == plain(rows, 0.9)


def test_no_vectors(vectors):
    assert vectordedup.near_vectors(vectors([])).count() == 0
    assert topk.top_k(vectors([]), vectors([])).count() == 0


def test_blocks_stop_only_what_cannot_reach():
    draw = np.random.default_rng(4)
    a = draw.normal(size=(300, 40)) / np.sqrt(np.arange(1, 41))
    a[100:200] = a[:100] + 0.05 * draw.normal(size=(100, 40))
    a /= np.linalg.norm(a, axis=1)[:, None]
    rest = vectordedup._remaining(a)
    i, j = vectordedup._block(a.astype(np.float32), a.astype(np.float32), rest, rest, 0.95 - 1e-4)
    wanted = set(zip(*np.nonzero(a @ a.T >= 0.95), strict=True))
    assert wanted <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 2 * len(wanted)


def plain_top(rows, queries, k):
    def whole(v):
        return [int(np.floor(1024 * float(np.float32(x)))) for x in v]

    def usable(v):
        return bool(v) and None not in v and np.isfinite(np.array(v, float)).all()

    def fit(score):
        return max(-(2**62) + 1, min(2**62 - 1, score))

    out = []
    for query_id, q in {i: v for i, v in queries if i is not None and usable(v)}.items():
        scored = [
            (-fit(sum(a * b for a, b in zip(whole(q), whole(v), strict=True))), i)
            for i, v in rows if i is not None and i != query_id and usable(v) and len(v) == len(q)
        ]
        out += [(query_id, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "block"), [(10, 1024), (3, 8), (500, 1024)])
def test_top_k_is_that_of_all_scores(vectors, monkeypatch, k, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    ties = [(2000 + i, [0.5] * 20) for i in range(40)]
    large = [(3000, [1e18] * 20), (3001, [-1e18] * 20), (3002, [1e6] * 20), (3020, [3e37] + [0.0] * 19)]
    rows = clusters() + ties + ODD + large
    queries = [row for row in rows if row[0] is not None and row[0] % 20 == 0 and row[0] != 10] + [(7, [1.0])]
    found = topk.top_k(vectors(rows), vectors(queries), k).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == plain_top(rows, queries, k)


def test_large_numbers_stay_exact():
    a, b = np.floor([[2.0**40 + 1, 3.0]]), np.floor([[2.0**20 + 1, -7.0]])
    assert topk.scores_of(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) - 21
    assert topk.scores_of(a * 2.0**20, b * 2.0**20)[0, 0] == topk.MOST
    assert topk.scores_of(a * 2.0**20, np.vstack([-b * 2.0**20, [[0.0, 1.0]]])).tolist() == [[-topk.MOST, 3 * 2**20]]
