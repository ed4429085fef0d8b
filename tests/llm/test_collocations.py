"""Phrases against a brute-force version, with prefixes of every length and texts of odd kinds."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from shelfseek.llm import collocations
from shelfseek.llm.collocations import _Block


def plain(rows, at_least, first, scale=2_000_000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= at_least}
        covered = Counter()
        for p, f in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], f)
        scored = []
        for p, a in candidates.items():
            if p in covered and 100 * covered[p] >= 80 * a:
                continue
            cuts = [(scale * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def shown(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, frame.collect()))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "A", "new", "york", "city", "été", "x\x00", "\x1f", "Ünder", *[f"w{i}" for i in range(8)]]
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, k=1)[0] + rng.choices([" ", "\t", "  ", ". ", "\n", ",", "\x0b"], [30, 2, 2, 1, 1, 1, 1])[0]
                       for _ in range(rng.randint(0, 40)))
        rows.append((text + rng.choice(["", "the City of new york", "the the the the the"]), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize(("budget", "at_least", "first"), [(1 << 22, 5, 2000), (60, 3, 25), (20, 2, 2000)])
def test_any_partition_gives_the_same(documents, budget, at_least, first):
    rows = texts(budget, 150)
    docs = documents([(i, text, lang, "s") for i, (text, lang) in enumerate(rows)])
    found = collocations.collocations(docs, at_least=at_least, first=first, budget=budget)
    assert shown(found) == plain(rows, at_least, first)


def test_blocks_and_parts_do_not_show(documents, monkeypatch):
    # workers take the sizes with the functions they run, so this sees the text cutting only
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    text = "one two three. " * 20 + "no break here " * 10
    parts = list(collocations._parts(text.encode()))
    assert b"".join(parts) == text.encode() and len(parts) > 3
    assert all(part.endswith(b".") for part in parts[:-1])


def test_odd_rows(documents, odd_rows):
    rows = [*odd_rows, *[(20, "Tie one. tie one, tie two; tie two")] * 3, (21, "İ i̇ é x é x", None, None)]
    full = [(r[1], r[2] if len(r) > 2 else "en") for r in rows]
    found = collocations.collocations(documents(rows), at_least=2)
    assert shown(found) == plain(full, 2, 2000)
    assert shown(collocations.collocations(documents(rows).where("false"), at_least=2)) == []
    assert shown(collocations.collocations(documents([(1, None), (2, "")]), at_least=1)) == []


def test_prefixes_are_extended_where_they_pass_the_budget(documents):
    rows = [(i, "a b c d " * 5 + f"z{i % 3} b c") for i in range(40)]
    docs = documents(rows).selectExpr("lang", "text")
    words = collocations.word_counts(docs)
    bits = collocations.bitmap(words, collocations.WORD_BITS)
    hot = collocations.bitmap(words.where("n > 150"), collocations.WORD_BITS)
    pairs = collocations.pair_counts(docs, bits, hot)
    partition = collocations.Partition(words, bits, hot, pairs, budget=150)
    block = _Block("en", [b"a b c d z0"])
    columns, n, _, group, split = collocations._suffixes(block, partition)
    by_words = {tuple(block.words[c[i]] for c in columns[:2]): bool(split[i]) for i in range(len(n))}
    # "b" and "c" follow more often than 150 times, "z0" does not
    assert by_words[b"a", b"b"] and not by_words[b"d", b"z0"]
    assert partition.groups > 1 and (group < partition.groups).all()


def test_scores_beyond_64_bits(spark):
    """The arithmetic of the score, on counts no table here reaches."""
    big = 9_000_000_000_000_000
    value = f"(cast(2000000 as decimal(20,0)) * cast({big}L as decimal(18,0))) div (cast({big + 1}L as decimal(20,0)) + cast({big + 2}L as decimal(20,0)))"
    assert spark.sql(f"SELECT {value} AS x").first().x == 2_000_000 * big // (2 * big + 3)


def test_counts_of_suffix_trees_are_whole(spark):
    """Nodes are right wherever batches and groups end."""
    rng = random.Random(2)
    rows = [("en", *rng.choices("ab", k=2), *rng.choice([(None, None), ("a", None), ("b", "a"), ("b", "b")])) for _ in range(500)]
    # pairs that begin with "a" are split by their third word
    rows = [(*r, rng.randint(1, 9), ord(r[2]), 5 if r[1] == "b" else len(r[3] or ""), r[1] == "a") for r in rows]
    names = "lang string, w1 string, w2 string, w3 string, w4 string, n bigint, pair bigint, grp int, split boolean"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        nodes = collocations.subtree_counts(spark.createDataFrame(rows, names), 2, 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = Counter()
    for row in rows:
        for depth in (2, 3, 4):
            if row[depth] is not None:
                expected[(*row[: depth + 1], *[None] * (4 - depth))] += row[5]
    assert {tuple(r)[:5]: r.n for r in nodes} == {k: n for k, n in expected.items() if n >= 40} and len(nodes) == len({tuple(r)[:5] for r in nodes})
