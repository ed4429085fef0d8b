from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfseek.llm import licences, linededup, mixing, packing, quality, queries, simhash, toxicity, warc
from shelfseek.llm.components import components
from shelfseek.workspace import shared_root


# --- components -----------------------------------------------------------------------------------------


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_random_links_chains_and_stars(spark):
    draw = random.Random(1)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(45)]
    links += [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(5, 5), (5, 5)]
    rows = spark.createDataFrame([*links, (None, 3), (3, None)], "a bigint, b bigint")
    expected = roots(300, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in components(rows).collect()} == {x: expected[x] for x in linked}
    assert components(rows.limit(0)).count() == 0


# --- SimHash --------------------------------------------------------------------------------------------


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "one", "a b c", "a b c d", "A B c\x0bD é É e f g", "x " * 500])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def near_texts():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([30, 300]))]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(4)):
            other = list(base)
            other[draw.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    return texts + ["", "", "same text twice here", "same text twice here"]


def test_groups_are_those_of_all_pairs(documents):
    texts = near_texts()
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    prints = [plain_fingerprint(t, 4) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = {rows[i][0]: rows[root][0] for i, root in enumerate(roots(len(texts), links))}
    found = simhash.simhash_groups(documents(rows), 4, 4).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.fp % 2**64 for r in found} == {rows[i][0]: p for i, p in enumerate(prints)}
    assert len(set(expected.values())) < len(texts) - 10


def test_probes_alone_find_every_pair(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    flipped = [int(b) ^ sum(1 << int(p) for p in draw.choice(64, draw.integers(0, 6), replace=False)) for b in base]
    fps = sorted({*map(int, base), *flipped})
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, class bigint")
    groups = simhash.correlated_parts(nodes, 4)
    assert sorted(bit for group in groups for bit in group) == list(range(64))
    index = simhash._index(nodes, groups)
    costs = [simhash.probe_costs(h, 4) for h in simhash._histograms(index, groups)]
    x, y = simhash._probes(nodes, groups, costs, 4).alias("x"), index.alias("y")
    met = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")))
    pairs = {frozenset(r) for r in met.select("x.class", "y.class").distinct().collect()}
    wanted = {frozenset((i, j)) for i in range(len(fps)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert wanted <= pairs


def test_thresholds_are_the_cheapest_that_suffice():
    draw = np.random.default_rng(2)
    costs = [np.cumsum(np.concatenate([np.zeros((1, 20)), draw.random((5, 20))]), axis=0) for _ in range(4)]
    found = simhash.allocate(costs, 4)
    assert ((found + 1).sum(1) == 5).all() and (found >= -1).all()
    for row in range(20):
        best = min(
            sum(costs[i][t, row] for i, t in enumerate((a, b, c, 5 - a - b - c)))
            for a in range(6) for b in range(6 - a) for c in range(6 - a - b)
        )
        assert sum(costs[i][t + 1, row] for i, t in enumerate(found[row])) == pytest.approx(best)


def test_simhash_of_odd_rows(spark, documents, odd_rows):
    rows = simhash.simhash_groups(documents(odd_rows), 4, 4).collect()
    by_id = defaultdict(set)
    for row in rows:
        by_id[row.doc_id].add((row.fp, row.component_id))
    assert len(rows) == len(odd_rows)
    assert by_id[1] == by_id[2] == by_id[3] == {(0, 1)}
    assert len(by_id[4]) == 1 and by_id[None] == by_id[5]
    assert simhash.simhash_groups(documents([]), 4, 4).count() == 0
    kept = simhash.near_duplicates_dropped(documents(odd_rows), 4, 4, ["doc_id", "text", "lang", "source", "n_chars"])
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 4, 5, 6, 7, 8, None]


# --- line dedup -----------------------------------------------------------------------------------------


def plain_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    last = float("inf")
    holder = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holder[key(line)] = min(holder.get(key(line), last), last if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        own = last if doc_id is None else doc_id
        kept = [line for line in lines if len(key(line)) < 10 or holder[key(line)] == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    draw = random.Random(4)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "", "É" * 9, "É" * 10, "  padded line here\t"]
    return [(i, "\n".join(draw.choice(pool) + draw.choice(["", " ", "\r"]) for _ in range(draw.randrange(6)))) for i in range(60)]


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (7, 2), (5, 3)])
def test_lines_kept_are_the_plain_ones(documents, batches, fan_in):
    rows = line_rows()
    found = linededup.dedup_lines(documents(rows), batches=batches, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found), key=str) == plain_lines(rows)


def test_lines_of_odd_rows(documents, odd_rows):
    found = linededup.dedup_lines(documents(odd_rows), columns=["lang", "n_lines"], batches=3).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found), key=str) == plain_lines(odd_rows)
    assert {r.rest.n_lines for r in found} == {"x"}
    assert linededup.dedup_lines(documents([])).count() == 0


def test_runs_are_compacted_and_removed(spark, documents):
    runs = linededup.Runs(spark, fan_in=2)
    for i in range(4):
        first = spark.createDataFrame([(bytes([i, j]), i) for j in range(3)], "h binary, holder bigint")
        assert runs.unseen(first).count() == 3
        runs.add(first)
        runs.compact()
        assert runs.unseen(first).count() == 0
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    folder = shared_root(spark).split(":")[-1].strip("/") + "/shelfseek/line-runs-"
    assert all(folder in f for f in spark.table(runs.levels[2][0]).inputFiles())
    assert len(spark.catalog.listTables(runs.database)) == 1
    runs.close()
    assert not spark.catalog.databaseExists(runs.database)


def test_runs_are_not_shuffled(spark):
    runs = linededup.Runs(spark)
    runs.add(spark.createDataFrame([(b"a", 1)], "h binary, holder bigint").groupBy("h").agg(F.min("holder").alias("holder")))
    first = spark.range(10).selectExpr("cast(cast(id as string) as binary) h", "id").groupBy("h").agg(F.min("id").alias("holder"))
    plan = runs.unseen(first)._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


# --- toxicity -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def decoder():
    counts = np.zeros(64**3, np.int64)
    text = "the stupid idiot is a loser and a clown; the thing was disgusting, moronic trash of a day  " * 30
    toxicity._count(text, counts)
    return toxicity.Decoder(toxicity.CharacterModel.of_counts(counts))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("l0ser", "loser"), ("st*pid", "stupid"), ("loooser", "loser"), ("cl0wn!!", "clown"), ("tr@sh", "trash"),
     ("l.o.s.e.r", "loser"), ("di$gusting", "disgusting"), ("the", "the"), ("4711", "4711"), ("***", ""), ("1d10t", "idiot")],
)
def test_tokens_are_restored(decoder, written, meant):
    assert decoder.restored(written) == meant


def test_spaced_words_are_restored(decoder):
    assert decoder.restore_text("You s t u p i d\nl o s e r , really") == "you stupid loser really"


@pytest.mark.parametrize(
    ("written", "meant"),
    [("you are a s t u p i d fool", "you are a stupid fool"), ("i d i o t s c u m", "idiot scum"), ("(s t u p i d)", "stupid"),
     ("$ t u p 1 d", "stupid"), ("s  t  u  p  i  d", "stupid"), ("s\tt\tu\tp\ti\td", "stupid"),
     ("s.t.u.p.i.d l-o-s-e-r", "stupid loser"), ("s_t*p_i_d", "stupid"), ("m o r o n   i d i o t", "moron idiot"), ("1 2 3 4", "1 2 3 4")],
)
def test_breaks_of_spaced_runs_are_decoded(written, meant):
    counts = np.zeros(64**3, np.int64)
    toxicity._count("you are a stupid fool and an idiot of scum; the moron is a loser  " * 30, counts)
    decoder = toxicity.Decoder(toxicity.CharacterModel.of_counts(counts))
    assert decoder.restore_text(written) == meant
    words = {word for run in decoder.spaced(f" {written}") for word in run.split()}
    assert words <= set(meant.split()) and (words & {"stupid", "idiot", "1"})


@pytest.mark.parametrize(
    ("written", "meant"),
    [("!diot", "idiot"), ("(lown", "clown"), ('"(lown,"', "clown"), ("a$$", "ass"), ("a$$.", "ass"), ("455", "ass"), ("@$$", "ass"), ("|d!ot", "idiot"),
     ("the***", "the"), ("the###", "the"), ("the$$$", "the"), ("thing!!", "thing"), ("the.***", "the"), ("(the", "the"), ("fool!", "fool"),
     ("4711", "4711"), ("2.0.", "2.0"), ("***", ""), ("1999", "1999"), ("", "")],
)
def test_signs_at_the_ends_are_decoded(written, meant):
    counts = np.zeros(64**3, np.int64)
    toxicity._count("an idiot and a clown, the thing is an ass of the fool ass ass  " * 30, counts)
    assert toxicity.Decoder(toxicity.CharacterModel.of_counts(counts)).restored(written) == meant


def test_a_very_long_spaced_run(decoder):
    start = time.time()
    assert decoder.restore_text("l o s e r " * 40_000).startswith("loser loser")
    assert time.time() - start < 30


def test_the_path_is_the_best_of_all(decoder):
    def log_probability(path):
        a, b, total = 0, 0, 0.0
        for letters, cost in path:
            total += cost
            for sign in letters:
                c = decoder._symbol(sign)
                total += float(decoder.log_p[a, b, c]) if c or b else 0.0
                a, b = b, c
        return total + (float(decoder.log_p[a, b, 0]) if b else 0.0)

    for token in ("1d10t", "st*p1d", "$cuum", "l00ser"):
        paths = [()]
        for options in toxicity.lattice(token):
            paths = [(*path, option) for path in paths for option in options]
        best = max(map(log_probability, paths))
        assert decoder.decode(token) in {"".join(x for x, _ in p) for p in paths if log_probability(p) > best - 1e-4}


def test_toxicity_of_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id bigint, label int")
    rows = odd_rows + [(20 + i, "you stupid loser" if i % 2 else "a kind word") for i in range(20)]
    docs = documents(rows)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, columns=["lang", "rest"], restore=True).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert {r.restored for r in scored if r.doc_id == 2} == {""}
    assert toxicity.score(documents([]), model).count() == 0
    nothing = toxicity.fit(documents([]), labels.limit(0))
    assert max(r.score for r in toxicity.score(docs, nothing).collect()) < 1e-9


def accuracy(rows, labels, at):
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in pairs) / len(pairs), len(pairs), at


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    toxic = queries.op2_toxicity(spark, sf_dir).collect()
    good = queries.op8_quality(spark, sf_dir).collect()
    assert accuracy(toxic, {r.doc_id: r.toxic for r in labels}, 0.3)[0] > 0.85
    assert accuracy(good, {r.doc_id: r.quality for r in labels}, 0.3)[0] > 0.95
    for rows, mod, rest in ((toxic, 4, 2), (good, 5, 0)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
        assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)


# --- quality --------------------------------------------------------------------------------------------


def test_discriminant_is_that_of_normal_densities():
    draw = np.random.default_rng(0)
    x = [draw.normal(i, 1 + i, (500, quality.STATISTICS)) for i in (0, 1)]
    moments = [np.array([len(v) for v in x], float), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x])]
    model = quality.Discriminant.of_moments(*moments)
    points = draw.normal(0.5, 1, (5, quality.STATISTICS))
    plain = []
    for mean, factor in zip(model.means, model.factors, strict=True):
        cov = factor @ factor.T
        gap = points - mean
        plain.append(-0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.difference(points), plain[1] - plain[0])


def test_quality_of_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id bigint, label int")
    scored = quality.quality_scores(documents(odd_rows), labels).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.quality_scores(documents(odd_rows), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(documents([]), labels).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------


def deal(budget, children):
    """Children: {key: (weight, cap)}; shares by raising a common level until the budget is used."""
    low, high = 0.0, 1e15
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(cap, level * w) for w, cap in children.values()) < budget:
            low = level
        else:
            high = level
    return {key: min(cap, high * w) for key, (w, cap) in children.items()}


def test_budgets_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 10_000), ("a", "fr", "s3", 50), ("b", "en", "s4", 5_000), ("c", "de", "s5", 10)]
    frame = spark.createDataFrame([(*leaf, 1) for leaf in leaves], "domain string, lang string, source string, supply bigint, n bigint")
    weights = {"domain": F.when(F.col("domain") == "a", 2).otherwise(1), "lang": F.lit(1), "source": F.lit(1)}
    found = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(frame, weights, None, 9_000, 1).collect()}
    top = deal(9_000, {"a": (2, 10_150), "b": (1, 5_000), "c": (1, 10)})
    langs = deal(top["a"], {"en": (1, 10_100), "fr": (1, 50)})
    sources = deal(langs["en"], {"s1": (1, 100), "s2": (1, 10_000)})
    expected = {("a", "en", "s1"): sources["s1"], ("a", "en", "s2"): sources["s2"], ("a", "fr", "s3"): 50, ("b", "en", "s4"): top["b"], ("c", "de", "s5"): 10}
    assert found == {key: round(value) for key, value in expected.items()}
    assert sum(found.values()) == 9_000


def test_mixture_of_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    weights = {"domain": F.lit(1), "lang": F.lit(None), "source": F.lit(1)}
    assert mixing.mix(docs, weights, F.lit("d"), share_of_supply=1.0).count() == 0
    weights["lang"] = F.lit(1)
    twice = mixing.mix(docs, weights, F.lit("d"), share_of_supply=5.0, max_epochs=2, columns=["text", "rest"]).collect()
    assert len(twice) == 2 * len(odd_rows) and {r.epoch for r in twice} == {0, 1}
    assert {r.rest.rest for r in twice} == {"x"}
    part = mixing.mix(docs, weights, F.lit("d"), tokens=100).collect()
    assert 0 < len(part) <= len(odd_rows)
    assert mixing.mix(documents([]), weights, F.lit("d"), share_of_supply=1.0).count() == 0


# --- packing --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        return packing.TokenIds(file.read())


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "Hello  world \n\n next\tline 123abc's don't", " leading and trailing ", "é ñ 漢字 🙂 x", "a b  c \x1c d \x85 e",
     "end<|endoftext|> of text", "x" * 5000, " ".join("ab cd ef".split() * 900), "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")],
)
def test_ids_are_the_tokenizers(tokens, text):
    assert tokens.ranked is not None
    plain = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.of(text), "<u4").tolist() == plain


def test_best_fit_against_a_plain_search():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 101, 400)
    rooms, expected = [], {}
    for item in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fitting = [room for room in rooms if room >= lengths[item]]
        room = min(fitting, default=100)
        if fitting:
            rooms.remove(room)
        rooms.append(room - lengths[item])
        expected[item] = room
    bins = packing.best_fit(lengths, 100)
    fills = np.bincount(bins, weights=lengths)
    assert fills.max() <= 100 and sorted(100 - fills) == sorted(rooms)


def test_packing_keeps_every_token_once(spark, documents, odd_rows, tokens):
    draw = random.Random(6)
    rows = odd_rows + [(100 + i, " ".join(draw.choice(["alpha", "beta", "gamma"]) for _ in range(draw.randrange(1, 900)))) for i in range(120)]
    docs = documents(rows).repartition(9)
    found = packing.pack_documents(docs, queries.tokenizer_path(), capacity=512).collect()
    sequences = defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in found)
    assert len(sequences) <= 1.03 * -(-total // 512) + 1
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append(tokens.of(text or "") + bytes(4))
    expected = sorted(
        (str(d), p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))
        for d, many in texts.items() for ids in many for p, (s, n) in enumerate(packing.cut(len(ids) // 4, 512))
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    assert packing.pack_documents(documents([]), queries.tokenizer_path()).count() == 0


# --- licences -------------------------------------------------------------------------------------------

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, to deal in it without restriction:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT
shall the authors be liable for any claim."""


@pytest.mark.parametrize(
    ("text", "names"),
    [(MIT, "MIT"), ("Some words.\nReleased under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
     ("GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", "GPL-3;CC-BY-NC-4.0"), (None, ""), ("", ""),
     ("a license of my own", ""), ("SPDX-License-Identifier: Apache-2.0", "APACHE-2.0")],
)
def test_licences(documents, text, names):
    assert licences.recognise(documents([(1, text)])).first().licences == names


def test_licences_of_odd_rows(documents, odd_rows):
    assert licences.recognise(documents(odd_rows)).count() == len(odd_rows)
    assert licences.recognise(documents([])).count() == 0
    unmatched = licences.recognise(documents([(1, "Copyright 2020 X. See the GNU General Public License.")])).first()
    assert (unmatched.licences, unmatched.n_sentences, unmatched.n_unmatched) == ("GPL", 2, 1)


#: One text per known sentence, which holds nothing else.
ALONE = {
    "spdx": "SPDX-License-Identifier: MIT", "mit-grant": "Permission is hereby granted, free of charge, to any\nperson obtaining a copy",
    "mit-notice": "The above copyright notice and this permission  notice shall be included in all copies",
    "isc-grant": "Permission to use, copy, modify, and distribute this software\nfor any purpose", "as-is": "The software is provided 'as is'",
    "no-liability": "In no event shall\nwe be liable for any claim", "bsd-redistribution": "Redistribution and use in\nsource and binary forms",
    "bsd-source": "Redistributions of source code must\nretain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must\nreproduce the above copyright notice",
    "bsd-endorse": "No name may be used to endorse or\npromote products derived from it",
    "agpl-free": "you can redistribute it and/or modify it under the terms of the GNU Affero\nGeneral Public License",
    "lgpl-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser\nGeneral Public License",
    "gpl-free": "free software: you can redistribute it and/or modify it under the terms of the GNU  General Public License",
    "or-later": "either version 3 of the License, or (at your option) any\nlater version", "this-version": "version 2 of the License.",
    "gpl-no-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-copy": "You should have received a copy of the GNU  General Public License", "agpl-ref": "GNU  Affero General Public License v3",
    "lgpl-ref": "GNU  Lesser General Public License 2.1", "gpl-ref": "GNU  General Public License, version 2",
    "agpl-unversioned": "GNU Affero  General Public License", "lgpl-unversioned": "GNU Library  General Public License",
    "gpl-unversioned": "GNU  General Public License", "agpl-short": "AGPLv3", "lgpl-short": "under LGPL v2.1", "gpl-short": "the GPLv2",
    "apache-compliance": "you may not use this file except in\ncompliance with the License",
    "apache-copy": "You may obtain a copy of\nthe License at", "apache-basis": 'distributed under the License is distributed on an "AS IS" BASIS',
    "apache-ref": "Apache  License 2.0", "mpl-ref": "Mozilla  Public License, v. 2.0", "mpl-copy": "If a copy of the MPL was not\ndistributed with this file",
    "epl-ref": "Eclipse Public License - v 2.0", "bsl-ref": "Boost Software License - Version 1.0",
    "cddl-ref": "Common Development and Distribution License (CDDL), Version 1.0", "artistic-ref": "The Artistic License 2.0",
    "afl-ref": "Academic Free License v. 3.0", "eupl-ref": "European Union Public Licence v. 1.2", "cc0-ref": "CC0 1.0 Universal",
    "wtfpl-ref": "Do What The Fuck You Want To Public License",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications",
    "zlib-origin": "The origin of this software must not be misrepresented", "zlib-altered": "altered source versions must be plainly marked as such",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy", "zlib-ref": "zlib license",
    "cc-name": "Creative Commons Attribution 4.0 International",
    "cc-ref": "Text is available under CC BY-SA 4.0.", "mit-ref": "the MIT\nlicense", "bsd-ref": "3-clause  BSD license",
    "isc-ref": "the ISC\nlicense", "unlicense": "released into the public\ndomain", "copyright": "Copyright  2020 X",
}


def test_every_known_sentence_is_found_alone_in_a_text(documents):
    assert list(ALONE) == [name for name, _, _ in licences.SENTENCES]
    found = licences.recognise(documents(list(enumerate(ALONE.values())))).orderBy("doc_id").collect()
    assert [r.sentence_ids.split("@")[0] for r in found] == list(ALONE)
    places = [list(ALONE).index(name) for name in ("mpl-ref", "cc-name", "cc-ref", "unlicense")]
    assert [r.licences for r in found if r.doc_id in places] == ["MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"]


GNU = """This {what} is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {name} License as published by
the Free Software Foundation{break_} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} License for more details.

You should have received a copy of the GNU {name} License
along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""


@pytest.mark.parametrize("sign", ["# "])
@pytest.mark.parametrize(
    ("text", "names"),
    [(GNU.format(what="program", sign=":", name="General Public", break_=",", version="3"), "GPL-3-or-later"),
     (GNU.format(what="program", sign=";", name="General Public", break_=";", version="2"), "GPL-2-or-later"),
     (GNU.format(what="library", sign=";", name="Lesser General Public", break_=";", version="2.1"), "LGPL-2.1-or-later"),
     (GNU.format(what="program", sign=":", name="Affero General Public", break_=",", version="3"), "AGPL-3-or-later"),
     ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public\n"
      "License as published by the Free Software Foundation, version 2 of the License.", "LGPL-2-only"),
     ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed "
      "with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
     ("Licensed under GPLv3.", "GPL-3"), ("CC0 1.0 Universal", "CC0-1.0"), ("Eclipse Public License - v 2.0", "EPL-2.0"),
     ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"), ("Dual: AGPLv3 or LGPL v2.1", "AGPL-3;LGPL-2.1")],
)
def test_notices_as_projects_write_them(documents, text, names, sign):
    text = "".join(f"{sign}{line}\n" for line in text.splitlines())
    assert licences.recognise(documents([(1, text)])).first().licences == names


@pytest.mark.parametrize(
    ("text", "names"),
    [("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0;MIT"),
     ("MIT license or Apache License 2.0", "Apache-2.0;MIT"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT;APACHE-2.0"),
     ("int a\n// SPDX-License-Identifier: MIT\nint b", "MIT"), ("x = 1 # SPDX-License-Identifier: (MIT AND (ISC OR 0BSD))", "MIT;ISC;0BSD"),
     ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR MIT. */", "GPL-2.0-ONLY-WITH-LINUX-SYSCALL-NOTE;MIT"),
     ("GNU General Public License, version 2 or version 3", "GPL-2;GPL-3"), ("Apache License 2.0 and 3 others", "Apache-2.0"),
     ("".join(f"// {line}\n" for line in MIT.splitlines()), "MIT"), ("".join(f" * {line}\n" for line in MIT.splitlines()), "MIT"),
     ("// Redistribution and use in source and binary forms\n// is allowed. Redistributions of source code must retain the above\n"
      "// copyright notice. Redistributions in binary form must reproduce the above copyright notice. The software is provided as is.",
      "BSD-2-Clause"),
     ("In no event shall the holders of the MIT license be liable for any claim.", "MIT")],
)
def test_all_licences_of_a_sentence(documents, text, names):
    assert licences.recognise(documents([(1, text)])).first().licences == names


def test_licences_run_without_python(documents):
    plan = licences.recognise(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- WARC -----------------------------------------------------------------------------------------------

PAGE = """<html lang="de"><head><title>A &amp; B</title><script>var x = "<p>no</p>";</script></head><body><!-- no -->
<p>First&nbsp;line <b>bold</b><br>second</p><ul><li>one<li>two</ul><a href="/x?a=1&amp;b=2">go</a><a href='/x?a=1&amp;b=2'>again</a>"""


def test_page_text_and_links():
    assert warc.plain_text(PAGE) == "First line bold\nsecond\none\ntwo\ngoagain"
    assert warc.outlinks(PAGE, "http://h.example/d/") == ["http://h.example/x?a=1&b=2"]
    assert warc.plain_text("<" * 50_000 + "&#xD800;<script>open") == "<" * 50_000 + "�"


def test_records_are_linked_and_read_back(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://h.example/", PAGE, "x"), (2, None, None, "x"), (3, "not a uri [", "", "x"), (3, "not a uri [", "", "x")],
        "page_id bigint, url string, html string, block string",
    )
    records = warc.derive(warc.responses_of_pages(pages)).collect()
    assert len(records) == 8 and warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0
    first = {r.record_type: r for r in records if r.key == 1}
    assert first["metadata"].refers_to == first["conversion"].refers_to and first["conversion"].block.startswith("First line")
    assert "outlink: http://h.example/x?a=1&b=2\r\n" in first["metadata"].block and "title: A & B\r\n" in first["metadata"].block
    assert first["conversion"].source_payload_digest == warc.digest(PAGE.encode())
    path = f"file://{tmp_path}/out"
    warc.write_records(warc.derive(warc.responses_of_pages(pages)).coalesce(1), path)
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("*.gz")))
    read = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        block, data = rest[:length], rest[length:]
        assert data.startswith(b"\r\n\r\n") and warc.digest(block).encode() in head
        data = data[4:]
        read.append(block.decode())
    assert sorted(read) == sorted(r.block for r in records)


def test_digest_is_base32_sha1():
    assert warc.digest(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(hashlib.sha1(b"").digest()) == 20
