"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint. The bits are dealt into parts so that correlated bits share a part.
Two fingerprints that differ in at most ``max_bits`` places must, in some part i, differ in at most t_i
places, for any thresholds with sum(t_i + 1) = max_bits + 1 (a threshold of -1 skips its part). Each
fingerprint gets the thresholds of least estimated cost: a dynamic program over the parts, whose costs are
the number of keys to probe and the number of fingerprints behind them, read from histograms of the parts'
values. Probes are joined with the index of part values and verified inside the join.

Only distinct fingerprints are compared. Those that a sorted pass already shows to be linked are joined into
classes first, and the probe join gives links between different classes only; so a large group of near
copies costs comparisons, but not a row for each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of, summed, text_bytes, written
from shelfseek.llm.components import components

BITS = 64
SEED = 42
PARTS = 4
#: Cost of making, shuffling and sorting one probe, in comparisons of two fingerprints.
PROBE_COST = 40.0
#: Neighbours in sorted order that the first pass compares.
NEAR = 4
_BLOCK = 1 << 16
_PLACES = np.arange(BITS, dtype=np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text's ``width``-word shingles, unsigned; 0 if there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    total = len(words) - width + 1
    if total <= 1:
        return xxhash.xxh64_intdigest(joined, seed=SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for cut in range(0, total, _BLOCK):
        last = min(cut + _BLOCK, total)
        pairs = zip(starts[cut:last].tolist(), ends[cut + width - 1 : last + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed=SEED) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _PLACES)[2 * ones > total].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit number."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            found = np.array([fingerprint(t, width) for t in text_bytes(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, fp bigint")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("fp")).view(np.uint64)


def correlated_parts(nodes: DataFrame, parts: int) -> list[list[int]]:
    """The bits dealt into ``parts`` groups of even size, correlated bits together."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, single, rows = np.zeros((BITS, BITS)), np.zeros(BITS), 0
        for batch in batches_of(frame):
            for cut in range(0, batch.num_rows, _BLOCK):
                some = _fps(batch)[cut : cut + _BLOCK]
                bits = ((some[:, None] >> _PLACES) & np.uint64(1)).astype(np.float32)
                both += bits.T @ bits
                single += bits.sum(0)
                rows += len(some)
        part = np.concatenate([both.ravel(), single, [rows]])
        yield pa.RecordBatch.from_arrays([pa.array([part.tolist()])], ["part"])

    values = np.array(summed(nodes.select("fp").mapInArrow(run, "part array<double>")))
    if not len(values) or values[-1] == 0:
        return [list(range(i, BITS, parts)) for i in range(parts)]
    rows, mean = values[-1], values[BITS * BITS : -1] / values[-1]
    spread = values[: BITS * BITS].reshape(BITS, BITS) / rows - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(spread), 1e-12, None))
    related = np.abs(spread / np.outer(scale, scale))
    sizes = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    free, groups = list(range(BITS)), []
    for size in sizes:
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda bit: (related[bit, group].sum(), -bit))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for place, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def _masks(width: int, distance: int) -> np.ndarray:
    picks = combinations(range(width), distance)
    return np.array([sum(1 << place for place in pick) for pick in picks], np.int64)


def _histograms(index: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value of each part. At most 2**len(group) numbers a part."""
    counts = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    part, value, n = (np.asarray(counts.column(name)) for name in ("part", "value", "n"))
    histograms = []
    for i, group in enumerate(groups):
        counted = np.zeros(1 << len(group))
        counted[value[part == i]] = n[part == i]
        histograms.append(counted)
    return histograms


def probe_costs(histogram: np.ndarray, max_bits: int) -> np.ndarray:
    """[threshold + 1, value]: estimated cost of probing a part with a threshold of -1, 0, … ``max_bits``."""
    width = int(histogram.size).bit_length() - 1
    exact = [histogram] + [np.zeros_like(histogram)] * max_bits
    at = np.arange(histogram.size)
    for bit in range(width):
        flipped = at ^ (1 << bit)
        exact = [exact[0]] + [exact[d] + exact[d - 1][flipped] for d in range(1, max_bits + 1)]
    probes = np.cumsum([comb(width, d) for d in range(max_bits + 1)])
    costs = np.cumsum(exact, axis=0) + PROBE_COST * probes[:, None]
    return np.concatenate([np.zeros((1, histogram.size)), costs]).astype(np.float32)


def allocate(costs: list[np.ndarray], max_bits: int) -> np.ndarray:
    """[row, part]: the thresholds of least total cost. ``costs``: per part, [threshold + 1, row]."""
    rows, units = costs[0].shape[1], max_bits + 1
    best = np.full((units + 1, rows), np.inf)
    best[0] = 0
    choices = []
    for cost in costs:
        options = np.full((units + 1, units + 1, rows), np.inf)
        for spent in range(units + 1):
            for more in range(units + 1 - spent):
                options[spent + more, more] = best[spent] + cost[more]
        choices.append(options.argmin(axis=1))
        best = options.min(axis=1)
    left = np.full(rows, units)
    thresholds = np.empty((rows, len(costs)), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        taken = choices[i][left, np.arange(rows)]
        thresholds[:, i] = taken - 1
        left = left - taken
    return thresholds


_KEYED = "part int, value bigint, fp bigint, class bigint"


def _keyed(part: int, value: np.ndarray, fp: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(fp), part, np.int32)), pa.array(value), pa.array(fp), pa.array(label)]
    return pa.RecordBatch.from_arrays(columns, ["part", "value", "fp", "class"])


def _index(nodes: DataFrame, groups: list[list[int]]) -> DataFrame:
    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            fp, label = (np.asarray(batch.column(name)) for name in ("fp", "class"))
            for part, group in enumerate(groups):
                yield _keyed(part, _values(fp.view(np.uint64), group), fp, label)

    return nodes.select("fp", "class").mapInArrow(run, _KEYED)


def _probes(nodes: DataFrame, groups: list[list[int]], costs: list[np.ndarray], max_bits: int) -> DataFrame:
    masks = [[_masks(len(group), d) for d in range(max_bits + 1)] for group in groups]
    within = [[np.concatenate(m[: t + 1]) for t in range(max_bits + 1)] for m in masks]
    shared = nodes.sparkSession.sparkContext.broadcast(costs)  # (max_bits + 2) * 2**width numbers a part

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            fp, label = (np.asarray(batch.column(name)) for name in ("fp", "class"))
            values = [_values(fp.view(np.uint64), group) for group in groups]
            own = [cost[:, value] for cost, value in zip(shared.value, values, strict=True)]
            thresholds = allocate(own, max_bits)
            for part, value in enumerate(values):
                for t in range(max_bits + 1):
                    rows = np.flatnonzero(thresholds[:, part] == t)
                    step = max(1, _BLOCK // len(within[part][t]))
                    for cut in range(0, len(rows), step):
                        some = rows[cut : cut + step]
                        keys = (value[some, None] ^ within[part][t]).ravel()
                        n = len(within[part][t])
                        yield _keyed(part, keys, np.repeat(fp[some], n), np.repeat(label[some], n))

    return nodes.select("fp", "class").mapInArrow(run, _KEYED)


def _sorted_links(nodes: DataFrame, groups: list[list[int]], max_bits: int) -> DataFrame:
    """Links between neighbours when the fingerprints are sorted by each part's bits first.

    Only a shortcut: what it misses, also where two tasks meet, the probes find.
    """
    orders = [[bit for group in groups[i:] + groups[:i] for bit in group] for i in range(len(groups))]

    def turned(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            for i, order in enumerate(orders):
                key = _values(_fps(batch), order[::-1])
                turn = pa.array(np.full(batch.num_rows, i, np.int32))
                yield pa.RecordBatch.from_arrays([turn, pa.array(key), batch.column("fp")], ["turn", "key", "fp"])

    def neighbours(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            fp = _fps(batch)
            for lag in range(1, min(NEAR, len(fp) - 1) + 1):
                near = np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= max_bits
                ends = [pa.array(x[near].view(np.int64)) for x in (fp[lag:], fp[:-lag])]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    keyed = nodes.select("fp").mapInArrow(turned, "turn int, key bigint, fp bigint")
    ordered = keyed.repartitionByRange("turn", "key").sortWithinPartitions("turn", "key")
    return ordered.mapInArrow(neighbours, "a bigint, b bigint")


def link_fingerprints(nodes: DataFrame, max_bits: int, parts: int = PARTS) -> DataFrame:
    """(fp, class) for all distinct fingerprints ``nodes`` (column fp): equal class, linked by a chain.

    Parts of 64 / ``parts`` bits: more fingerprints than about 2**30 want fewer, longer parts.
    """
    groups = correlated_parts(nodes, parts)
    first = components(_sorted_links(nodes, groups, max_bits), "simhash-near")
    classed = nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left")
    classed = written(classed.select("fp", F.coalesce("component", "fp").alias("class")), "simhash-classes")
    index = _index(classed, groups)
    costs = [probe_costs(histogram, max_bits) for histogram in _histograms(index, groups)]
    x, y = _probes(classed, groups, costs, max_bits).alias("x"), index.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    same = (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value"))
    pairs = x.join(y, same & (F.col("x.class") != F.col("y.class")) & near)
    links = pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    joined = components(links, "simhash-links").select(F.col("node").alias("class"), "component")
    merged = classed.join(joined, "class", "left")
    return merged.select("fp", F.coalesce("component", "class").alias("class"))


def simhash_groups(docs: DataFrame, width: int, max_bits: int, parts: int = PARTS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are not looked at).

    Words are maximal runs without white space, lower-cased for A-Z; ``width``-word shingles count as often
    as they occur. A text with fewer words is one shingle; a null or empty one has the fingerprint 0, which
    is linked like any other. component_id is the smallest doc_id that a chain of links reaches. Rows with a
    null doc_id are linked too; a group of such rows only has a null component_id. Repeated rows give
    repeated results, an empty table an empty one.
    """
    fps = written(fingerprints(docs, width), "simhash-fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = written(link_fingerprints(nodes.select("fp"), max_bits, parts), "simhash-linked")
    members = nodes.join(linked, "fp")
    named = members.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = linked.join(named, "class").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates_dropped(docs: DataFrame, width: int, max_bits: int, columns: list[str]) -> DataFrame:
    """``docs`` (its ``columns``) with one row of every group of near-duplicates: that of the smallest doc_id.

    Of rows that share this doc_id the one with the smallest values of ``columns`` stays. Rows without a
    doc_id cannot be named in a group; they all stay.
    """
    groups = simhash_groups(docs.where("doc_id is not null"), width, max_bits)
    chosen = groups.where("doc_id = component_id").select("doc_id").distinct()
    whole = docs.select(*columns)
    rest = F.struct(*[c for c in columns if c != "doc_id"])
    rows = whole.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("rest"))
    return rows.select("doc_id", "rest.*").select(*columns).unionByName(whole.where("doc_id is null"))
