"""Phrases of words that belong together, counted in depth-truncated suffix trees built group by group.

Every word starts a suffix that ends with its piece of text or after four words. Vertical partitioning deals
the suffixes to groups by a prefix of variable length: prefixes of one word, then of two, are counted first; one
that occurs more often than the memory budget is extended by a further word, and prefixes are gathered until a
group fills the budget. Behind a word or a pair of words that occurs less often than asked for there is no
candidate, so suffixes end there; bitmaps of fixed size say so, and can only err towards keeping. Each group is
sorted and read by one task as the subtrees of its suffixes: two neighbours part at some depth, and every node
below it is complete and gives its total, the sum of its leaves.

All counts are exact. Equal suffixes are added up before they are shuffled, so copies and frequent words cost
one row per block of texts. Nothing is collected but bitmaps and the loads of buckets, of fixed sizes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of, written

NO_LANGUAGE = "und"
#: Occurrences of a prefix, and of all prefixes of a group.
BUDGET = 1 << 20
#: Places of the bitmaps of frequent words and pairs, as powers of two.
WORD_BITS, PAIR_BITS = 23, 25
#: Buckets that prefixes are hashed to before the buckets are gathered into groups.
BUCKETS = 1 << 15
#: Bytes of text that are counted together before anything is handed on.
BLOCK_BYTES = 6 << 20
#: Copies of a word's count that the lookups of that word are dealt to.
COPIES = 8

_BREAKS = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d", b".........")
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")
_DEPTH = 4


# --- blocks of texts ------------------------------------------------------------------------------------


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of a prefix from that of its words but the last, and of the last one."""
    with np.errstate(over="ignore"):
        key = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return key ^ (key >> np.uint64(29))


class _Block:
    """The words of some texts of one language as numbers; -1 ends every piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        number: dict[bytes, int] = {b".": -1}
        ids: list[int] = []
        for text in texts:
            # ASCII letters only are lower-cased; what is left between breaks and white signs are words
            words = text.lower().translate(_BREAKS).replace(b".", b" . ").split()
            ids += [number.setdefault(word, len(number) - 1) for word in words]
            ids.append(-1)
        del number[b"."]
        self.words = list(number)
        self.ids = np.array([*ids, *[-1] * _DEPTH], np.int64)

    def keys(self) -> np.ndarray:
        """64-bit hashes of the language and each word, and of the end of a piece at last."""
        seed = xxhash.xxh32_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(word, seed=seed) for word in (*self.words, b".")), np.uint64)

    def pair_keys(self, keys: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose word and next word are in the bitmap, and the keys of these pairs."""
        known = _bit_set(frequent, keys)
        known[-1] = False
        first, second = self.ids[:-_DEPTH], self.ids[1 : 1 - _DEPTH]
        places = np.flatnonzero(known[first] & known[second])
        return places, _mixed(keys[first[places]], keys[second[places]])

    def counted(self, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct rows of the columns, how often each occurs, and the place of its first occurrence."""
        used = np.zeros(len(self.words) + 1, bool)
        for column in columns:
            used[column] = True
        number = np.cumsum(used)  # smaller numbers, so that more columns fit 64 bits
        code, size = np.zeros(len(columns[0]), np.int64), int(number[-1]) + 1
        for column in columns:
            if (int(code.max(initial=0)) + 1) * size >= 1 << 62:
                _, code = np.unique(code, return_inverse=True)
            code = code * size + number[column]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return [column[first] for column in columns], n, first

    def strings(self, columns: list[np.ndarray]) -> list[pa.Array]:
        """The language and the words of each column; -1 is null."""
        vocabulary = pa.array(self.words, pa.binary()).cast(pa.string())
        words = [vocabulary.take(pa.array(column, mask=column < 0)) for column in columns]
        return [pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(columns[0]), np.int64))), *words]


def _parts(text: bytes) -> Iterator[bytes]:
    """A very long text in parts that end at a break; without a break it stays whole."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        found = _BREAK.search(text, at + BLOCK_BYTES)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Texts gathered by language until they have ``BLOCK_BYTES``; blocks without words are left out."""
    waiting: dict[str, list[bytes]] = {}
    size = 0

    def full() -> Iterator[_Block]:
        return (block for block in (_Block(name, texts) for name, texts in waiting.items()) if block.words)

    for batch in batches_of(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for part in _parts(text):
                waiting.setdefault(lang, []).append(part)
                size += len(part)
                if size > BLOCK_BYTES:
                    yield from full()
                    waiting, size = {}, 0
    yield from full()


# --- vertical partitioning ------------------------------------------------------------------------------


def _bit_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % np.uint64(len(bits) * 8)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, power: int) -> np.ndarray:
    """2**``power`` bits, set where the column ``key`` says."""
    slot = F.expr(f"shiftrightunsigned(key & {(1 << power) - 1}L, 6)").alias("slot")
    word = F.expr("shiftleft(1L, cast(key & 63 as int))").alias("word")
    found = keys.select(slot, word).groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(1 << power - 6, np.uint64)
    words[np.asarray(found.column("slot"))] = np.asarray(found.column("word")).view(np.uint64)
    return words.view(np.uint8)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = np.bincount(block.ids[block.ids >= 0], minlength=len(block.words))
            arrays = block.strings([np.arange(len(block.words))])
            keys = block.keys()[:-1].view(np.int64)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys), pa.array(n, pa.int64())], ["lang", "word", "key", "n"])

    parts = docs.mapInArrow(run, "lang string, word string, key bigint, n bigint")
    return parts.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, word_bits: np.ndarray, hot_words: np.ndarray) -> DataFrame:
    """(key, hot, n) of all pairs of frequent words, by the key alone; ``hot`` where the first word is extended.

    Pairs of equal key are counted together, which can only keep more of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((word_bits, hot_words))  # bitmaps of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = shared.value
        for block in _blocks(batches):
            keys = block.keys()
            places, pairs = block.pair_keys(keys, frequent)
            pairs, first, n = np.unique(pairs, return_index=True, return_counts=True)
            is_hot = _bit_set(hot, keys[block.ids[places[first]]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs.view(np.int64)), pa.array(is_hot), pa.array(n, pa.int64())], ["key", "hot", "n"]
            )

    # a block has a pair once, so adding up before the shuffle would find next to nothing
    parts = docs.mapInArrow(run, "key bigint, hot boolean, n bigint").repartition("key")
    return parts.groupBy("key", "hot").agg(F.sum("n").alias("n"))


class Partition:
    """To which group each suffix goes. Bitmaps and buckets only, of fixed sizes."""

    def __init__(self, words: DataFrame, word_bits: np.ndarray, hot_words: np.ndarray, pairs: DataFrame, budget: int):
        self.word_bits, self.hot_words = word_bits, hot_words
        self.pair_bits = bitmap(pairs, PAIR_BITS)
        self.hot_pairs = bitmap(pairs.where(F.col("n") > budget), WORD_BITS)
        alone = words.where(F.col("n") <= budget).select("key", "n")
        extended = pairs.where("hot").select(F.when(F.col("n") <= budget, F.col("key")).alias("key"), "n")
        bucket = F.coalesce(F.col("key").bitwiseAND(F.lit(BUCKETS - 1)), F.lit(BUCKETS).cast("bigint")).alias("bucket")
        found = alone.union(extended).groupBy(bucket).agg(F.sum("n").alias("n")).toArrow()
        load = np.zeros(BUCKETS + 1)
        load[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
        # what hangs below pairs that are extended once more is dealt to all buckets alike
        load = load[:BUCKETS] + load[BUCKETS] / BUCKETS
        self.group = np.zeros(BUCKETS, np.int32)
        group = filled = 0
        for place, n in enumerate(load.tolist()):
            if filled and filled + n > budget:
                group, filled = group + 1, 0
            self.group[place] = group
            filled += n
        self.groups = group + 1

    def prefix_lengths(self, word_keys: np.ndarray, pair_keys: np.ndarray) -> np.ndarray:
        hot = _bit_set(self.hot_words, word_keys)
        return 1 + hot + (hot & _bit_set(self.hot_pairs, pair_keys))


def _suffixes(block: _Block, part: Partition) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of two to four words whose pairs are all frequent: words, count, key of the pair,
    group, and whether the prefix is longer than the pair."""
    keys = block.keys()
    places, pairs = block.pair_keys(keys, part.word_bits)
    frequent = _bit_set(part.pair_bits, pairs)
    places, pairs = places[frequent], pairs[frequent]
    follows = np.zeros(len(block.ids), bool)
    follows[places] = True
    third = follows[places + 1]
    columns = [block.ids[places], block.ids[places + 1], np.where(third, block.ids[places + 2], -1)]
    columns.append(np.where(third & follows[places + 2], block.ids[places + 3], -1))
    columns, n, first = block.counted(columns)
    pairs = pairs[first]
    length = part.prefix_lengths(keys[columns[0]], pairs)
    prefix = np.select([length == 1, length == 2], [keys[columns[0]], pairs], _mixed(pairs, keys[columns[2]]))
    return columns, n, pairs, part.group[(prefix % np.uint64(BUCKETS)).astype(np.int64)], length > 2


def truncated_suffixes(docs: DataFrame, partition: Partition) -> DataFrame:
    """(lang, w1, w2, w3 or null, w4 or null, n, pair, grp, split): suffixes of two words or more."""
    schema = "lang string, w1 string, w2 string, w3 string, w4 string, n bigint, pair bigint, grp int, split boolean"
    shared = docs.sparkSession.sparkContext.broadcast(partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            columns, n, pairs, group, split = _suffixes(block, shared.value)
            arrays = [pa.array(n, pa.int64()), pa.array(pairs.view(np.int64)), pa.array(group), pa.array(split)]
            yield pa.RecordBatch.from_arrays(
                [*block.strings(columns), *arrays], [field.split()[0] for field in schema.split(", ")]
            )

    return docs.mapInArrow(run, schema)


# --- subtrees -------------------------------------------------------------------------------------------

_NODE = ["lang", "w1", "w2", "w3", "w4"]


def _changes(batch: pa.RecordBatch, before: list | None) -> Iterator[np.ndarray]:
    """Per depth from the second on, at which rows a node of that depth begins; ``before`` is the row above."""
    changed = np.zeros(batch.num_rows, bool)
    changed[0] = before is None
    for place, name in enumerate(_NODE):
        column = pc.fill_null(batch.column(name), "\n")  # no word holds a line break
        changed[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)
        changed[0] |= before is not None and before[place] != batch.column(name)[0].as_py()
        if place >= 2:
            yield np.flatnonzero(changed)


def subtree_counts(suffixes: DataFrame, groups: int, at_least: int) -> DataFrame:
    """(lang, w1, w2, w3, w4, n) of all nodes of two to four words that occur ``at_least`` so often.

    Suffixes that share a node are neighbours in a task, so a node is complete when the next suffix parts above
    it; only the open path is remembered. A suffix that ends early is a leaf of its last node. A pair that was
    extended lies in several groups: its parts are handed on whatever their counts, and added up.
    """

    def rows(nodes: list[tuple[list, int, bool]]) -> pa.RecordBatch:
        kept = [
            (*path, *[None] * (5 - len(path)), n) for path, n, split in nodes
            if path[-1] is not None and (n >= at_least or (split and len(path) == 3))
        ]
        arrays = [pa.array([row[i] for row in kept], pa.string()) for i in range(5)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([row[5] for row in kept], pa.int64())], [*_NODE, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: dict[int, tuple[list, int, bool]] = {}  # the open node of each depth
        before = None
        for batch in batches_of(batches):
            n, split = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("n", "split"))
            for depth, starts in enumerate(_changes(batch, before), 2):
                if depth in path:
                    words, total, extended = path[depth]
                    path[depth] = words, total + int(n[: starts[0] if len(starts) else None].sum()), extended
                if not len(starts):
                    continue
                if depth in path:
                    yield rows([path[depth]])
                totals = np.add.reduceat(n, starts)
                nodes = batch.select(_NODE[: depth + 1]).take(pa.array(starts))
                whole = totals >= at_least
                if depth == 2:
                    whole |= split[starts].astype(bool)
                whole &= nodes.column(depth).is_valid().to_numpy(zero_copy_only=False)
                whole[-1] = False
                done = nodes.filter(pa.array(whole))
                columns = [*done.columns, *[pa.nulls(done.num_rows, pa.string())] * (4 - depth)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(totals[whole], pa.int64())], [*_NODE, "n"])
                last = [nodes.column(i)[len(starts) - 1].as_py() for i in range(depth + 1)]
                path[depth] = last, int(totals[-1]), bool(split[starts[-1]])
            before = [batch.column(name)[batch.num_rows - 1].as_py() for name in _NODE]
        yield rows(list(path.values()))

    dealt = suffixes.repartition(groups, "grp").sortWithinPartitions("pair", *_NODE).select(*_NODE, "n", "split")
    nodes = dealt.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, n bigint")
    return nodes.groupBy(*_NODE).agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def phrase_counts(
    docs: DataFrame, at_least: int, budget: int = BUDGET, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n), (lang, n)): phrases of one to four words that occur ``at_least`` so often, and all words."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    every_word = written(word_counts(texts), "words")
    words = every_word.where(F.col("n") >= at_least)
    word_bits, hot_words = bitmap(words, WORD_BITS), bitmap(words.where(F.col("n") > budget), WORD_BITS)
    pairs = written(pair_counts(texts, word_bits, hot_words).where(F.col("n") >= at_least), "pairs")
    partition = Partition(words, word_bits, hot_words, pairs, budget)
    longer = subtree_counts(truncated_suffixes(texts, partition), partition.groups, at_least)
    size = F.when(F.col("w3").isNull(), 2).when(F.col("w4").isNull(), 3).otherwise(4).alias("size")
    phrases = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n").union(
        longer.select("lang", F.concat_ws(" ", *_NODE[1:]).alias("phrase"), size, "n")
    )
    return written(phrases, "phrases"), every_word.groupBy("lang").agg(F.sum("n").alias("n"))


# --- the operator ---------------------------------------------------------------------------------------


def _joined(words: F.Column, start: F.Column | int, size: F.Column | int) -> F.Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, at_least: int = 30, scale: int = 2_000_000, covered: tuple[int, int] = (80, 100), first: int = 2000,
    budget: int = BUDGET,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score.

    A candidate is a phrase of two to four words that occurs a >= ``at_least`` times inside pieces of text.
    Cut in two parts that occur l and r times, it scores floor(scale * a / (l + r)); the cut of the smallest
    score counts, then the earliest. A candidate whose words lie side by side in a longer candidate of f
    occurrences goes if covered[1] * f >= covered[0] * a. ``n`` counts all words of the language. Order is
    score and a downwards, then the phrase's bytes. Numbers are exact beyond 64 bits.

    A null language counts as ``und``, a null text as empty. Repeated rows and keys count as often as they
    come; columns other than text and lang play no part. Without candidates, or rows, there are no rows.
    """
    phrases, totals = phrase_counts(docs, at_least, budget)
    words = F.split("phrase", " ")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))

    # what each candidate covers: the highest count of a longer one around a phrase, pre-aggregated by it
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _joined(words, i, k)),
    )))
    around = candidates.where("size > 2").select("lang", inner.alias("phrase"), F.col("a").alias("f"))
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    exact = lambda name: F.col(name).cast("decimal(20,0)")
    gone = F.col("f").isNotNull() & (exact("f") * covered[1] >= exact("a") * covered[0])
    left = written(candidates.join(around, ["lang", "phrase"], "left").where(~F.coalesce(gone, F.lit(False))).drop("f"), "kept")

    # each cut asks for the counts of its two parts; lookups of one word are dealt to copies of its count
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), _joined(words, F.lit(1), k).alias("left"), _joined(words, k + 1, F.col("size") - k).alias("right"),
    )))
    asked = left.select("lang", "phrase", "a", "size", cuts.alias("cut")).select(
        "lang", "phrase", "a", F.col("cut.k").alias("k"),
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_left"), F.col("cut.left").alias("part"), (F.col("cut.k") == 1).alias("single")),
            F.struct(F.lit(False).alias("is_left"), F.col("cut.right").alias("part"), (F.col("size") - F.col("cut.k") == 1).alias("single")),
        )).alias("ask"),
    ).select("lang", "phrase", "a", "k", "ask.*")
    copy = F.when(F.col("single"), F.pmod(F.xxhash64("phrase", "k"), F.lit(COPIES))).otherwise(0)
    copies = F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0))))
    counts = phrases.where("size < 4").select("lang", F.col("phrase").alias("part"), "n", copies.alias("copy"))
    answered = asked.withColumn("copy", copy.cast("int")).join(counts, ["lang", "part", "copy"])
    both = answered.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("is_left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("n"))).alias("r")
    )
    value = F.expr(f"(cast({scale} as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = both.withColumn("score", value).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
