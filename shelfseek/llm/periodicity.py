"""Periodic runs of words, found by minimizers at several scales.

A run is a stretch of words that repeats with its smallest period, ``EXPONENT`` times or more, and that no
neighbouring word continues. Periods up to ``SHORT`` are found by comparing every word with the one so many
places on. For longer ones, each scale w covers the periods of (2/3) w to w: hashes of all stretches of w
words, and of every w neighbouring hashes the smallest. Inside a run of period p <= w the smallest hash comes
back after exactly p places, and a run of four periods is long enough to hold two such places. So two
neighbouring minimizers of equal hash give a lag and a place to extend from; nothing else has to be compared.
The work per scale is linear in the words, there are as many scales as the logarithm of the text, and the
number of pairs tried is at most that of the minimizers.

Rows are handled one by one inside their tasks: no shuffle, and no state beyond a block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.llm.common import batches_of, text_bytes

#: Least length of a run in periods. The scales rely on four or more.
EXPONENT = 4
#: Least length of a run in words.
LEAST = 6
#: Longest period that is looked for by comparing words directly.
SHORT = 8
#: Texts are handled together until they have so many words; a longer text is a block of its own.
BLOCK_WORDS = 1 << 19

_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash for each pair of neighbouring stretches."""
    mixed = left * _FIRST + (right ^ (right >> np.uint64(31))) * _SECOND
    return mixed ^ (mixed >> np.uint64(29))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True that are ``least`` long or longer."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _matching(ids: np.ndarray, left: int, right: int, step: int) -> int:
    """How many words agree from ``left`` and ``right`` on, walking by ``step`` (1 or -1)."""
    total, size = 0, 64
    while True:
        room = len(ids) - max(left, right) if step > 0 else min(left, right) + 1
        size = min(size, room)
        if size <= 0:
            return total
        if step > 0:
            same = ids[left : left + size] == ids[right : right + size]
        else:
            same = (ids[left - size + 1 : left + 1] == ids[right - size + 1 : right + 1])[::-1]
        if not same.all():
            return total + int(np.argmin(same))
        total, left, right, size = total + size, left + step * size, right + step * size, size * 4


def _seeds(hashes: np.ndarray, halves: int, width: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of neighbouring minimizers of equal hash, one for each chain of the same lag.

    ``hashes`` are those of stretches of ``halves`` words, where halves <= width < 2 * halves.
    """
    if len(hashes) < width - halves + width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = _joined(hashes[: len(hashes) - (width - halves)], hashes[width - halves :])
    place_bits = np.uint64(int(len(whole)).bit_length())
    mask = (np.uint64(1) << place_bits) - np.uint64(1)
    # the upper bits of the hash with the place below them: of equal hashes the leftmost is the least
    least = _window_minima((whole & ~mask) | np.arange(len(whole), dtype=np.uint64), width) & mask
    places = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
    lags = np.diff(places)
    equal = (whole[places[1:]] == whole[places[:-1]]) & (lags <= width) & (lags > above)
    found = np.flatnonzero(equal)
    if len(found) > 1:
        chained = (np.diff(found) == 1) & (lags[found[1:]] == lags[found[:-1]])
        found = found[np.concatenate(([True], ~chained))]
    return places[found], lags[found]


def runs_of(ids: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """All runs of several texts as rows (start, end, period), in order of start, then period.

    ``ids`` are the numbers of the words, texts one after the other, each closed by a number that occurs
    once; ``sizes`` are the texts' lengths with it. Starts and ends are places in ``ids``.
    """
    if exponent < EXPONENT:
        raise ValueError(f"a run has at least {EXPONENT} periods")
    found: dict[tuple[int, int], int] = {}

    def note(start: int, end: int, period: int) -> None:
        # a stretch that repeats with a multiple of its period is the same stretch: the smaller one counts
        known = found.get((start, end))
        if known is None or period < known:
            found[start, end] = period

    for lag in range(1, min(SHORT, (len(ids) - 1) // exponent) + 1):
        for start, end in zip(*_stretches(ids[lag:] == ids[:-lag], max(least, exponent * lag) - lag)):
            note(int(start), int(end) + lag, lag)
    above, halves = SHORT, 1
    origin = np.arange(len(ids))
    with np.errstate(over="ignore"):
        hashes = _joined(ids.astype(np.uint64) * _SECOND, ids.astype(np.uint64))
        rest = np.asarray(sizes)
        while True:
            long = rest > exponent * (above + 1)
            if not long.any():
                break
            if not long.all():
                # texts too short for this scale go; stretches that reach beyond their text hold the closing number
                stay = np.repeat(long, rest)
                origin, rest = origin[stay], rest[long]
                hashes = hashes[stay[: len(hashes)]]
            width = above * 3 // 2
            while 2 * halves <= width:
                hashes = _joined(hashes[:-halves], hashes[halves:])
                halves *= 2
            places, lags = _seeds(hashes, halves, width, above)
            for place, lag in zip(origin[places].tolist(), lags.tolist()):
                start = place - _matching(ids, place - 1, place + lag - 1, -1)
                end = place + lag + _matching(ids, place, place + lag, 1)
                if end - start >= max(least, exponent * lag):
                    note(start, end, lag)
            above = width
    rows = sorted((start, period, end) for (start, end), period in found.items())
    return np.array([(start, end, period) for start, period, end in rows], np.int64).reshape(-1, 3)


def _blocks(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for text in texts:
        words = text.split()  # of bytes: cut at the six white signs of ASCII only
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words) + 1
    if block:
        yield block


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _block_runs(block: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Each text's runs as (start, length, period) in words."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(words) + 1 for words in block])
    ids = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for closing, words in enumerate(block, 1):
        ids[at : at + len(words)] = [number.setdefault(word, len(number)) for word in words]
        ids[at + len(words)] = -closing
        at += len(words) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in block]
    found = runs_of(ids, sizes, exponent, least)
    for text, (start, end, period) in zip(np.searchsorted(starts, found[:, 0], "right") - 1, found.tolist()):
        runs[text].append((start - int(starts[text]), end - start, period))
    return runs


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST
) -> DataFrame:
    """(``key``, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` holds (start, length, period) in words, by start, then period; ``collapsed`` is the text
    without the words that a run repeats, joined by single spaces. Words are what is left between the white
    signs of ASCII, compared byte by byte. A null or empty text, or one of white signs only, has no words, no
    runs and an empty collapsed text. Rows are independent: repeated rows, null and repeated keys each give a
    row; other columns of ``docs``, whatever their names, play no part. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [rows.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)),
         T.StructField("collapsed", T.StringType())]
    )
    run = pa.struct([pa.field(field.name, pa.int64(), False) for field in RUN])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            at = 0
            for block in _blocks(text_bytes(batch)):
                runs = _block_runs(block, exponent, least)
                flat = np.array([row for rows in runs for row in rows], np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run))
                ends = np.concatenate(([0], np.cumsum([len(rows) for rows in runs]))).astype(np.int32)
                kept = [b" ".join(_without_repeats(words, rows) if rows else words) for words, rows in zip(block, runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(at, len(block)), pa.array([len(words) for words in block], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), values), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "runs", "collapsed"],
                )
                at += len(block)

    return rows.mapInArrow(find, schema).withColumnRenamed("key", key)
