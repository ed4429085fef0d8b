"""Best-fit packing of tokenised documents into sequences of bounded length, by hierarchical rounds.

Round 0 packs the pieces of every partition by best fit, longest first. Bins that are nearly full are
emitted; an underfull bin becomes one item, as long as its content, of the next round. Each round merges
the partitions of the one before, ``FAN_IN`` at a time, and packs their items by best fit again. The rounds
end when one task would hold all items, or when fewer tasks would hold more than ``ITEMS`` each. What a task
holds is bounded; every round is written before the next one reads it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from re import compile as pattern

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfseek.llm.common import batches_of, written
from shelfseek.workspace import new_path

CAPACITY = 2048
#: A bin with at most this much room left is emitted at once.
NEARLY_FULL = 8
#: Partitions merged into one from round to round.
FAN_IN = 4
#: Most items that a task packs at a time.
ITEMS = 500_000
END_ID = 0
_REMEMBERED = 700_000

#: Fixed value: how byte-level BPE cuts a text before it merges.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_SPACE = pattern(r"(?<=\S) (?=\S)")
_OTHER_SPACE = pattern(r"[^\S \n]")


# --- tokens ---------------------------------------------------------------------------------------------


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for every byte, with its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(byte): byte for byte in plain}
    others = (byte for byte in range(256) if byte not in plain)
    return signs | {chr(256 + i): byte for i, byte in enumerate(others)}


def _ranked(config: dict) -> tiktoken.Encoding | None:
    """The same encoding by ranks, where the tokenizer is a plain byte-level BPE whose ids follow its merges."""
    model, before = config["model"], config.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space") or config.get("normalizer") or model.get("ignore_merges"):
        return None
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocab, signs = model["vocab"], _byte_signs()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get("".join(merge), -1) for merge in merges]
    added = {token["content"] for token in config.get("added_tokens", [])}
    if ids != sorted(ids) or not all(sign in vocab for sign in signs):
        return None
    if len(set(ids)) + len(signs) != len(vocab.keys() - added):
        return None
    ranks = {bytes(signs[s] for s in text): i for text, i in vocab.items() if text not in added}
    return tiktoken.Encoding("ranked", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})


class TokenIds:
    """A text's token ids as little-endian unsigned 32-bit numbers, equal to the tokenizer's own.

    A byte-level BPE never merges across a single space between two other signs, so a text is cut there and
    the ids of pieces seen before are remembered.
    """

    def __init__(self, config: str):
        parsed = json.loads(config)
        self.tokenizer = Tokenizer.from_str(config)
        self.added = [token["content"] for token in parsed.get("added_tokens", [])]
        self.ranked = _ranked(parsed)
        ranked = self.ranked

        class After(dict):
            """Ids of a space and a piece, by piece."""

            def __missing__(self, piece: str) -> bytes:
                ids = np.array(ranked.encode_ordinary(" " + piece), "<u4").tobytes()
                if len(self) < _REMEMBERED:
                    self[piece] = ids
                return ids

        self.after = After()

    def of(self, text: str) -> bytes:
        if self.ranked is None or any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        if odd or _OTHER_SPACE.search(text):
            first, *rest = _PLAIN_SPACE.split(text)
        else:
            first, *rest = text.split(" ")
        start = np.array(self.ranked.encode_ordinary(first), "<u4").tobytes()
        return start + b"".join(map(self.after.__getitem__, rest))


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first piece that holds the remainder."""
    first = total % capacity
    bounds = ([(0, first)] if first else []) + [(at, capacity) for at in range(first, total, capacity)]
    return bounds


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut to size."""
    with open(tokenizer_path, encoding="utf-8") as file:
        config = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, whatever the data

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenIds(config.value)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches_of(frame):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(tokens.of(text or "") + end)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), bytes(own) if with_ids else None))
            doc_id, piece, start, length, crc, own = zip(*rows, strict=True)
            arrays = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(own, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, [*_PIECE, "ids"][: len(arrays)])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, f"{_PIECE_TYPE}{', ids binary' * with_ids}")


# --- rounds ---------------------------------------------------------------------------------------------

_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_BIN = (
    "closed boolean, sequence_id bigint, fill bigint, members array<struct<doc_id:bigint,piece:int,"
    "start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item: longest first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        enough = rooms >> length
        if enough:
            room = length + (enough & -enough).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, opened = capacity, opened, opened + 1
        bins[item] = chosen
        left = room - length
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins


def _pack(items: pa.Table, capacity: int, nearly_full: int, last: bool, first_id: int) -> pa.RecordBatch:
    """Bins of items. An item is a bin of the round before: its members keep their order."""
    items = items.sort_by([("fill", "descending"), ("sequence_id", "ascending")])
    lists = items.column("members").combine_chunks()
    fills = np.asarray(items.column("fill"))
    bins = best_fit(fills, capacity)
    order = np.argsort(bins, kind="stable")
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    starts = np.asarray(lists.offsets)[:-1].astype(np.int64)
    taken = sizes[order]
    ends = np.cumsum(taken)
    flat = np.repeat(starts[order] - (ends - taken), taken) + np.arange(taken.sum())
    members = lists.values.take(pa.array(flat))
    of_bin = np.repeat(bins[order], taken)
    n_bins = int(bins.max()) + 1
    fill = np.bincount(bins, weights=fills, minlength=n_bins).astype(np.int64)
    length = np.asarray(members.field("length"))
    before = np.cumsum(length) - length
    counts = np.bincount(of_bin, minlength=n_bins)
    first = np.concatenate([[0], np.cumsum(counts)])
    offset = before - before[first[:-1]][of_bin]
    fields = [members.field(name) for name in _PIECE] + [pa.array(offset)]
    structs = pa.StructArray.from_arrays(fields, [*_PIECE, "offset"])
    closed = np.ones(n_bins, bool) if last else fill >= capacity - nearly_full
    columns = [
        pa.array(closed), pa.array(first_id + np.arange(n_bins)), pa.array(fill),
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), structs),
    ]
    return pa.RecordBatch.from_arrays(columns, ["closed", "sequence_id", "fill", "members"])


def _round(items: DataFrame, number: int, capacity: int, nearly_full: int, last: bool, path: str) -> None:
    """Pack every partition of ``items`` on its own and write its bins, closed and open ones apart."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = (number << 56) + (TaskContext.get().partitionId() << 36)
        held: list[pa.RecordBatch] = []
        for batch in batches_of(frame):
            held.append(batch)
            if sum(b.num_rows for b in held) >= ITEMS:
                packed = _pack(pa.Table.from_batches(held), capacity, nearly_full, last, next_id)
                next_id, held = next_id + packed.num_rows, []
                yield packed
        if held:
            yield _pack(pa.Table.from_batches(held), capacity, nearly_full, last, next_id)

    items.select("sequence_id", "fill", "members").mapInArrow(run, _BIN).write.partitionBy("closed").parquet(path)


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; each sequence is gapless and at most ``capacity`` long.

    ``items`` has the columns of ``pieces`` (lengths between 1 and ``capacity``). An empty table gives an
    empty one. Bins cannot be opened again, so the number of sequences is not proven least; it never exceeds
    what best fit inside each partition gives.
    """
    spark = items.sparkSession
    member = F.struct(*_PIECE, F.lit(0).cast("bigint").alias("offset"))
    alone = items.select(
        F.xxhash64("doc_id", "piece", "start").alias("sequence_id"), F.col("length").alias("fill"),
        F.array(member).alias("members"),
    )
    paths, number, tasks = [], 0, alone.rdd.getNumPartitions()
    while True:
        paths.append(new_path(spark, f"packing-round{number}"))
        _round(alone, number, capacity, nearly_full, tasks <= 1, paths[-1])
        if tasks <= 1:
            break
        bins = spark.read.schema(_BIN).parquet(paths[-1])
        alone = bins.where("not closed")
        waiting = alone.count()
        if not waiting:
            break
        fewer = max(-(-waiting // ITEMS), tasks // fan_in, 1)
        if fewer >= tasks:
            break
        alone, tasks, number = alone.coalesce(fewer), fewer, number + 1
    done = spark.read.schema(_BIN).parquet(paths[-1])
    for path in paths[:-1]:
        done = done.unionByName(spark.read.schema(_BIN).parquet(path).where("closed"))
    flat = done.select("sequence_id", F.explode("members").alias("m"))
    return flat.select(*[f"m.{name}" for name in _PIECE], "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) tokenised, ended with id 0, cut and packed.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the end id alone. Rows that repeat, or lack a doc_id, are packed like any others; other columns of
    ``docs`` are not looked at.
    """
    return pack(written(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
