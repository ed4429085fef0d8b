"""SentencePiece encoding that keeps, for every piece, the bytes of the source text it stands for.

A text is normalised by the longest prefix found in the model's compiled character map; every normalised
character remembers the byte of the source it came from. The normalised text is then cut into pieces by the
model's own merges, and each piece's stretch of normalised characters is projected back onto source bytes.
The segmenter is loaded with an identity normaliser, so that normalisation happens here only.

Where no piece of the vocabulary holds a word mark after another sign, merges cannot cross a word's start:
then a text is segmented in stretches of some thousand characters that end before a word, so that a very long
one costs the segmenter no memory. Any other vocabulary gets its texts whole. Rows are independent: no shuffle,
one block of texts at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.llm.common import batches_of

MARK = "▁"
#: Characters of a stretch that is segmented by itself, to the next start of a word.
STRETCH = 8192
#: Texts are handled and handed on together until they have so many characters.
BLOCK_CHARACTERS = 1 << 22

# Numbers of the model file's format: fields of the model, of a piece, of both specifications; kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, KIND = 1, 3
CHARACTER_MAP, DUMMY_PREFIX, FEWER_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
SPACE_AS_SUFFIX, BYTE_FALLBACK = 24, 35
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


# --- the model file -------------------------------------------------------------------------------------


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _written_number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(field, value, the bytes that say so) of a message in the tagged binary format of model files."""
    at = 0
    while at < len(message):
        start = at
        tag, at = _number(message, at)
        if tag & 7 == 0:
            value, at = _number(message, at)
        else:
            size, at = _number(message, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value, message[start:at]


def message_of(field: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _written_number(field << 3) + _written_number(value)
    return _written_number(field << 3 | 2) + _written_number(len(value)) + value


def compiled_map(blob: bytes) -> dict[str, str]:
    """All (from, to) pairs of a compiled character map: the size of a double array, the array, the targets.

    A unit's low byte is its label, bit 8 says that it ends a key (its value is in the unit it points to),
    and the upper bits are the offset of its children, relative to its own place.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    targets = blob[4 + size :]
    offsets = (units >> 10) << ((units & 512) >> 6)
    labels = units & (1 << 31 | 255)
    pairs: dict[str, str] = {}
    stack = [(int(offsets[0]), b"")]
    children = np.arange(1, 256)
    while stack:
        base, key = stack.pop()
        places = base ^ children
        places, bytes_ = places[places < len(units)], children[places < len(units)]
        for place, byte in zip(places[labels[places] == bytes_].tolist(), bytes_[labels[places] == bytes_].tolist()):
            word, below = key + bytes([byte]), place ^ int(offsets[place])
            if units[place] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                pairs[word.decode()] = targets[start : targets.index(0, start)].decode()
            stack.append((below, word))
    return pairs


# --- normalisation --------------------------------------------------------------------------------------


class Normaliser:
    """A model's normalisation, with the source byte of every normalised character."""

    def __init__(self, spec: bytes, trainer: bytes = b"", kept: tuple[str, ...] = ()):
        said = {field: value for field, value, _ in fields(spec)}
        self.pairs = compiled_map(said.get(CHARACTER_MAP, b""))
        self.dummy, self.fewer = bool(said.get(DUMMY_PREFIX, 1)), bool(said.get(FEWER_SPACES, 1))
        self.escape = bool(said.get(ESCAPE_SPACES, 1))
        self.suffix = any(field == SPACE_AS_SUFFIX and value for field, value, _ in fields(trainer))
        # user-defined pieces are looked up first and stay as they are
        self.kept, self.longest_kept = set(kept), max(map(len, kept), default=0)
        self.longest = max(map(len, self.pairs), default=0)
        alone = {key for key in self.pairs if len(key) == 1} | {key[0] for key in self.kept}
        second = {key[1] for key in self.pairs if len(key) > 1}
        choices = [f"[{re.escape(''.join(sorted(alone)))}]"] * bool(alone)
        choices += [f"(?s:.)(?=[{re.escape(''.join(sorted(second)))}])"] * bool(second)
        self.places = re.compile("|".join(choices)) if choices else None

    def _prefix(self, text: str, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest known prefix of ``text[at:]``."""
        for size in range(min(self.longest_kept, len(text) - at), 0, -1):
            if text[at : at + size] in self.kept:
                return size, text[at : at + size]
        for size in range(min(self.longest, len(text) - at), 0, -1):
            found = self.pairs.get(text[at : at + size])
            if found is not None:
                return size, found
        return None

    def _leading(self, text: str) -> int:
        """How many characters at the front are normalised to a space each."""
        at = 0
        while at < len(text):
            size, to = self._prefix(text, at) or (1, text[at])
            if to != " ":
                break
            at += size
        return at

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the source byte it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        source = _byte_places(text)
        origin, end = source[:-1], int(source[-1])
        start = int(source[self._leading(text)]) if self.fewer else 0
        if start == end:
            return "", np.array([end])
        if self.places is not None:
            parts, origins, at = [], [], 0
            for match in self.places.finditer(text):
                place = match.start()
                found = self._prefix(text, place) if place >= at else None
                if found is None:
                    continue
                size, to = found
                parts += [text[at:place], to]
                origins += [origin[at:place], np.full(len(to), origin[place])]
                at = place + size
            text, origin = "".join([*parts, text[at:]]), np.concatenate([*origins, origin[at:]])
        if self.fewer:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            spaces = points == 32
            keep = ~(spaces & np.concatenate(([True], spaces[:-1])))
            text, origin = points[keep].tobytes().decode("utf-32-le"), origin[keep]
        if self.escape:
            text = text.replace(" ", MARK)
        space = MARK if self.escape else " "
        if self.dummy and not self.suffix:
            text, origin = space + text, np.concatenate(([start], origin))
        if self.fewer:
            short = text.rstrip(space)
            if len(short) < len(text):
                end = int(origin[len(short)])
            text, origin = short, origin[: len(short)]
        if self.dummy and self.suffix:
            text, origin = text + space, np.append(origin, end)
        return text, np.append(origin, end)


def _byte_places(text: str) -> np.ndarray:
    """The byte at which each character starts, and the number of bytes."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(sizes)))


# --- pieces ---------------------------------------------------------------------------------------------


def spans_of(answer: bytes) -> np.ndarray:
    """Rows (id, first byte, last byte exclusive) of the library's answer in its binary format."""
    rows = []
    for field, value, _ in fields(answer):
        if field == 2:
            about = {name: found for name, found, _ in fields(value)}
            rows.append((about.get(2, 0), about.get(4, 0), about.get(5, 0)))
    return np.array(rows, np.int64).reshape(-1, 3)


class Encoder:
    """Ids and source spans of texts under one model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, normalizer, trainer, others = [], b"", b"", []
        for field, value, said in fields(model):
            if field == PIECES:
                about = {name: found for name, found, _ in fields(value)}
                pieces.append((about.get(PIECE, b"").decode(), about.get(KIND, NORMAL)))
            if field == NORMALIZER:
                normalizer = value
            else:
                others.append(said)
                trainer = value if field == TRAINER else trainer
        as_is = message_of(1, b"identity") + b"".join(message_of(f, 0) for f in (DUMMY_PREFIX, FEWER_SPACES, ESCAPE_SPACES))
        self.segmenter = sentencepiece.SentencePieceProcessor(
            model_proto=b"".join(others) + message_of(NORMALIZER, as_is)
        )
        kept = tuple(text for text, kind in pieces if kind == USER_DEFINED)
        self.normaliser = Normaliser(normalizer, trainer, kept)
        self.pieces = [text for text, _ in pieces]
        kinds = np.array([kind for _, kind in pieces])
        self.fallback = any(field == BYTE_FALLBACK and value for field, value, _ in fields(trainer))
        self.sizes = np.array([len(text) for text, _ in pieces])
        self.byte = np.full(len(pieces), -1)
        for place in np.flatnonzero(kinds == BYTE).tolist():
            self.byte[place] = int(self.pieces[place][1:-1], 16)
        own = [text for text, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
        #: No piece crosses the start of a word, and the word mark itself is known.
        self.by_word = self.fallback and MARK in own and not any(MARK in text.lstrip(MARK) for text in own)
        self.start = re.compile(f"(?<!{MARK}){MARK}")
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            found = self.start.search(text, at + STRETCH)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def _spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last normalised character (exclusive) of each piece. Of the bytes of one character, the
        last one holds it."""
        size, byte = self.sizes[ids], self.byte[ids]
        if (byte >= 0).any():
            follows = np.append((byte[1:] >= 0x80) & (byte[1:] < 0xC0), False)
            size = np.where(byte >= 0, np.where(follows, 0, 1), size)
        ends = np.cumsum(size)
        return ends - size, ends

    def _pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and last (exclusive) characters of the pieces of a normalised text."""
        if self.by_word:
            ids = [self.segmenter.encode(stretch, return_type="numpy") for stretch in self._stretches(text)]
            ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
            return ids, *self._spans(ids)
        answer = self.segmenter.encode(text, return_type="serialized_proto")
        ids, first, last = spans_of(answer).T
        places = _byte_places(text)
        return ids, np.searchsorted(places, first), np.searchsorted(places, last)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and last (exclusive) source bytes of a whole text, with begin and end ids around them."""
        normal, origin = self.normaliser(text)
        ids, first, last = self._pieces(normal)
        end = origin[-1:]
        return (
            np.concatenate(([self.begin], ids, [self.end])).astype("<u4"),
            np.concatenate(([0], origin[first], end)).astype("<u4"),
            np.concatenate(([0], origin[last], end)).astype("<u4"),
        )


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    """One per worker and model file."""
    with open(path, "rb") as file:
        return Encoder(file.read())


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


# --- the operators --------------------------------------------------------------------------------------


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(``key``, n_tokens, ids, first, last[, decoded]) for every row of ``docs``.

    ``ids`` are those of the SentencePiece model file ``model`` (a path every worker can open), with its begin
    and end ids; ``first`` and ``last`` (exclusive) are the bytes of the source text each piece stands for.
    All three are little-endian unsigned 32-bit numbers. ``decoded`` is the text the model makes of the ids. Of
    a character that became several byte pieces, the last piece has its bytes; signs the normaliser adds have
    an empty span at the place they were added. A null text counts as empty: begin and end only. Repeated rows
    and null keys give a row each; other columns play no part. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType(
        [rows.schema["key"], T.StructField("n_tokens", T.LongType())]
        + [T.StructField(name, T.BinaryType()) for name in ("ids", "first", "last")]
        + [T.StructField("decoded", T.StringType())] * decoded
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches_of(batches):
            at = 0
            for block in _blocks(batch.column("text").to_pylist()):
                found = [encoder.encode(text) for text in block]
                arrays = [batch.column("key").slice(at, len(block)), pa.array([len(ids) for ids, _, _ in found], pa.int64())]
                arrays += [pa.array([row[i].tobytes() for row in found], pa.binary()) for i in range(3)]
                if decoded:
                    arrays.append(pa.array([encoder.library.decode(ids.tolist()) for ids, _, _ in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
                at += len(block)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def pieces(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(``key``, place, id, piece, first, last): the rows of ``encode`` unpacked, one row per piece.

    ``place`` counts the pieces of a text from 0. Each row of ``encoded`` is unpacked by itself.
    """
    kind = encoded.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, place bigint, id bigint, piece string, first bigint, last bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(_encoder(model).pieces, object)
        for batch in batches_of(batches):
            for i in range(batch.num_rows):
                ids, first, last = (np.frombuffer(batch.column(name)[i].as_py(), "<u4").astype(np.int64) for name in ("ids", "first", "last"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(np.full(len(ids), i))), pa.array(np.arange(len(ids))), pa.array(ids),
                     pa.array(names[ids].tolist(), pa.string()), pa.array(first), pa.array(last)],
                    [key, "place", "id", "piece", "first", "last"],
                )

    return encoded.select(key, "ids", "first", "last").mapInArrow(run, schema)
