"""Toxicity of documents written through a noisy channel.

Writers hide words by leetspeak, by spacing letters out and by repeating them. A token, or a run of spaced
characters, that may have gone through this channel becomes a lattice: each place holds the letters it may stand
for, with the channel's cost, or stays as it is; a gap of a run joins letters or parts words. The path that a character trigram model finds most likely (Viterbi) is the
restored token. Tokens without such places have a single path and are their own restoration.

The character model counts all texts. Restored words are then scored against a lexicon of words and word
beginnings that mark toxic documents, with a margin for chance; a logistic model turns the strongest
evidence of a document into a probability. The logistic model is fitted on evidence that each half of the
fitting rows gets from a lexicon of the other half, so it does not see the lexicon's own errors; the lexicon
that scores is learned from all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of, written

#: Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "&": "a",
}
#: What the channel does: a letter is written as a sign, a sign is meant, a sign is noise (rarely so if it
#: stands for a letter), a repeated sign stands for one, for two.
SUBSTITUTED, KEPT, DROPPED, NOISE, SINGLE, DOUBLE = np.log([0.6, 0.1, 0.02, 0.2, 0.6, 0.4]).tolist()
#: What signs at the ends of a token are besides letters: punctuation, or a noise tail of three and more. In a token
#: without letters a digit or sign that means itself is one of ten.
EDGE, TAIL, DIGIT = np.log([0.5, 0.9, 0.1]).tolist()
#: What a gap between spaced characters does: it joins them, it parts two words; a gap wider than others does either.
JOINED, PARTED, EITHER = np.log([0.9, 0.1, 0.5]).tolist()
#: Most labelled rows that the lexicon and the logistic model are fitted on, taken by hash of doc_id.
FIT_ROWS = 30_000
#: Most entries of the lexicon; the strongest stay.
LEXICON = 20_000
#: Standard deviations by which a word's log odds must exceed zero.
MARGIN = 2.0
PREFIXES = range(3, 8)
FEATURES = 5
_SYMBOLS = 64
_REMEMBERED = 600_000
_BLOCK = 1 << 18

#: Signs that may stand for letters, and signs that say nothing at the ends of a token unless they do.
_LEET_SIGNS = "".join(sign for sign in LEET if not sign.isdigit())
_EDGES = "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~¡¿«»…–—“”„‘’"
_MUTE_SIGNS = "".join(sign for sign in _EDGES if sign not in LEET)
_MUTE = re.escape(_MUTE_SIGNS)
_END_SIGNS = _MUTE_SIGNS + _LEET_SIGNS
_ENDS = re.escape(_END_SIGNS)
_BEFORE = re.compile(rf"[{_ENDS}]*[{_MUTE}]")
_AFTER = re.compile(rf"[{_MUTE}][{_ENDS}]*\Z")
_SIGN_TAIL = re.compile(r"\${2,}$")
_TRIPLE = re.compile(r"(.)\1\1")
_RUNS = re.compile(r"(.)\1*", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")
#: A run of at least three single characters: letters, digits or signs that may stand for letters, with a gap of
#: white space or signs between each two. A line break ends it, and so does a token of more characters.
_SPACE = r"[^\S\n]"
_ONE = r"(?:[^\W_]|[@$!|+(*#&])"
_GAP = rf"(?:{_SPACE}+(?:[.\-_]{_SPACE}*)?|[.\-_*]{_SPACE}*)"
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_][^\w\s]){_ONE}(?:{_GAP}{_ONE}){{2,}}(?![^\W_])")
_MAYBE_SPACED = re.compile(r"[ \t.\-_*\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
                           rf"{_ONE}{_GAP}{_ONE}(?![^\W_])")
_PIECES = re.compile(rf"({_ONE})({_GAP}|$)")


# --- the character model --------------------------------------------------------------------------------


def _codes() -> np.ndarray:
    """Symbol of a code point: 0 for what is no letter, 1-26 for a-z, 27-63 shared by other letters."""
    codes = np.zeros(0x3000, np.uint8)
    for point in range(0x3000):
        if chr(point).isalpha():
            codes[point] = point - 96 if 97 <= point <= 122 else 27 + point % 37
    return codes


_CODES = _codes()


def _symbols(text: str) -> np.ndarray:
    if text.isascii():
        return _CODES[np.frombuffer(text.encode("ascii"), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    symbols = _CODES.take(points, mode="clip")
    high = np.flatnonzero(points >= len(_CODES))
    if len(high):
        symbols[high] = 27 + points[high] % 37
    return symbols


def _count(text: str, counts: np.ndarray) -> None:
    for cut in range(0, len(text), _BLOCK):
        s = _symbols(f"  {text}  "[cut : cut + _BLOCK + 2])
        grams = s[:-2].astype(np.int64)
        for place in (s[1:-1], s[2:]):
            grams <<= 6
            grams |= place
        counts += np.bincount(grams, minlength=len(counts))


def character_counts(texts: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts. At most 64**3 sums reach the driver."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches_of(frame):
            held = {True: [], False: []}
            sizes = {True: 0, False: 0}
            for text in batch.column("text").to_pylist():
                kind = (text or "").isascii()
                held[kind].append((text or "").lower())
                sizes[kind] += len(held[kind][-1])
                if sizes[kind] > _BLOCK:
                    _count("  ".join(held[kind]), counts)
                    held[kind], sizes[kind] = [], 0
            for texts_held in held.values():
                _count("  ".join(texts_held), counts)
        grams = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts[grams])], ["gram", "n"])

    parts = texts.select("text").mapInArrow(run, "gram bigint, n bigint")
    sums = parts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SYMBOLS**3, np.int64)
    counts[np.asarray(sums.column("gram"))] = np.asarray(sums.column("n"))
    return counts


@dataclass
class CharacterModel:
    """Interpolated trigram log probabilities: ``log_p[a, b, c]`` is that of c after a, b."""

    log_p: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> CharacterModel:
        three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))

        def shares(n: np.ndarray) -> np.ndarray:
            total = n.sum(-1, keepdims=True)
            return np.divide(n, total, out=np.zeros_like(n), where=total > 0)

        mixed = 0.7 * shares(three) + 0.24 * shares(two)[None] + 0.05 * shares(one)[None, None] + 0.01 / _SYMBOLS
        return cls(np.log(mixed).astype(np.float32))


# --- the channel and its decoder ------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every run of one character: what it may stand for, with the channel's log probability.

    Emissions are letters, a character that stays and breaks the word, or nothing. Signs at the ends are noise or
    letters; in a token without letters, digits that stay are those of a number.
    """
    runs = [(run.start(), run.end(), run.group(1)) for run in _RUNS.finditer(token)]
    number = len(runs) > 1 and not any(map(str.isalpha, token))
    begin, end = len(token) - len(token.lstrip(_LEET_SIGNS)), len(token.rstrip(_LEET_SIGNS))
    return [_place(sign, to - at, at < begin or to > end, number) for at, to, sign in runs]


def _place(sign: str, length: int, edge: bool = False, number: bool = False) -> list[tuple[str, float]]:
    """The options of ``length`` times one character: at an end of its token, in a token without letters."""
    if sign.isalpha():
        return [(sign * length, 0.0)] if length < 3 else [(sign, SINGLE), (sign * 2, DOUBLE)]
    if edge:
        options = [("", TAIL if length > 2 else length * (DIGIT if number else EDGE))]
    else:
        options = [(sign * length, length * DIGIT if number else KEPT)]
    for letter in LEET.get(sign, ""):
        share = SUBSTITUTED - np.log(len(LEET[sign]))
        options.append((letter, share + (0.0 if length == 1 else SINGLE)))
        if length > 1:
            options.append((letter * 2, share + DOUBLE))
    if not (edge or sign.isalnum()):
        options.append(("", DROPPED if sign in LEET else NOISE))
    return options


def _gap(gap: str, narrowest: int) -> list[tuple[str, float]]:
    """A gap of a spaced run: nothing, a word break, or the vowels that a bare ``*`` hides."""
    if len(gap) > narrowest:
        return [("", EITHER), (" ", EITHER)]
    hidden = SUBSTITUTED - np.log(len(LEET["*"]))
    return [("", JOINED), (" ", PARTED), *((vowel, hidden) for vowel in LEET["*"] if gap[0] == "*")]


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The places of a run of spaced characters: what every character may stand for, and what every gap does."""
    pieces = _PIECES.findall(run)
    narrowest = min(len(gap) for _, gap in pieces[:-1])
    places = []
    for sign, gap in pieces:
        places.append(_place(sign, 1))
        if gap:
            places.append(_gap(gap, narrowest))
    return places


def _core(token: str) -> str:
    core = token.strip(_EDGES)
    return _SIGN_TAIL.sub("", core) if core[-1:] == "$" else core


def _written(token: str) -> str:
    """A token between the mute signs at its ends and what lies beyond them; the signs left may stand for letters."""
    begin = _BEFORE.match(token)
    inner = token[begin.end() :] if begin else token
    end = _AFTER.search(inner, len(inner.rstrip(_END_SIGNS)))
    return inner[: end.start()] if end else inner


class Decoder:
    def __init__(self, model: CharacterModel):
        self.log_p = model.log_p
        self.known: dict[str, int] = {}

    def _symbol(self, sign: str) -> int:
        found = self.known.get(sign)
        if found is None:
            found = self.known[sign] = int(_symbols(sign)[0]) if sign.isalpha() else 0
        return found

    def _best(self, places: list[list[tuple[str, float]]]) -> str:
        """The most likely path (Viterbi; ties go to the first option). Paths are linked back, so time is linear."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in places:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for letters, cost in options:
                    x, y, total = a, b, score + cost
                    for sign in letters:
                        z = self._symbol(sign)
                        if z or y:
                            total += float(self.log_p[x, y, z])
                        x, y = y, z
                    old = after.get((x, y))
                    if old is None or total > old[0]:
                        after[x, y] = (total, (path, letters))
            states = after
        ends = [(score + (float(self.log_p[a, b, 0]) if b else 0.0), path) for (a, b), (score, path) in states.items()]
        path, parts = max(ends, key=lambda end: end[0])[1], []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))

    def decode(self, token: str) -> str:
        """The most likely restored form of a lower-cased token."""
        return self._best(lattice(token))

    def decode_spaced(self, run: str) -> str:
        """The most likely words of a lower-cased run of spaced characters; digits and signs alone stay as they are."""
        return self._best(spaced_lattice(run)) if any(map(str.isalpha, run)) else run

    def restored(self, token: str) -> str:
        """A lower-cased token as it was meant, decoded where it is ambiguous; its ends may be noise or letters."""
        core = token.strip(_MUTE_SIGNS)
        if not core.isalpha():
            core = _written(token)
        if core.isalpha() and not _TRIPLE.search(core):
            return core
        meant = self.decode(core)
        return meant if any(map(str.isalpha, meant)) else _core(token)

    def spaced(self, text: str) -> list[str]:
        """The words of every run of single characters, as in "s t u p i d". ``text`` starts with a space."""
        if not _MAYBE_SPACED.search(text):
            return []
        return [self.decode_spaced(run) for run in _SPACED.findall(text)]

    def restore_text(self, text: str) -> str:
        """A whole text, lower-cased, with every token and every spaced word in its restored form."""
        joined = _SPACED.sub(lambda run: self.decode_spaced(run.group(0)), f" {text.lower()}")
        return " ".join(filter(None, map(self.restored, joined.split())))


# --- evidence -------------------------------------------------------------------------------------------


def word_features(word: str) -> list[str]:
    """A word and its beginnings, as lexicon entries."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def _tokens(text: str) -> tuple[str, set[str]]:
    lowered = f" {text.lower()}"
    return lowered, set(lowered.split())


def _words(decoder: Decoder, text: str, known: dict[str, tuple[str, ...]]) -> set[str]:
    lowered, tokens = _tokens(text)
    words: set[str] = set()
    for token in tokens:
        found = known.get(token)
        if found is None:
            if len(known) >= _REMEMBERED:
                known.clear()
            found = known[token] = tuple(_LETTERS.findall(decoder.restored(token)))
        words.update(found)
    for run in decoder.spaced(lowered):
        words.update(_LETTERS.findall(run))
    return words


def learn_lexicons(rows: DataFrame, model: CharacterModel) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Weights of features from ``rows`` (text, label, half): from all rows, and from each half.

    A weight is the log odds of the feature in toxic against clean documents, less ``MARGIN`` standard
    deviations, so that a word seen in few documents needs a clear case.
    """

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(model), {}
        counts = {(half, label): Counter() for half in (0, 1) for label in (0, 1)}
        for batch in batches_of(frame):
            columns = [batch.column(name).to_pylist() for name in ("text", "label", "half")]
            for text, label, half in zip(*columns, strict=True):
                words = _words(decoder, text or "", known)
                own = counts[half, label]
                own.update({feature for word in words for feature in word_features(word)})
                own[""] += 1
        for half in (0, 1):
            clean, toxic = counts[half, 0], counts[half, 1]
            names = list(clean.keys() | toxic.keys())
            for cut in range(0, len(names), 50_000):
                some = names[cut : cut + 50_000]
                columns = [pa.array(some, pa.string()), pa.array(np.full(len(some), half, np.int32))]
                columns += [pa.array([c[n] for n in some], pa.int64()) for c in (clean, toxic)]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "half", "n_clean", "n_toxic"])

    parts = rows.mapInArrow(run, "feature string, half int, n_clean bigint, n_toxic bigint")
    sums = parts.groupBy("feature").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("half") == half, F.col(column))), F.lit(0)).alias(f"{name}{half}")
            for half in (0, 1)
            for column, name in (("n_clean", "clean"), ("n_toxic", "toxic"))
        ]
    )
    sums = written(sums.where("toxic0 + toxic1 >= 3 or feature = ''"), "toxicity-features")
    return (
        _strongest(sums, F.col("clean0") + F.col("clean1"), F.col("toxic0") + F.col("toxic1")),
        [_strongest(sums, F.col(f"clean{half}"), F.col(f"toxic{half}")) for half in (0, 1)],
    )


def _strongest(sums: DataFrame, n_clean: Column, n_toxic: Column) -> dict[str, float]:
    """At most ``LEXICON`` features of positive weight; none if a class has no row."""
    sums = sums.select("feature", n_clean.alias("n0"), n_toxic.alias("n1"))
    totals = sums.where("feature = ''").first()
    if totals is None or not (totals["n0"] and totals["n1"]):
        return {}
    odds = F.log((F.col("n1") + 0.5) / (totals["n1"] + 1)) - F.log((F.col("n0") + 0.5) / (totals["n0"] + 1))
    weight = odds - MARGIN * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    weighed = sums.where("feature <> ''").select("feature", weight.alias("weight")).where("weight > 0")
    return {row["feature"]: row["weight"] for row in weighed.orderBy(F.desc("weight"), "feature").limit(LEXICON).collect()}


class Evidence:
    """The evidence of one text after another. Tokens that say nothing are remembered."""

    def __init__(self, model: CharacterModel, lexicon: dict[str, float]):
        self.decoder = Decoder(model)
        self.whole = {f[1:]: w for f, w in lexicon.items() if f[0] == "="}
        self.begins = {f[1:]: w for f, w in lexicon.items() if f[0] == "^"}
        self.plain: set[str] = set()

    def _word(self, word: str) -> float:
        best = self.whole.get(word, 0.0)
        for n in PREFIXES:
            found = self.begins.get(word[:n])
            if found is not None and found > best and len(word) >= n:
                best = found
        return best

    def _weight(self, restored: str) -> float:
        if restored.isalpha():
            return self._word(restored)
        return max(map(self._word, _LETTERS.findall(restored)), default=0.0)

    def of(self, text: str) -> tuple[list[float], int]:
        """The strongest three weights, the number of weighted words and of words; and restored tokens."""
        lowered, tokens = _tokens(text)
        weights, changed = [], 0
        for token in tokens - self.plain:
            restored = self.decoder.restored(token)
            weight = self._weight(restored)
            if weight:
                weights.append(weight)
            if restored != _core(token):
                changed += 1
            elif not weight:
                self.plain.add(token)
        if len(self.plain) >= _REMEMBERED:
            self.plain.clear()
        runs = self.decoder.spaced(lowered)
        weights += filter(None, map(self._word, _LETTERS.findall(" ".join(runs))))
        weights.sort(reverse=True)
        top = (weights + [0.0, 0.0, 0.0])[:3]
        return [*top, float(np.log1p(len(weights))), float(np.log1p(len(tokens)))], len(runs) + changed


# --- the logistic model ---------------------------------------------------------------------------------


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((rows - self.mean) / self.scale) @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Logistic:
    """Newton's method with a ridge. Without rows the probability is 0, with one class it is near that class."""
    if not len(rows):
        return Logistic(np.zeros(FEATURES), np.ones(FEATURES), np.array([-500.0] + [0.0] * FEATURES))
    mean, scale = rows.mean(0), np.where(rows.std(0) > 0, rows.std(0), 1.0)
    x = np.concatenate([np.ones((len(rows), 1)), (rows - mean) / scale], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


# --- the operator ---------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _fitting_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, label, half) of at most ``fit_rows`` labelled rows; only their narrow labels are broadcast."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    marked = chosen.select(F.col("doc_id").alias("_id"), "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half"))
    return docs.join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).select("text", "label", "half")


@dataclass
class ToxicityModel:
    characters: CharacterModel
    lexicon: dict[str, float]
    logistic: Logistic


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label: 0 or 1; null labels are ignored).

    The character model counts every text of ``docs``. Lexicon and logistic model see at most ``fit_rows``
    labelled rows.
    """
    texts = _texts(docs)
    characters = CharacterModel.of_counts(character_counts(texts))
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    rows = _fitting_rows(texts, usable.where("label in (0, 1) and doc_id is not null"), fit_rows)
    lexicon, halves = learn_lexicons(rows, characters)

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(characters, other) for other in halves]
        for batch in batches_of(frame):
            texts, half = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            found = [evidence[1 - h].of(text or "")[0] for text, h in zip(texts, half, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found)], ["label", "x"])

    seen = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, FEATURES)
    order = np.lexsort([*x.T, np.asarray(seen.column("label"))])
    return ToxicityModel(characters, lexicon, fit_logistic(x[order], np.asarray(seen.column("label"), float)[order]))


def score(docs: DataFrame, model: ToxicityModel, columns: list[str] | None = None, restore: bool = False) -> DataFrame:
    """(doc_id, score, n_restored[, restored][, text, rest]) for every row of ``docs``.

    ``score`` is the probability of the toxic label, from the text alone; null and empty texts get that of a
    text without evidence. ``restored`` is the whole decoded text. ``columns`` are handed through, as the
    struct ``rest``, next to the text.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 64**3 numbers, at most LEXICON entries, 11 weights

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        evidence = Evidence(fitted.characters, fitted.lexicon)
        for batch in batches_of(frame):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            found = [evidence.of(text) for text in texts]
            scores = fitted.logistic.probability(np.array([x for x, _ in found]))
            arrays = [batch.column("doc_id"), pa.array(scores), pa.array([n for _, n in found], pa.int64())]
            names = ["doc_id", "score", "n_restored"]
            if restore:
                arrays.append(pa.array([evidence.decoder.restore_text(text) for text in texts], pa.string()))
                names.append("restored")
            if columns is not None:
                arrays += [batch.column("text"), batch.column("rest")]
                names += ["text", "rest"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, score double, n_restored bigint" + ", restored string" * restore
    rows = _texts(docs)
    if columns is not None:
        rest = F.struct(*columns) if columns else F.struct(F.lit(0).alias("_"))
        rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))], rest.alias("rest"))
        schema += f", text string, rest {rows.schema['rest'].dataType.simpleString()}"
    return rows.mapInArrow(run, schema)
