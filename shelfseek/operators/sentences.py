"""Sentence splitting that learns abbreviations, ordinals and sentence starters from the texts themselves.

Nothing but counts of types decides, by log-likelihood ratios. A type is an abbreviation if its point belongs to
it: it nearly always has one, it is short, and it seldom occurs without. Numbers are one type, so that points of
ordinals are learned alike. A single letter with a point is an initial. A type that follows the end of a sentence
far more often than chance starts sentences, and then ends one even behind an abbreviation.

Learning is two pre-aggregated counts over all texts, each made once and written; what reaches the driver are the
types that passed: few abbreviations, whose score falls with the exponent of the length, and the starters, which grow
with the vocabulary. Words are counted as they stand and typed afterwards, once for each different word. A sentence can end only behind a word with . ! or ? at
its end, so texts are cut there first and only those places are judged. Splitting is a column expression.
"""

from __future__ import annotations

import json
from collections.abc import Collection
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.functions.arrays import let
from shelfseek.functions.text import squash
from shelfseek.workspace import new_path

#: Fixed values of the published method: least score of an abbreviation, least ratio of a sentence starter, and how
#: often a point follows an abbreviation.
ABBREVIATION_FROM, STARTER_FROM, POINT_SHARE = 0.3, 30.0, 0.99
#: A type is judged from so many occurrences on.
LEAST_SEEN = 2
NUMBER = "##"
#: Signs around a word that are no part of its type, and the same as regular expressions.
OPENING_SIGNS, CLOSING_SIGNS = "\"'([{", "\"')]},;:!?"
OPENING, CLOSING = r"^[\"'(\[{]+", r"[\"')\]},;:!?]+$"
INITIAL = r"^\p{L}$"
#: How many types of a model share a bucket, about.
_PER_BUCKET = 2


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()


def words(text: Column) -> Column:
    """The words of a text between single spaces; a blank text has one empty word."""
    return F.split(F.trim(squash(text)), " ")


def clauses(text: Column) -> Column:
    """A text cut behind every word with . ! or ? at its end: the only places where a sentence may end."""
    return F.split(F.trim(squash(text)), "(?<=[.!?]) ")


def _first_word(clause: Column) -> Column:
    return F.substring_index(clause, " ", 1)


def _last_word(clause: Column) -> Column:
    return F.substring_index(clause, " ", -1)


def _opened(word: Column) -> Column:
    return F.ltrim(word, F.lit(OPENING_SIGNS))


def type_of(word: Column) -> Column:
    """A word in lower case without the signs around it and without its last point; all numbers are one type."""
    lower = F.lower(F.rtrim(_opened(word), F.lit(CLOSING_SIGNS)))

    def typed(bare: Column) -> Column:
        stem = F.when(bare.endswith("."), F.left(bare, F.length(bare) - 1)).otherwise(bare)
        return F.when(bare.rlike(r"^[0-9]+\.?$"), F.lit(NUMBER)).otherwise(stem)

    return let(lower, typed)


def _has_point(word: Column) -> Column:
    return _opened(word).endswith(".")


def _among(value: Column, types: Collection[str]) -> Column:
    """Whether a value is one of many. They lie in buckets by their CRC-32, so the plan holds one constant, not one for
    each of them, and a test compares with few."""
    buckets: list[list[str]] = [[] for _ in range(len(types) // _PER_BUCKET + 1)]
    for one in types:
        buckets[crc32(one.encode()) % len(buckets)].append(one)
    constant = F.from_json(F.lit(json.dumps(buckets)), "array<array<string>>")
    place = F.pmod(F.crc32(value.cast("binary")), F.lit(len(buckets)))
    return F.array_contains(F.get(constant, place.cast("int")), value)


def _is_capital(word: Column) -> Column:
    return _opened(word).rlike(r"^\p{Lu}")


def _logs(hits: Column, all_: Column, share: Column) -> Column:
    """Log-likelihood of ``hits`` out of ``all_`` at a share, where nothing times the log of nothing is nothing."""
    missed = all_ - hits
    yes = F.when(hits > 0, hits * F.log(F.greatest(share, F.lit(1e-300)))).otherwise(0.0)
    return yes + F.when(missed > 0, missed * F.log(F.greatest(1 - share, F.lit(1e-300)))).otherwise(0.0)


def _by_type(words_: DataFrame, **counts: Column) -> DataFrame:
    """Sums by type over a column ``word``, each different word typed once; words without a type are left out."""
    counted = words_.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    typed = counted.select(type_of(F.col("word")).alias("type"), _has_point(F.col("word")).alias("point"), "n")
    # a test of the type alone would be moved before the count, and type every single word
    typed = typed.where(F.length("type") * F.col("n") > 0)
    return typed.groupBy("type").agg(*[F.sum(count).alias(name) for name, count in counts.items()])


def type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n_point, n_plain): how often each type has a point at its end, and how often not."""
    # the outer form, see ``item_rows``; a null text gives a null word
    exploded = docs.select(F.explode_outer(words(F.col(text_col))).alias("word"))
    n, none = F.col("n"), F.lit(0)
    return _by_type(exploded, n_point=F.when(F.col("point"), n).otherwise(none), n_plain=F.when(F.col("point"), none).otherwise(n))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(type, score) of the types that occur with a point and hold a letter or are numbers."""
    totals = counts.agg(F.sum(F.col("n_point") + F.col("n_plain")).alias("n"), F.sum("n_point").alias("points"))
    n, points = totals.first()
    share = F.lit((points or 0) / max(1, n or 1))
    seen = F.col("n_point") + F.col("n_plain")
    ratio = 2 * (_logs(F.col("n_point"), seen, F.lit(POINT_SHARE)) - _logs(F.col("n_point"), seen, share))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_plain").cast("double"))
    fit = counts.where((F.col("n_point") > 0) & (seen >= LEAST_SEEN) & (F.col("type").rlike(r"\p{L}") | (F.col("type") == NUMBER)))
    return fit.select("type", score.alias("score"))


def _ends(word: Column, abbreviations: list[str]) -> Column:
    """A word that ends a sentence whatever follows: ! or ?, or a point that is no abbreviation's."""

    def closing(own: Column) -> Column:
        return ~_among(own, abbreviations) & ~own.rlike(INITIAL)

    return word.endswith("!") | word.endswith("?") | (word.endswith(".") & let(type_of(word), closing))


def first_counts(docs: DataFrame, abbreviations: list[str], text_col: str = "text") -> DataFrame:
    """(type, n_first): how often each type follows the end of a sentence."""
    def neighbours(cut: Column) -> Column:
        return F.transform(cut, lambda c, i: F.struct(_last_word(F.get(cut, i - 1)).alias("before"), _first_word(c).alias("word")))

    pairs = docs.select(F.explode_outer(let(clauses(F.col(text_col)), neighbours)).alias("pair")).select("pair.before", "pair.word")
    return _by_type(pairs.where(_ends(F.col("before"), abbreviations)), n_first=F.col("n"))


def starter_scores(first: DataFrame, counts: DataFrame) -> DataFrame:
    """(type, score) of the types that follow the end of a sentence more often than chance."""
    n, = counts.agg(F.sum(F.col("n_point") + F.col("n_plain"))).first()
    breaks, = first.agg(F.sum("n_first")).first()
    n, breaks = float(n or 1), float(breaks or 0)
    joined = first.join(counts, "type").select("type", "n_first", (F.col("n_point") + F.col("n_plain")).alias("seen"))
    others, rest = F.col("seen") - F.col("n_first"), F.lit(max(1.0, n - breaks))
    share, after, elsewhere = F.col("seen") / n, F.col("n_first") / F.lit(max(1.0, breaks)), others / rest
    ratio = 2 * (
        _logs(F.col("n_first"), F.lit(breaks), after) + _logs(others, rest, elsewhere)
        - _logs(F.col("n_first"), F.lit(breaks), share) - _logs(others, rest, share)
    )
    return joined.where(after > share).select("type", ratio.alias("score"))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learn(docs: DataFrame, text_col: str = "text") -> SentenceModel:
    """Abbreviations and sentence starters of all texts. Null and blank texts say nothing."""
    counts = _written(type_counts(docs, text_col), "types")
    found = abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION_FROM).select("type").collect()
    abbreviations = sorted(row["type"] for row in found)
    first = _written(first_counts(docs, abbreviations, text_col), "firsts")
    starters = starter_scores(first, counts).where(F.col("score") >= STARTER_FROM)
    starters = starters.where(F.col("type").rlike(r"^\p{L}")).select("type").collect()
    return SentenceModel(tuple(abbreviations), tuple(sorted(row["type"] for row in starters)))


def split_sentences(text: Column, model: SentenceModel) -> Column:
    """The sentences of a text, words one space apart; null for null, none for blank.

    A sentence ends after ! or ?, and after a point that belongs to no abbreviation, initial or learned ordinal;
    behind one of those it ends if the next word has a capital and starts sentences.
    """
    abbreviations, starters = list(model.abbreviations), list(model.starters)

    def marked(cut: Column) -> Column:
        def close(clause: Column, i: Column) -> Column:
            following = F.get(cut, i + 1)
            ends = let(_last_word(clause), lambda word: closes(word, following))
            return F.concat(clause, F.when(following.isNull(), "").when(ends, "\u0001").otherwise(" "))

        return F.array_join(F.transform(cut, close), "")

    def closes(word: Column, following: Column) -> Column:
        ends = _ends(word, abbreviations)
        if not starters:
            return ends
        opens = let(_first_word(following), lambda after: _is_capital(after) & let(type_of(after), lambda own: _among(own, starters)))
        return ends | (word.endswith(".") & F.coalesce(opens, F.lit(False)))

    return F.filter(F.split(let(clauses(text), marked), "\u0001"), lambda s: s != "")
