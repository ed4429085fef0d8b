"""Quality by regularised quadratic discriminant analysis over statistics of a text.

Each text becomes a short vector of transformed statistics (shares of kinds of characters, lengths and
repetition of words and lines). Every class gets a mean and a covariance that is shrunk towards the pooled
covariance and its diagonal. The score compares the two log densities; each is a Mahalanobis length through
a Cholesky factor that is computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of, summed, text_bytes, written

#: Weights of a class's own covariance, of the pooled one, and of the pooled variances alone.
OWN, POOLED, DIAGONAL = 0.8, 0.15, 0.05
#: Variance added to every statistic, in units of its pooled variance.
RIDGE = 1e-3
#: The log density difference is divided by this before it becomes a probability: the statistics are
#: neither independent nor normal, and the raw difference is far too sure.
TEMPERATURE = 4.0
#: The difference counts up to this, so that scores keep their order near 0 and 1.
FARTHEST = 120.0

_KINDS = ("upper", "lower", "digit", "space", "mark", "sign", "other")


def _kind_of_bytes() -> np.ndarray:
    kinds = np.full(256, _KINDS.index("sign"), np.int64)
    for byte in range(256):
        sign = chr(byte)
        if byte >= 128:
            kinds[byte] = _KINDS.index("other")
        elif sign.isupper():
            kinds[byte] = _KINDS.index("upper")
        elif sign.islower():
            kinds[byte] = _KINDS.index("lower")
        elif sign.isdigit():
            kinds[byte] = _KINDS.index("digit")
        elif sign in "\t\n\v\f\r ":
            kinds[byte] = _KINDS.index("space")
        elif sign in ".,;:'\"-()?":
            kinds[byte] = _KINDS.index("mark")
    return kinds


_KIND = _kind_of_bytes()
STATISTICS = 18


def _angle(share: float) -> float:
    """The variance-stabilising transform of a share."""
    return float(np.arcsin(np.sqrt(min(1.0, max(0.0, share)))))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text; of an empty one, those of no characters and words."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=len(_KINDS)) / max(size, 1)
    shares = counts[counts > 0] / max(size, 1)
    words = text.split()
    n = len(words)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    odd_tail = sum(count for word, count in seen.items() if not (word[-1:].isalnum() or word[-1] >= 128 or word[-1] in b".,"))
    lone = sum(count for word, count in seen.items() if not any(map(bytes.isalnum, (word[:1], word[-1:]))) and word[0] < 128)
    upper = sum(count for word, count in seen.items() if word.isupper() and len(word) > 1)
    common = max(seen.values(), default=0)
    return [
        float(np.log1p(size)), float(np.log1p(n)), *(_angle(kinds[_KINDS.index(k)]) for k in ("upper", "digit", "space", "mark", "sign", "other")),
        float(-(shares * np.log(shares)).sum()), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        _angle(len(seen) / n if n else 0.0), _angle(repeated / n if n else 0.0), _angle(common / n if n else 0.0),
        _angle(odd_tail / n if n else 0.0), _angle(lone / n if n else 0.0), _angle(upper / n if n else 0.0),
        float(np.log1p(size / len(lines))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row of ``docs``."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            found = pa.array([statistics(text) for text in text_bytes(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "x"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


@dataclass
class Discriminant:
    """Two normal densities over the statistics; class 1 is the good one."""

    means: np.ndarray
    factors: list[np.ndarray]
    log_sizes: np.ndarray
    offset: float

    @classmethod
    def of_moments(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant | None:
        """From each class's rows, sums and sums of outer products. None if a class has no row."""
        if n.min() < 1:
            return None
        means = sums / n[:, None]
        scatter = squares - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        variances = np.diag(np.diag(pooled) + 1e-9)
        factors = []
        for own, rows in zip(scatter, n, strict=True):
            trust = OWN * rows / (rows + STATISTICS)
            rest = (1 - trust) / (POOLED + DIAGONAL)
            shrunk = trust * own / rows + rest * (POOLED * pooled + DIAGONAL * variances) + RIDGE * variances
            factors.append(np.linalg.cholesky(shrunk))
        sizes = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
        return cls(means, factors, sizes, float(np.log(n[1] / n[0])))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log of how much likelier class 1 is than class 0, for each row."""
        halves = []
        for mean, factor, size in zip(self.means, self.factors, self.log_sizes, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            halves.append(-0.5 * ((z**2).sum(0) + size))
        return halves[1] - halves[0] + self.offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        gap = self.difference(x) / TEMPERATURE
        return 1.0 / (1.0 + np.exp(-FARTHEST * np.tanh(gap / FARTHEST)))


def fit(labelled: DataFrame) -> Discriminant | None:
    """From rows (x, label) with label 0 or 1; all rows count, only sums of fixed size reach the driver."""
    width = 1 + STATISTICS + STATISTICS**2

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width))
        for batch in batches_of(frame):
            x, label = _matrix(batch.column("x")), np.asarray(batch.column("label"))
            for value in (0, 1):
                own = x[label == value]
                sums[value] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()])], ["part"])

    values = np.array(summed(labelled.select("x", "label").mapInArrow(run, "part array<double>")))
    if not len(values):
        return None
    values = values.reshape(2, width)
    squares = values[:, 1 + STATISTICS :].reshape(2, STATISTICS, STATISTICS)
    return Discriminant.of_moments(values[:, 0], values[:, 1 : 1 + STATISTICS], squares)


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text): the probability of label 1.

    ``labels`` has (doc_id, label); rows with another label than 0 or 1 or without a doc_id teach nothing,
    and a condition ``learn_from`` on doc_id can leave out more. A doc_id labelled twice counts twice. A null
    or empty text is scored like any other, by its statistics. If a class has no labelled row, nothing can be
    compared: every score is then 0.5. Statistics are computed once per row and written.
    """
    rows = written(document_statistics(docs), "quality-statistics")
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    usable = usable.where("label in (0, 1) and doc_id is not null")
    if learn_from is not None:
        usable = usable.where(learn_from)
    model = fit(rows.join(usable, "doc_id"))

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            x = _matrix(batch.column("x"))
            scores = np.full(len(x), 0.5) if model is None else model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id bigint, score double")
