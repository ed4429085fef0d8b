from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Build a table of documents from (doc_id, text[, lang, source]) rows, with columns named like results."""

    def build(rows, extra=True):
        full = [(*row, *("en", "src1")[len(row) - 2 :], len(row[1] or "")) for row in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        if extra:
            for name in ("h", "score", "lost", "n_lines", "fp", "component_id", "class", "rest", "sequence_id", "epoch", "domain"):
                frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return build


LONG = " ".join(f"word{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and very long texts, repeated rows, a null key and null columns."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (5, "a"), (None, "a"), (6, "a line that is shared\nown line of six"),
        (7, "A line that is SHARED \nown line of seven"), (8, "tie"), (9, "tie"), (10, "x", None, None),
    ]
