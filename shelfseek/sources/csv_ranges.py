"""One large CSV file read by many tasks, multi-line cells included.

Spark cuts a file into byte ranges at line feeds. Whether a range starts inside a quoted cell is told by the
parity of all quotes before it: a first pass counts quotes per range, a running sum over the ranges of a file
gives every range its parity. A second pass lets each task close its records; what is cut by the end of a
range is put together from the pieces of both sides. Records are written once and parsed by ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.functions.text import has_text
from shelfseek.sources.scan import MAX_BROADCAST_FILES, NO_VALUE
from shelfseek.workspace import new_path

RECORD = "file string, start bigint, seq bigint, piece int, text string"
#: What a written row is: a whole record, the beginning of one, a part that does not begin it.
WHOLE, BEGIN, MORE = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    at = [F.col(f"_metadata.{name}") for name in ("file_path", "file_block_start")]
    return lines.select(at[0].alias("file"), at[1].alias("start"), "value")


def _range_parities(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether a byte range starts inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))


def _close_records(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of every byte range, without empty lines; the lines of a range come one after the other."""
    place, held, seq, first = None, [], 0, WHOLE

    def row(piece: int) -> pa.RecordBatch:
        columns = [[place[0]], [place[1]], [seq], [piece], ["\n".join(held)]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "seq", "piece", "text"]
        )

    for batch in frame:
        if not batch.num_rows:
            continue
        starts = np.asarray(batch.column("start"))
        files = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
        turns = np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1
        for cut, end in zip([0, *turns], [*turns, len(starts)], strict=True):
            part = batch.slice(cut, end - cut)
            own = (part.column("file")[0].as_py(), int(starts[cut]))
            if own != place:
                if held:
                    yield row(first or BEGIN)
                place, held, seq = own, [], 0
                first = MORE if part.column("inside")[0].as_py() else WHOLE
                open_now = int(first == MORE)
            else:
                open_now = int(bool(held) or first == MORE)
            text = part.column("value")
            inside = (open_now + np.cumsum(np.asarray(pc.count_substring(text, '"')))) % 2
            ends = np.flatnonzero(inside == 0) + 1
            begun = 0
            if (held or first == MORE) and len(ends):
                held += text[: ends[0]].to_pylist()
                yield row(first)
                seq += first == WHOLE
                begun, ends, held, first = int(ends[0]), ends[1:], [], WHOLE
            if len(ends):
                offsets = pa.array(np.r_[begun, ends], pa.int32())
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, text), "\n")
                records = records.filter(pc.invert(pc.is_in(records, pa.array(["", "\r"]))))
                n = len(records)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[0]] * n), pa.array(np.full(n, own[1])), pa.array(np.arange(seq, seq + n)),
                        pa.array(np.full(n, WHOLE, np.int32)), records,
                    ],
                    ["file", "start", "seq", "piece", "text"],
                )
                seq += n
                begun = int(ends[-1])
            held += text[begun:].to_pylist()
    if held:
        yield row(first or BEGIN)


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(file, start, seq, text): whole records, numbered in the byte range where they begin; whether ranges are few."""
    lines = _lines(spark, path)
    parities = _range_parities(lines)
    inside = parities.where("inside")
    # One row per byte range; the driver lists all ranges for the scan anyway.
    few = parities.count() <= MAX_BROADCAST_FILES
    if few:
        marked = lines.join(F.broadcast(inside), ["file", "start"], "left")
    else:
        ordered = lines.withColumn("nth", F.monotonically_increasing_id()).join(inside, ["file", "start"], "left")
        marked = ordered.repartition("file", "start").sortWithinPartitions("file", "start", "nth")
    marked = marked.select("file", "start", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces_at = new_path(spark, "csv-records")
    marked.mapInArrow(_close_records, RECORD).write.parquet(pieces_at)
    rows = spark.read.schema(RECORD).parquet(pieces_at)
    # The few cut records: their keys are numbered without the texts, which are joined to them afterwards.
    begins = F.sum((F.col("piece") == BEGIN).cast("int"))
    order = Window.partitionBy("file").orderBy("start", F.desc("piece"))
    keys = rows.where(F.col("piece") != WHOLE).select("file", "start", "piece").withColumn("record", begins.over(order))
    cut = rows.where(F.col("piece") != WHOLE).join(keys, ["file", "start", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    joined = cut.groupBy("file", "record").agg(
        F.min_by(F.struct("start", "seq"), "start").alias("at"),
        F.array_join(F.transform(parts, lambda part: part["text"]), "\n").alias("text"),
    )
    whole = rows.where(F.col("piece") == WHOLE).select("file", "start", "seq", "text")
    return whole.unionByName(joined.select("file", "at.start", "at.seq", "text")), few


def split_csv_rows(spark: SparkSession, path: str, schema: T.StructType, row_col: str = "row_number") -> DataFrame:
    """The rows of ``csv_rows``, each file read by as many tasks as it has byte ranges.

    Files have a header and UTF-8 text; cells with quotes, commas or line breaks are quoted and a quote in them is
    doubled. A quote inside a cell that is not quoted shifts the parity of all that follows: such files are for
    ``csv_rows``. Lines end with LF or CR LF; where a file's header ends with CR LF, line breaks inside quotes become
    LF too. Empty lines are no rows. A quote that is never closed makes one record of the rest of its file, in one
    task, as in any reader.
    """
    records, few = _records(spark, path)
    found = records.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before_file = Window.orderBy(F.regexp_extract("file", "[^/]*$", 0), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = found.groupBy("file").agg((F.sum("n") - 1).alias("rows"))
    headers = records.where("start = 0 and seq = 0").select("file", F.endswith("text", F.lit("\r")).alias("crlf"))
    files = files.join(headers, "file", "left").select(
        "file", "crlf", F.coalesce(F.sum("rows").over(before_file), F.lit(0)).alias("earlier")
    )
    ranges = found.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(files, "file")
    numbered = records.join(F.broadcast(ranges) if few else ranges, ["file", "start"])
    numbered = numbered.withColumn("place", F.col("before") + F.col("seq") - 1).where("place >= 0")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    text = F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    row = F.from_csv(F.regexp_replace(text, r"\r\z", ""), schema.simpleString()[len("struct<") : -1].replace(":", " "), options)
    parsed = numbered.select((F.col("earlier") + F.col("place")).alias(row_col), row.alias("row"))
    cells = [F.when(~F.col(f"row.{c}").isin(NO_VALUE), F.col(f"row.{c}")).alias(c) for c in schema.names]
    return parsed.select(row_col, *cells)


def split_csv_descriptions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(product_id, text): the described rows, numbered by their position among all rows."""
    rows = split_csv_rows(spark, path, schema, "product_id")
    return rows.where(has_text(F.col("description"))).select("product_id", F.col("description").alias("text"))
