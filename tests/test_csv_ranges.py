"""A file read in byte ranges gives the rows and positions of the reader that takes it whole."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from shelfseek.sources import scan
from shelfseek.sources.csv_ranges import _lines, split_csv_rows

SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("key", "title", "description")])


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _write(path, rows, line_end):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerow(SCHEMA.names)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def _made(draw, n, break_):
    parts = ["plain", 'a "word"', break_, ",", "é漢", " ", "x" * 150, break_ * 2, '"', "", "NaN", '""', f'"{break_}"']
    return [
        [str(i), "".join(draw.choice(parts) for _ in range(draw.randrange(4))), "".join(draw.choice(parts) for _ in range(draw.randrange(6)))]
        for i in range(n)
    ]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("line_end", "seed"), [("\n", 1), ("\n", 2), ("\r\n", 3)])
def test_ranges_equal_the_whole_reader(small_ranges, tmp_path, line_end, seed):
    spark, draw = small_ranges, random.Random(seed)
    folder = tmp_path / "files"
    folder.mkdir()
    for name, n in (("b", 50), ("a", 15), ("c", 0), ("d", 1)):
        _write(folder / f"{name}.csv", _made(draw, n, line_end), line_end)
    found = _rows(split_csv_rows(spark, str(folder), SCHEMA))
    assert found == _rows(scan.csv_rows(spark, str(folder), SCHEMA))
    assert sorted(r[0] for r in found) == list(range(66))


def test_a_record_over_many_ranges_and_empty_lines(small_ranges, tmp_path):
    path = tmp_path / "one.csv"
    long = "\n".join(f'line {i} with a ""quote""' for i in range(200))
    path.write_text(f'key,title,description\n1,a,b\n\n\n2,"{long}",d\n\n3,,\n"4","x\n\n",y')
    found = _rows(split_csv_rows(small_ranges, str(path), SCHEMA))
    assert found == _rows(scan.csv_rows(small_ranges, str(path), SCHEMA))
    assert found[1] == (1, "2", long.replace('""', '"'), "d") and len(found) == 4


def test_one_file_is_read_by_many_tasks(small_ranges, tmp_path):
    path = tmp_path / "one.csv"
    _write(path, _made(random.Random(9), 100, "\n"), "\n")
    assert _lines(small_ranges, str(path)).rdd.getNumPartitions() > 8
    assert scan.csv_scan(small_ranges, str(path), SCHEMA).rdd.getNumPartitions() == 1


def test_files_without_rows(small_ranges, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text("")
    (folder / "b.csv").write_text("key,title,description")
    assert _rows(split_csv_rows(small_ranges, str(folder), SCHEMA)) == []
