"""Run registered queries next to their SQL and compare the rows.

``python tests/oracle.py [sf_dir] [name …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, (list, dict)):
        return repr(value)
    return value


def _rows(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, connection, sql: str) -> tuple[int, str]:
    """(row count, '' or what differs)."""
    names, rows = _rows(df.columns, df.collect())
    cursor = connection.execute(sql)
    sql_names, sql_rows = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != sql_names:
        return sum(rows.values()), f"columns {names} / {sql_names}"
    if rows != sql_rows:
        ours, theirs = rows - sql_rows, sql_rows - rows
        return sum(rows.values()), (
            f"{sum(rows.values())} / {sum(sql_rows.values())} rows; only Spark {sum(ours.values())} "
            f"{list(ours)[:2]}; only SQL {sum(theirs.values())} {list(theirs)[:2]}"[:1500]
        )
    return sum(rows.values()), ""


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, connection = session(), database(sf_dir)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                count, problem = differences(queries[name](spark, sf_dir), connection, oracles[name])
            else:
                count, problem = queries[name](spark, sf_dir).count(), ""
        except Exception as error:  # noqa: BLE001
            count, problem = 0, f"{type(error).__name__}: {error}"[:1500]
        bad += bool(problem)
        kind = "exact" if name in oracles else "rows "
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {count} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
