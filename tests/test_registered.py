"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    return oracle.database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    result = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert result.count() > 0
        return
    count, problem = oracle.differences(result, tables, ORACLES[name])
    assert not problem
    assert count > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
