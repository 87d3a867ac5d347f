"""Every registered query with a SQL twin gives the same rows."""

from __future__ import annotations

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in TWINS:
        problem = oracle.compare(found, con.sql(TWINS[name]).df())
        assert problem is None, problem
    else:
        assert len(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
