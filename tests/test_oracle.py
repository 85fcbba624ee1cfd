"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as spark_entry
from tracemill.registry.oracles import all_oracles
from tracemill.registry.queries import all_queries
from compare import connect, rows_of, types_of

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# The operators for training text have tests of their own.
QUERIES = {name: spark_entry.queries()[name] for name in all_queries()}
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert types_of(got) == types_of(want)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
