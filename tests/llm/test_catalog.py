"""Registered queries of the pipeline operators against their SQL at the smallest scale."""

import re

import pytest

import __spark_entry__ as entry
from docfields.llm.queries import ORACLES, QUERIES
from tests.oracle import check, connect

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problem, rows = check(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None and rows > 0
