"""Registered queries against their SQL on the smallest given tables."""

import os

import pytest
from test_queries import DATA, compare

from tidemark.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
