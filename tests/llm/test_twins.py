"""Queries of this subpackage that have an SQL twin."""

import pytest
from check import compare, duck

from shelfmark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name]) == []
