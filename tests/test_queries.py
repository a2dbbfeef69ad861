"""Every registered query of the catalogue against its SQL twin."""

import pytest
from check import compare, duck

from shelfmark.plans import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries whose twins are also held against more rows, where rare values meet rules.
LARGER, LARGER_SF = ("parsed_headings", "link_rows", "chained_intake", "file_cascade", "search_terms", "message_works"), "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, connection, name):
    query = QUERIES[name]
    if query.sql is None:
        assert query(spark, SF).columns
    else:
        assert compare(query(spark, SF), connection, query.oracle()) == []


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_its_twin_on_more_rows(spark, name):
    assert compare(QUERIES[name](spark, LARGER_SF), duck(LARGER_SF), QUERIES[name].oracle()) == []


def test_a_query_needs_no_training_data_operator():
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class Absent(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, *_):\n"
        "        if name.startswith('shelfmark.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Absent())\n"
        "import __spark_entry__ as e\n"
        "assert 'daily_trend' in e.queries() and not any(n.startswith('op1') for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
