"""Small documents with the odd cases every operator has to stand."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_cases import SCHEMA, prose, rows  # noqa: E402


@pytest.fixture
def draw():
    return random.Random(5)


@pytest.fixture
def frame(spark):
    def make(records):
        return spark.createDataFrame([tuple(r) for r in records], SCHEMA)

    return make


@pytest.fixture
def stored(frame, tmp_path):
    """Documents read from files, as rows that are known by their number need."""
    count = iter(range(100))

    def make(records):
        path = str(tmp_path / f"docs{next(count)}")
        frame(records).write.parquet(path)
        return frame([]).sparkSession.read.parquet(path)

    return make


@pytest.fixture
def odd(draw):
    """Null and empty texts, white space alone, one very long text, equal texts, a null id and repeated rows."""
    texts = [None, "", " \n\t ", "one", prose(draw, 30_000), *[prose(draw, 60) for _ in range(12)], "one", None, "x" * 5_000]
    found = rows(texts)
    found.append((None, *found[7][1:]))
    found += [found[8]] * 3
    return found
