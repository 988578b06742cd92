from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_rows import SCHEMA, line, prose  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with our names."""
    rows = [
        line(1, prose(1, 60)), line(1, prose(1, 60)), line(2, None), line(3, ""), line(3, ""), line(4, " \t\n "),
        line(None, prose(4, 30), None), line(None, None, None), line(5, prose(5, 30_000), "b"), line(6, "Ünïcödé 😀 naïve " * 20, "b"),
        tuple([None] * 13),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
