from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tonegrain.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
            "spark.driver.memory": "3g",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """``make(rows, schema)`` builds a DataFrame over three partitions."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return build
