from __future__ import annotations

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from millrace.session import build_session  # noqa: E402

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return TABLES


@pytest.fixture
def at(spark):
    """Rows with a ``ts`` column given in seconds since 1970."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema).selectExpr(
            *(f"timestamp_seconds({f}) AS {f}" if f.endswith("ts") else f for f in [c.split()[0] for c in schema.split(", ")])
        )

    return build


def seconds(df, *columns):
    """Sorted rows with times as seconds since 1970."""
    names = columns or df.columns
    types = dict(df.dtypes)
    shown = [f"unix_micros({c}) / 1000000.0D AS {c}" if types[c] == "timestamp" else c for c in names]
    return sorted((tuple(r) for r in df.selectExpr(*shown).collect()), key=repr)
