"""Every registered query with SQL equals DuckDB on tables of 10,000 events; the others give rows, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import slotwise.analysis_queries  # noqa: F401
from slotwise.queries import ORACLE, QUERIES

DATA, SMALLEST = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return c


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA if name in ORACLE else SMALLEST).toPandas()
    if name in ORACLE:
        pd.testing.assert_frame_equal(ordered(got), ordered(duck.execute(ORACLE[name]).fetchdf()), check_dtype=False, atol=1e-9)
    assert len(got) or name == "time_inversions"
