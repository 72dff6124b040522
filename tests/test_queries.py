"""Every registered query that SQL can express against DuckDB, on the smallest tables."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

FOLDER = Path("/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()


def cell(v):
    """A value whose type counts: whole numbers of any width are one type, so are decimals; nulls are one value."""
    if isinstance(v, (list, tuple, np.ndarray)):
        return ("list", *map(cell, v))
    if v is None or pd.isna(v):
        return ("null",)
    if isinstance(v, (bool, np.bool_)):
        return ("bool", bool(v))
    if isinstance(v, (int, np.integer)):
        return ("number", float(v))
    return ("number", round(float(v), 9)) if isinstance(v, (float, np.floating, Decimal)) else (type(v).__name__, str(v))


def normal(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, row)) for row in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = __spark_entry__.queries()[name](spark, str(FOLDER)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize("name", ["repeat_units", "repeat_alignments", "name_variants"])
def test_costly_rows_are_dealt_over_all_tasks(spark, name):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
