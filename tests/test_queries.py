"""Every query with SQL gives DuckDB's rows; every other runs and gives rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from allelia.plans import queries as association

NAMES = sorted(association.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v) -> str:
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    found = association.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in found.collect())
    if name not in association.ORACLES:
        assert rows
        return
    told = duck.sql(association.ORACLES[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert rows == sorted(tuple(text(r[i]) for i in at) for r in told.fetchall())


def test_oracles_have_rows():
    """An empty result tests nothing: at the scale of the correctness gate every query's SQL has rows."""
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert [n for n in NAMES if n in association.ORACLES and not con.sql(f"SELECT COUNT(*) FROM ({association.ORACLES[n]})").fetchall()[0][0]] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
