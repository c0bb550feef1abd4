"""Every tree query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from thicket.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        want = db.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
