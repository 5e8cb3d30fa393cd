from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]])

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def spark():
    from loculus.session import local_session

    s = local_session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return str(round(float(v), 9)) if isinstance(v, (int, float, np.number)) else str(v)


def same_rows(a, b) -> None:
    """Two pandas frames hold the same rows in any order."""
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    assert len(a) == len(b)
    rows = lambda x: sorted(map(tuple, x[columns].map(plain).to_numpy().tolist()))
    for x, y in zip(rows(a), rows(b)):
        assert x == y
