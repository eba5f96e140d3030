from __future__ import annotations

import glob
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quernlake.session import local_session

    session = local_session(app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "tzinfo") and v.tzinfo:
        v = v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compare a DataFrame with SQL: names of columns, and rows in any order."""

    def compare(df, sql: str) -> None:
        result = duck.execute(sql)
        columns = sorted(c[0] for c in result.description)
        assert columns == sorted(df.columns)
        order = [[c[0] for c in result.description].index(c) for c in columns]
        theirs = sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
        ours = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        assert ours == theirs

    return compare
