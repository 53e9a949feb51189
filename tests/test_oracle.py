"""Every core query with oracle SQL, side by side with DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
from importlib import import_module
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CORE = {n: (m, q) for m in (import_module(x) for x in entry.MODULES) for n, q in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.isoformat().replace("T", " ")[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    module, query = CORE[name]
    df = query(spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in module.SQL:
        return
    cursor = duck.execute(module.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
