"""Every registered query of the engine's own modules against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from __spark_entry__ import OWN

DATA = "/root/testdata/sf0.01"
QUERIES = {k: f for m in OWN for k, f in m.QUERIES.items()}
SQL = {k: s for m in OWN for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, list):
        return tuple(map(plain, x))
    if x is None or isinstance(x, int | str | bool | tuple):
        return x
    return plain(float(x)) if type(x).__name__ == "Decimal" else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = table(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=1e-6) if not any(isinstance(v, tuple) for v in x) and all(isinstance(v, float) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
