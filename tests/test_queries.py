"""Every query that SQL can express, against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from plotcheck.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in fixtures.BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = con.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"train_classifier"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_library_stands_alone():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "plotcheck.llm" not in p.read_text(), p
