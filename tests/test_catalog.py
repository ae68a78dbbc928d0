"""Every registered query against its SQL on the smallest data folder."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.10g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rel = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [list(rel.columns).index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["domain", "model"]
    assert df.count() == 25
