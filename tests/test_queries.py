"""Every registered query with a SQL twin, compared row for row on the smallest tables."""

import os

import pytest

import __spark_entry__ as E

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf):
    if not os.path.isdir(sf):
        pytest.skip("test tables not available")
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in data:
        vals = [r[i] for i in order]
        out.append(tuple(None if isinstance(v, float) and v != v else v for v in vals))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]


def test_registry():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() == 5
