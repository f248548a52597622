"""Every corpus query with a SQL twin on the smallest tables, and the registry."""

import pytest

import __spark_entry__ as E
from pathloom.llm import queries as q
from tests_rows import connect, rows


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert len(got) == len(want) and not bad, bad[:3]


def test_all_are_registered():
    assert {*q.QUERIES, "pipeline"} <= set(E.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))
