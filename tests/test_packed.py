"""Counts and neighbours from blocks that are read in pairs, against plain loops."""

import numpy as np

from pathloom.operators import blocks as B
from pathloom.operators import charts as CH
from pathloom.operators import knn as K


def frame(spark, v):
    rows = [(i * 7 + 1, [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)


def plain_rank(v, ids, i, j):
    d = np.sqrt(((v - v[i]) ** 2).sum(1))
    return 1 + sum((d[t], ids[t]) < (d[j], ids[j]) for t in range(len(v)) if t != i)


def test_single_precision_decides_only_what_is_clear():
    """Far from the origin, with copies, huge and tiny values: as exact as plain differences."""
    r = np.random.default_rng(5)
    base = np.repeat(r.normal(size=(150, 6)), 4, 0)
    for v in (base, base + 1e7, base * 1e-30, base * 1e25, base * 1e200, np.ones((600, 3))):
        ids = r.permutation(len(v))
        q = v[:40]
        with np.errstate(all="ignore"):
            d = B.exact_dist(q, v, *(x.ravel() for x in np.indices((40, len(v))))).reshape(40, -1)
        near = r.integers(0, len(v), (40, 3))
        lim, lid = d[np.arange(40)[:, None], near], ids[near]
        lim = np.where(np.isfinite(lim), lim, -1.0)
        with np.errstate(all="ignore"):
            got = B.count_closer(q, ids[:40], v, ids, lim, lid)
        for i, t in zip(*np.nonzero(lim >= 0)):
            before = (d[i] < lim[i, t]) | ((d[i] == lim[i, t]) & (ids < lid[i, t]))
            assert got[i, t] == (before & (ids != ids[i])).sum()
    assert B.Preselect(base, base).usable and not B.Preselect(base * 1e200, base).usable


def test_column_counts_pass_a_byte():
    assert B._column_counts(np.ones((1000, 3), bool)).tolist() == [1000] * 3
    flags = np.zeros((13, 7), bool)
    flags[12, 6] = flags[0, 0] = flags[4, 3] = True
    assert sorted(zip(*(x.tolist() for x in B._set_flags(flags)))) == [(0, 0), (4, 3), (12, 6)]


def test_ranks_of_wide_points(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(size=(90, 12)), np.zeros((6, 12))])
    p = frame(spark, v)
    ids = [i * 7 + 1 for i in range(len(v))]
    pairs = [(i, int(j)) for i in range(0, 96, 5) for j in r.choice(96, 4, replace=False) if i != j]
    asked = spark.createDataFrame([(ids[i], ids[j]) for i, j in pairs], "query_id long, cand_id long")
    ranks = CH.pair_ranks(p, asked, block_rows=20, local_rows=1)
    assert "CartesianProduct" in ranks._jdf.queryExecution().executedPlan().toString()  # nothing wide is shuffled for a pair of blocks
    got = {(a, b): n for a, b, n in (tuple(x) for x in ranks.collect())}
    assert got == {(ids[i], ids[j]): plain_rank(v, ids, i, j) for i, j in pairs}


def test_ranks_of_narrow_points(spark):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=(150, 2)), np.ones((5, 2))])
    ids = [i * 7 + 1 for i in range(len(v))]
    pairs = [(i, int(j)) for i in range(0, 155, 3) for j in r.choice(155, 5, replace=False) if i != j]
    asked = spark.createDataFrame([(ids[i], ids[j]) for i, j in pairs], "query_id long, cand_id long")
    got = CH.pair_ranks(frame(spark, v), asked, block_rows=12, local_rows=1).collect()
    assert {(a, b): n for a, b, n in got} == {(ids[i], ids[j]): plain_rank(v, ids, i, j) for i, j in pairs}


def test_neighbours_of_very_wide_rows(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(70, K.PACKED + 4))
    v[60:] = v[3]  # copies
    p = frame(spark, v)
    ids = [i * 7 + 1 for i in range(len(v))]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for own in (False, True):
        near = K.knn_join(p, p, 4, exclude_self=not own, local_rows=1, block_rows=25)
        got = {}
        for x in near.collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["cand_id"], x["dist"]))
        assert len(got) == 70
        for i in range(70):
            want = sorted((d[i, j], ids[j]) for j in range(70) if own or j != i)[:4]
            assert [c for _, c, _ in sorted(got[ids[i]])] == [c for _, c in want]
            assert np.allclose([e for *_, e in sorted(got[ids[i]])], [e for e, _ in want])


def test_neighbours_of_very_wide_rows_are_not_shuffled_for_each_block(spark, monkeypatch):
    """Every row moves into its block once: no co-grouped blocks (as many copies of a row as blocks) are left."""
    v = np.random.default_rng(8).normal(size=(60, K.PACKED + 1))
    monkeypatch.setattr(K, "pair_blocks", None)
    near = K.knn_join(frame(spark, v), frame(spark, v), 2, local_rows=1, block_rows=10)
    assert near.count() == 120
