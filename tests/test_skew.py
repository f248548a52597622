"""One key, value or vector holding a third of the rows or more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import links as L
from pathloom.operators import match as M
from pathloom.operators import stats as S
from pathloom.schema import PATHS
from pathloom.session import materialize


@pytest.fixture(scope="module")
def hot(spark):
    """20000 paths; link (0, 0) holds 45 %, and most of its paths share one delay."""
    rng = np.random.default_rng(9)
    n = 20000
    link = np.where(rng.random(n) < 0.45, 0, rng.integers(1, 300, n))
    d = np.round(rng.uniform(1, 300, n), 2)
    d[(link == 0) & (rng.random(n) < 0.8)] = 42.5
    a = rng.uniform(0.001, 1, n)
    rows = [(int(k // 5), int(k % 5), i, float(x), float(y), 0.0, 0.0) for i, (k, x, y) in enumerate(zip(link, d, a))]
    return materialize(spark.createDataFrame(rows, PATHS)), rows


@pytest.fixture(autouse=True)
def small_salts(monkeypatch):
    for m in (L, M, S):
        monkeypatch.setattr(m, "ROWS_PER_SALT", 500)


def test_first_flag(hot):
    p, rows = hot
    want = {}
    for r in rows:
        k = (r[0], r[1])
        want[k] = min(want.get(k, (1e9, 0)), (r[3], r[2]))
    out = L.with_first_flag(p)
    assert out.count() == len(rows)
    got = {(r["rx_id"], r["tx_id"]): r["path_id"] for r in out.filter("is_first").collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_profile(hot):
    p, rows = hot
    by = {}
    for r in rows:
        by.setdefault((r[0], r[1]), []).append(r)
    for g in S.delay_spread_profile(p, "rx_id", "tx_id").collect():
        v = sorted(by[g["rx_id"], g["tx_id"]], key=lambda r: (r[3], r[2]))
        d, w = np.array([r[3] for r in v]), np.array([r[4] for r in v]) ** 2
        top = max(range(len(v)), key=lambda i: (w[i], -i))
        mu = (w * d).sum() / w.sum()
        assert g["strong_idx"] == top and g["n"] == len(v)
        assert g["mean_spread"] == pytest.approx(mu - d[0], abs=1e-8)
        assert g["spread_std"] == pytest.approx(np.sqrt((w * (d - mu) ** 2).sum() / w.sum()), abs=1e-6)


def test_match(hot):
    p, rows = hot
    a, b = p.filter(F.col("path_id") % 2 == 0), p.filter(F.col("path_id") % 2 == 1)
    got = {r["i"]: r["j"] for r in M.match_paths(a, b, 2.0).collect()}
    right = {}
    for r in rows:
        if r[2] % 2:
            right.setdefault(r[0], []).append((r[3], r[2]))
    right = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v])) for k, v in right.items()}
    want = {}
    for r in rows:
        if r[2] % 2 == 0 and r[0] in right:
            d, j = right[r[0]]
            ok = j[np.abs(d - r[3]) < 2.0]
            if len(ok):
                want[r[2]] = int(ok.min())
    assert got == want
