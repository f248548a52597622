"""Neighbour search, refinement, evaluation and chart metrics against brute force.

Every operator that has a broadcast plan and a blocked plan is run through both.
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import ablation as AB
from pathloom.operators import charts as CH
from pathloom.operators import evaluate as EV
from pathloom.operators import localize as LZ
from pathloom.operators.knn import knn_join, knn_join_views
from pathloom.operators.skew import salted_lookup
from pathloom.session import materialize

BLOCKED = dict(local_rows=1, block_rows=40)


def points(spark, n=300, dim=6, seed=0, copies=0.35):
    """Clustered points, one vector repeated for a third of the rows."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 6 * rng.integers(0, 3, (n, 1))
    v[rng.random(n) < copies] = v[0]
    xy = rng.uniform(0, 40, (n, 2))
    rows = [(int(i), [float(c) for c in v[i]], float(xy[i, 0]), float(xy[i, 1]), int(i % 5), int(i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, x double, y double, fold int, label int")
    return materialize(df), v, xy


def brute(q, c, q_ids, c_ids, k, ok=None):
    out = {}
    for a, qa in zip(q_ids, q):
        d = np.sqrt(((c - qa) ** 2).sum(1))
        order = sorted((d[b], c_ids[b]) for b in range(len(c)) if ok is None or ok(a, c_ids[b]))
        out[int(a)] = [int(i) for _, i in order[:k]]
    return out


def as_lists(nb):
    out = {}
    for r in nb.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["cand_id"])
    return out


@pytest.mark.parametrize("plan", [{}, BLOCKED], ids=["broadcast", "blocked"])
def test_knn(spark, plan):
    p, v, _ = points(spark)
    ids = np.arange(len(v))
    test, train = p.filter("id % 3 = 0"), p.filter("id % 3 <> 0")
    q, c = ids[ids % 3 == 0], ids[ids % 3 != 0]
    assert as_lists(knn_join(test, train, 7, **plan)) == brute(v[q], v[c], q, c, 7)
    assert as_lists(knn_join(p, p, 4, exclude_self=True, **plan)) == brute(v, v, ids, ids, 4, lambda a, b: a != b)
    assert as_lists(knn_join(p, p, 4, use_folds=True, **plan)) == brute(v, v, ids, ids, 4, lambda a, b: a % 5 != b % 5)


@pytest.mark.parametrize("plan", [{}, BLOCKED], ids=["broadcast", "blocked"])
def test_knn_edges(spark, plan):
    p, v, _ = points(spark, n=30, dim=2)
    got = as_lists(knn_join(p, p.filter("id < 3"), 5, **plan))
    assert all(len(x) == 3 for x in got.values()) and len(got) == 30  # k beyond the candidates
    with pytest.raises(ValueError):
        knn_join(p, p.filter("id < 0"), 3, **plan)
    with pytest.raises(ValueError):
        knn_join(p, p, 3, metric="chebyshev")


@pytest.mark.parametrize("plan", [{}, BLOCKED], ids=["broadcast", "blocked"])
def test_knn_cosine(spark, plan):
    p, v, _ = points(spark, n=120, copies=0.0)
    p = materialize(p.withColumn("vec", F.when(F.col("id") == 5, F.array_repeat(F.lit(0.0), 6)).otherwise(F.col("vec"))))
    v[5] = 0
    n = np.linalg.norm(v, axis=1)
    nb = {(r["query_id"], r["rank"]): r["dist"] for r in knn_join(p, p, 3, metric="cosine", exclude_self=True, **plan).collect()}
    d = 1 - (v @ v.T) / np.maximum(np.outer(n, n), 1e-300)
    d[5, :], d[:, 5] = 1.0, 1.0
    np.fill_diagonal(d, np.inf)
    for i in range(120):
        assert np.allclose([nb[i, r] for r in (1, 2, 3)], np.sort(d[i])[:3], atol=1e-9)


def test_carry_views_and_accuracy(spark):
    p, v, xy = points(spark, n=150)
    for plan in ({}, BLOCKED):
        nb = knn_join_views(p, p, 2, {"a": [0, 1], "b": [2, 3, 4, 5]}, carry=("x",), **plan)
        rows = nb.collect()
        assert len(rows) == 2 * 150 * 2 and all(r["x"] == pytest.approx(xy[r["cand_id"], 0]) for r in rows)
        want = brute(v[:, [0, 1]], v[:, [0, 1]], range(150), range(150), 2)
        assert as_lists(nb.filter("view = 'a'")) == want
    from pathloom.operators.knn import knn_accuracy

    nb = knn_join(p, p, 1, carry=("label",))
    r = knn_accuracy(nb, p).first()
    near = brute(v, v, range(150), range(150), 1)
    assert r["n"] == 150 and r["accuracy"] == pytest.approx(np.mean([near[i][0] % 3 == i % 3 for i in range(150)]))


def test_salted_lookup(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"))
    per = materialize(big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10))
    out = salted_lookup(big, per, ["k"], "id", 100)
    assert out.count() == 5000 and out.filter("v <> k * 10").count() == 0
    assert set(out.columns) == {"id", "k", "v"}


def test_idw_cases(spark):
    nb = spark.createDataFrame([(1, 1, 7, 1.0, 0.0, 0.0), (1, 2, 8, 2.0, 3.0, 0.0), (2, 1, 7, 0.0, 5.0, 1.0), (2, 2, 8, 1.0, 9.0, 9.0)], "query_id bigint, rank int, cand_id bigint, dist double, x double, y double")
    one = {r["query_id"]: r for r in LZ.idw_predict(nb, 2, 1.0).collect()}
    two = {r["query_id"]: r for r in LZ.idw_predict(nb, 2, 2.0).collect()}
    assert one[1]["px"] == pytest.approx(1.0) and two[1]["px"] == pytest.approx(0.6)
    assert one[2]["px"] == pytest.approx(5.0, abs=1e-6)
    sweep = {(r["query_id"], r["k"], r["p"]): r["px"] for r in LZ.idw_sweep(nb).collect()}
    assert len(sweep) == 12 and sweep[1, 2, 1.0] == pytest.approx(1.0) and sweep[1, 1, 3.0] == 0.0


@pytest.mark.parametrize("plan", [{}, BLOCKED], ids=["broadcast", "grid"])
def test_radius_pools(spark, plan):
    p, v, xy = points(spark, n=240)
    # half the candidates stand on one spot
    crowd = p.withColumn("x", F.when(F.col("id") % 2 == 0, 10.0).otherwise(F.col("x"))).withColumn("y", F.when(F.col("id") % 2 == 0, 10.0).otherwise(F.col("y")))
    crowd = materialize(crowd)
    pos = xy.copy()
    pos[::2] = 10.0
    q = materialize(p.select("id", "vec", F.col("x").alias("cx"), F.col("y").alias("cy"), "fold"))
    for radius in (3.0, 7.5):
        got = {r["query_id"]: r for r in LZ.radius_topk(q, crowd, [radius], 4, **plan).collect()}
        for i in range(240):
            near = [j for j in range(240) if np.hypot(*(pos[j] - xy[i])) <= radius and j % 5 != i % 5]
            if not near:
                assert i not in got
                continue
            assert got[i]["pool"] == len(near)
            want = sorted((np.sqrt(((v[j] - v[i]) ** 2).sum()), j) for j in near)[:4]
            assert [e["cand_id"] for e in got[i]["nb"]] == [j for _, j in want]


def test_refine_fallback(spark):
    q = spark.createDataFrame([(1, 5.0, 5.0)], "id bigint, cx double, cy double")
    pool = spark.createDataFrame([(5.0, 1, 2, [(1.0, 7, 0.0, 0.0), (1.0, 8, 2.0, 2.0)])], "radius double, query_id bigint, pool bigint, nb array<struct<dist:double,cand_id:bigint,x:double,y:double>>")
    r = LZ.refine(q, pool, [5.0], [1, 2, 3], [1.0], 3).collect()
    assert all(x["fallback"] and (x["px"], x["py"]) == (5.0, 5.0) for x in r)
    r = {x["k"]: x for x in LZ.refine(q, pool, [5.0], [1, 2, 3], [1.0], 2).collect()}
    assert not r[2]["fallback"] and r[2]["px"] == pytest.approx(1.0) and r[3]["fallback"]


def test_ensembles(spark):
    d = [("a", 1, 0.0, 0.0), ("b", 1, 4.0, 0.0)]
    p = spark.createDataFrame(d, "method string, query_id bigint, px double, py double")
    assert LZ.ensemble_mean(p, {"a": 1.0, "b": 3.0}).first()["px"] == 3.0
    assert LZ.ensemble_mean(p).first()["px"] == 2.0
    assert LZ.ensemble_mean(p, {"a": 1.0, "b": 0.0}).first()["px"] == 0.0
    with pytest.raises(ValueError):
        LZ.ensemble_mean(p, {"a": -1.0})
    with pytest.raises(ValueError):
        LZ.ensemble_mean(p, {})
    four = spark.createDataFrame([(m, 1, x, 0.0) for m, x in zip("abcd", (0.0, 1.0, 2.0, 100.0))], p.schema)
    assert LZ.ensemble_trimmed(four, 0.25).first()["px"] == 1.5


def test_splits(spark):
    p = spark.createDataFrame([(i, 2.5 * i, 0.0) for i in range(4)], "id bigint, x double, y double")
    assert [r["is_test"] for r in LZ.split_checkerboard(p, 0.0, 0.0, 2.5).orderBy("id").collect()] == [False, True, False, True]
    b = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], p.schema)
    assert [r["is_test"] for r in LZ.split_block(b, 0.25).orderBy("id").collect()] == [False, False, False, True]
    big = LZ.split_random(spark.range(20000), 0.3)
    n = big.filter("is_test").count()
    assert abs(n / 20000 - 0.3) < 0.02 and LZ.split_random(spark.range(20000), 0.3).filter("is_test").count() == n


def test_scaling_and_pca(spark):
    p, v, _ = points(spark, n=200, copies=0.0)
    s = np.stack([r["vec"] for r in LZ.standardize(p).orderBy("id").collect()])
    assert np.allclose(s, (v - v.mean(0)) / v.std(0))
    one = LZ.standardize(p, ddof=1).orderBy("id").first()["vec"]
    assert np.allclose(one, (v[0] - v.mean(0)) / v.std(0, ddof=1))
    flat = LZ.standardize(p.withColumn("vec", F.array(F.lit(2.0)))).first()["vec"]
    assert flat == [0.0]
    assert LZ.group_weights([4, 1]) == [0.5, 0.5, 0.5, 0.5, 1.0]
    w = np.stack([r["vec"] for r in LZ.pca_whiten(p, p, 3).orderBy("id").collect()])
    assert w.shape == (200, 3) and np.allclose(np.cov(w.T), np.eye(3), atol=1e-6)
    mean, axes, var, total = LZ.pca_fit(p, 2)
    want = np.linalg.eigvalsh(np.cov(v.T))[::-1]
    assert np.allclose(var, want[:2]) and total == pytest.approx(want.sum())
    kept = LZ.pca_whiten(p, p, 0.95).first()["vec"]
    assert len(kept) == int(np.searchsorted(np.cumsum(want) / want.sum(), 0.95) + 1)


def test_percentiles_and_cdf(spark):
    rng = np.random.default_rng(2)
    big = rng.gamma(1.0, 10.0, 30000)
    ties = np.repeat([1.0, 2.0, 3.0], [12000, 5, 8000])
    rows = [("g", float(x)) for x in big] + [("t", float(x)) for x in ties] + [("s", x) for x in (1.0, 2.0, 3.0, 10.0)]
    d = materialize(spark.createDataFrame(rows, "method string, err double").repartition(6))
    m = {r["method"]: r for r in EV.error_metrics(d, "method").collect()}
    for g, a in (("g", big), ("t", ties), ("s", np.array([1.0, 2, 3, 10]))):
        assert m[g]["n"] == len(a) and m[g]["mae"] == pytest.approx(a.mean())
        assert [m[g][c] for c in ("median", "p90", "p95")] == pytest.approx(list(np.percentile(a, [50, 90, 95])), abs=1e-9)
    assert m["s"]["rmse"] == pytest.approx(5.338539, abs=1e-6) and m["s"]["p90"] == pytest.approx(7.9)
    c = EV.error_cdf(d, "method").filter("method = 'g'").orderBy("err").collect()
    assert np.allclose([r["err"] for r in c], np.sort(big)) and np.allclose([r["cdf"] for r in c], np.arange(1, 30001) / 30000)
    t = EV.error_cdf(d, "method").filter("method = 't'").orderBy("err").collect()
    assert [r["n_tied"] for r in t] == [12000, 5, 8000] and t[-1]["cdf"] == 1.0


def test_tables(spark):
    nan = float("nan")
    rows = [("ALL", 4, ["rss"], "WKNN (IDW)", 3.0, 4.0, 5.0), ("ALL", 4, ["rss"], "NN Regression", nan, nan, nan), ("x", 2, ["aoa", "tdoa"], "WKNN (IDW)", 2.0, 3.0, 4.0), ("x", 2, ["aoa", "tdoa"], "CNN Regression", 1.0, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "combo string, n_feat int, enabled array<string>, method string, mae double, rmse double, p90 double")
    t = {r["combo"]: r for r in EV.comparison_table(s).collect()}
    assert t["ALL"]["nn_mae"] is None and t["ALL"]["best_mae"] == 3.0 and t["ALL"]["best_method"] == "WKNN (IDW)"
    assert t["x"]["best_method"] == "CNN Regression" and t["x"]["feat_abbrev"] == "TDoA+AoA"
    d = EV.delta_vs_baseline(EV.comparison_table(s)).collect()
    assert len(d) == 1 and d[0]["delta"] == -2.0
    assert [r["combo"] for r in EV.sort_table(EV.comparison_table(s), "nn_mae").collect()] == ["ALL", "x"]
    assert len(AB.combinations()) == 23


@pytest.mark.parametrize("plan", [{}, BLOCKED], ids=["broadcast", "blocked"])
def test_chart_metrics(spark, plan):
    p, v, xy = points(spark, n=130)
    pts = materialize(p.select("id", F.col("vec").alias("hi"), F.slice("vec", 1, 2).alias("lo"), "x", "y"))
    n, k = 130, 8
    dh, dl = (np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)) for a in (v, v[:, :2]))

    def ranks(d, own):
        r = np.zeros((n, n), int)
        for i in range(n):
            order = sorted(j for j in range(n) if own or j != i)
            order = sorted(order, key=lambda j: (d[i, j], j))
            for pos, j in enumerate(order):
                r[i, j] = pos + 1
        return r

    for mode, own in (("standard", False), ("doubled", True)):
        rh, rl = ranks(dh, own), ranks(dl, own)
        off = np.eye(n, dtype=bool) & (not own)
        sc = lambda a, b: (np.where(b == n, 0, b) - k if own else b - k)[(a <= k) & (b > k) & ~off].sum()
        f = (4.0 if own else 2.0) / (n * k * (2 * n - 3 * k - 1))
        r = CH.trustworthiness_continuity(pts, k, mode, **plan).first()
        assert r["tw"] == pytest.approx(1 - f * sc(rl, rh)) and r["ct"] == pytest.approx(1 - f * sc(rh, rl))
    m = dh > 0
    s = CH.kruskal_stress(pts, **plan).first()["stress"]
    assert s == pytest.approx(np.sqrt(((dh - dl)[m] ** 2).sum() / (dh[m] ** 2).sum()), rel=1e-9)
    nn = [min((dl[i, j], j) for j in range(n) if j != i)[1] for i in range(n)]
    assert CH.nnle(pts, **plan).first()["nnle"] == pytest.approx(np.mean(np.linalg.norm(xy - xy[nn], axis=1)))


def test_chart_identities(spark):
    p, _, _ = points(spark, n=60, copies=0.0)
    same = p.select("id", F.col("vec").alias("hi"), F.col("vec").alias("lo"), "x", "y")
    r = CH.trustworthiness_continuity(same, 5).first()
    assert (r["tw"], r["ct"]) == (1.0, 1.0) and CH.kruskal_stress(same).first()["stress"] == pytest.approx(0.0)
    double = same.withColumn("lo", F.transform("hi", lambda v: v * 2))
    assert CH.kruskal_stress(double).first()["stress"] == pytest.approx(1.0)


def test_views_move_the_blocks_once(spark, monkeypatch):
    """Several blocks of candidates: equal to brute force, by one join for all views."""
    from pathloom.operators import knn as K

    monkeypatch.setattr(K, "LOCAL_BYTES", 16 * 6 * 40)  # blocks of 40 rows
    p, v, _ = points(spark, n=150)
    views = {"a": [0, 1], "b": [2, 3, 4, 5]}
    nb = knn_join_views(p, p, 3, views, local_rows=1)
    assert nb._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    for name, at in views.items():
        assert as_lists(nb.filter(nb["view"] == name)) == brute(v[:, at], v[:, at], range(150), range(150), 3)


def test_blocks_of_wide_rows_are_larger():
    from pathloom.operators.knn import LOCAL_BYTES, rows_of_block

    assert rows_of_block(10_000_000, 64, 12) == LOCAL_BYTES // (16 * 64)
    assert rows_of_block(1_000_000, 2, 12) == rows_of_block(50_000, 64, 12) == 4096
    assert rows_of_block(1_000_000, 64, 12, block_rows=40) == 40
