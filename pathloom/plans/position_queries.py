"""Registered queries for positioning, evaluation and chart quality (feature matrix: ``embeddings``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators import ablation as AB
from pathloom.operators import charts as CH
from pathloom.operators import evaluate as EV
from pathloom.operators import localize as LZ
from pathloom.operators.knn import knn_accuracy, knn_join
from pathloom.plans.common import publish, q, qs
from pathloom.session import materialize
from pathloom.sources import carriers as C

PT = C.POINTS_SQL
N_GROUPS, GROUP_W = 8, 8  # the 64 columns stand for eight feature groups of eight


def _points(spark, d):
    return C.embedding_points(spark, d)


def _split(spark, d):
    p = _points(spark, d)
    return p.filter(~F.col("is_test")), p.filter("is_test")


def _nb(spark, d, k, **kw):
    train, test = _split(spark, d)
    return knn_join(test, train, k, carry=("x", "y"), **kw)


# ---------------------------------------------------------------- splits and scaling
def split_random(spark, d):
    """The hash split, side by side with the same hash in SQL."""
    s = LZ.split_random(_points(spark, d))
    return s.select("id", F.col("is_test").cast("int").alias("is_test"))


def split_mod(spark, d):
    """The id-arithmetic split and folds used by the positioning queries."""
    return _points(spark, d).groupBy("is_test", "fold").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"))


def split_checkerboard(spark, d):
    s = LZ.split_checkerboard(_points(spark, d), 0.0, 0.0, 2.5)
    return s.select("id", F.col("is_test").cast("int").alias("is_test"))


def split_block(spark, d):
    s = LZ.split_block(_points(spark, d), 0.3)
    return s.select("id", F.col("is_test").cast("int").alias("is_test"))


def column_stats(spark, d):
    s = LZ.column_stats(_points(spark, d))
    z = s.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "v"))
    return publish(z.select("dim", F.col("v.mean").alias("mean"), F.col("v.std").alias("std")))


def standardize(spark, d):
    """Train-fitted scaling applied to the test rows."""
    train, test = _split(spark, d)
    s = LZ.standardize(test, train)
    return publish(s.select("id", F.posexplode("vec").alias("dim", "v")))


def group_weights(spark, d):
    """Per-group norm of the weighted vectors, with a tail beyond the listed groups."""
    w = LZ.apply_group_weights(_points(spark, d), [32, 16, 8])
    sq = lambda a, n: F.aggregate(F.slice("vec", a, n), F.lit(0.0), lambda s, v: s + v * v)
    return publish(
        w.select("id", sq(1, 32).alias("g0"), sq(33, 16).alias("g1"), sq(49, 8).alias("g2"), sq(57, 8).alias("tail"))
    )


def _cells(p):
    """Cell of every point and the number of cells in x; the grid covers all points."""
    nx, ny = EV.grid_shape(p, -1.25, -1.25, 5.0)
    xi, yi = X.grid_index(F.col("x"), -1.25, 5.0, nx), X.grid_index(F.col("y"), -1.25, 5.0, ny)
    return p.select("id", (xi + yi * nx).alias("cell")), nx


def grid_cells(spark, d):
    return _cells(_points(spark, d))[0]


def cell_centroids(spark, d):
    cells, nx = _cells(_points(spark, d))
    g = cells.groupBy("cell").agg(F.count("*").alias("n"))
    return publish(
        g.select(
            "cell",
            "n",
            X.cell_centre(F.pmod("cell", F.lit(nx)), -1.25, 5.0).alias("cx"),
            X.cell_centre(F.floor(F.col("cell") / nx), -1.25, 5.0).alias("cy"),
        )
    )


# ---------------------------------------------------------------- neighbours
def knn_topk(spark, d):
    return publish(_nb(spark, d, 5).select("query_id", "rank", "cand_id", "dist"))


def knn_cosine(spark, d):
    return publish(_nb(spark, d, 5, metric="cosine").select("query_id", "rank", "cand_id", "dist"))


def knn_loo(spark, d):
    p = _points(spark, d)
    return publish(knn_join(p, p, 3, exclude_self=True))


def accuracy_knn_class(spark, d):
    train, test = _split(spark, d)
    return publish(knn_accuracy(knn_join(test, train, 1, carry=("label",)), test))


def wknn_predict(spark, d):
    return publish(LZ.idw_predict(_nb(spark, d, 5), 5, 2.0))


def wknn_cv_grid(spark, d):
    train, _ = _split(spark, d)
    return publish(LZ.wknn_cv_grid(train))


def wknn_best(spark, d):
    train, _ = _split(spark, d)
    return publish(LZ.best_params(LZ.wknn_cv_grid(train), "k", "p"))


def wknn_metrics(spark, d):
    """Cross-validated wKNN evaluated on the test rows."""
    train, test = _split(spark, d)
    return publish(EV.error_metrics(materialize(LZ.wknn(train, test)), "method"))


def loo_k_sweep(spark, d):
    e = materialize(LZ.loo_sweep(LZ.standardize(_points(spark, d), ddof=1)).select("k", "err"))
    return publish(EV.error_metrics(e, "k").drop("min_err", "max_err"))


def localize_new(spark, d):
    train, test = _split(spark, d)
    return publish(LZ.localize_new(test, train, 5))


def c2f_refine(spark, d):
    train, test = _split(spark, d)
    p = LZ.c2f(train, test, 5, 1.0, 5.0, 3, 2.0)
    return publish(p.select("query_id", F.col("fallback").cast("int").alias("fallback"), "px", "py", "err"))


def c2f_cv_grid(spark, d):
    train, _ = _split(spark, d)
    return publish(LZ.c2f_cv_grid(train, 5, 1.0))


def _members(spark, d):
    nb = materialize(_nb(spark, d, 25))
    out = None
    for m, k, p in (("k1", 1, 1.0), ("k3", 3, 1.0), ("k9", 9, 2.0), ("k25", 25, 1.0)):
        e = LZ.idw_predict(nb, k, p).withColumn("method", F.lit(m))
        out = e if out is None else out.unionByName(e)
    return out


def ensemble_mean(spark, d):
    return publish(LZ.ensemble_mean(_members(spark, d), {"k1": 1.0, "k3": 3.0, "k9": 2.0, "k25": 0.5}))


def ensemble_trimmed(spark, d):
    return publish(LZ.ensemble_trimmed(_members(spark, d), 0.25))


def ensemble_weights(spark, d):
    _, test = _split(spark, d)
    e = materialize(LZ.with_error(_members(spark, d), test))
    return publish(LZ.inverse_mae_weights(e.groupBy("method").agg(F.avg("err").alias("mae"))))


# ---------------------------------------------------------------- evaluation
def _errors(spark, d):
    _, test = _split(spark, d)
    return materialize(LZ.with_error(_members(spark, d), test))


def error_metrics(spark, d):
    return publish(EV.error_metrics(_errors(spark, d), "method"))


def path_percentiles(spark, d):
    """Exact median, P90 and P95 of path delay per transmitter on the larger path table."""
    p = C.lineitem_paths(spark, d).select("tx_id", F.col("amp") * 1e6)
    p = p.toDF("tx_id", "err")
    return publish(EV.error_metrics(p, "tx_id").drop("min_err", "max_err"))


def error_cdf(spark, d):
    return publish(EV.error_cdf(_errors(spark, d).withColumn("err", X.q6(F.col("err"))), "method"))


def error_heatmap(spark, d):
    nx, ny = EV.grid_shape(_points(spark, d), -1.25, -1.25, 5.0)
    return publish(EV.error_heatmap(_errors(spark, d), -1.25, -1.25, 5.0, nx, ny, "method"))


def pct_within(spark, d):
    # grid distances fall exactly on the limits, so errors are compared as published
    return publish(EV.percent_within(publish(_errors(spark, d)), [5.0, 10.0, 20.0, 40.0], "method"))


def accuracy_labels(spark, d):
    m = _errors(spark, d).groupBy("method").agg(F.avg("err").alias("mae"))
    return m.select("method", X.accuracy_label(F.col("mae")).alias("label"), X.accuracy_verdict(F.col("mae")).alias("verdict"))


def results_wide(spark, d):
    e = _errors(spark, d).select(F.col("query_id").alias("rx_id"), "method", "px", "py", "err")
    return publish(EV.results_wide(e, ["k1", "k3", "k9", "k25"]))


def _ablation(spark, d):
    train, test = _split(spark, d)
    # scaled columns, cut into named groups (fitted on the training rows)
    cols = {g: f"f_{g}" for g in AB.GROUPS}

    def cut(df):
        return df.select(
            "id", "x", "y", *[F.slice("vec", 1 + GROUP_W * i, GROUP_W).alias(cols[g]) for i, g in enumerate(AB.GROUPS)]
        )

    return AB.run(cut(LZ.standardize(test, train)), cut(LZ.standardize(train, train)), cols, AB.combinations(), 5, 1.0)


def ablation_table(spark, d):
    t = EV.comparison_table(_ablation(spark, d))
    return publish(t.select("combo", "n_feat", "feat_abbrev", "wknn_mae", "wknn_rmse", "wknn_p90", "best_mae", "best_method"))


def ablation_ranked(spark, d):
    """The sorted comparison table with the place of every combination; there are as many rows as combinations."""
    # as published: combinations that differ in the last bit share a value
    t = EV.sort_table(publish(materialize(EV.comparison_table(_ablation(spark, d))))).select("combo", "wknn_mae")
    place = F.row_number().over(Window.orderBy(F.col("wknn_mae").asc_nulls_last(), "combo"))
    return t.withColumn("place", place)


def delta_vs_baseline(spark, d):
    return publish(EV.delta_vs_baseline(materialize(EV.comparison_table(_ablation(spark, d)))))


# ---------------------------------------------------------------- chart quality
def _chart(spark, d, a=0):
    return _points(spark, d).select("id", F.col("vec").alias("hi"), F.slice("vec", a + 1, 2).alias("lo"), "x", "y")


def intruder_ranks(spark, d):
    """False neighbours of the chart with their rank in feature space."""
    return CH.rank_penalties(_chart(spark, d), 10)[0]


def trustworthiness(spark, d):
    return publish(CH.trustworthiness_continuity(_chart(spark, d), 10))


def trustworthiness_doubled(spark, d):
    """The doubled-penalty variant that counts a point among its own neighbours."""
    return publish(CH.trustworthiness_continuity(_chart(spark, d), 10, mode="doubled"))


def kruskal_stress(spark, d):
    return publish(CH.kruskal_stress(_chart(spark, d)))


def nnle(spark, d):
    return publish(CH.nnle(_chart(spark, d)))


def nnle_idw(spark, d):
    return publish(CH.nnle_idw(_chart(spark, d)))


def chart_winners(spark, d):
    """Scores of three charts with per-metric winners and verdicts."""
    charts = {f"dims{2 * i}": f"lo{2 * i}" for i in range(3)}
    slices = [F.slice("vec", 2 * i + 1, 2).alias(lo) for i, lo in enumerate(charts.values())]
    out = CH.scores_of_charts(_points(spark, d).select("id", F.col("vec").alias("hi"), *slices, "x", "y"), charts)
    w = EV.metric_winners(materialize(out))
    flags = [c for c in w.columns if c.startswith("best_")]
    return publish(w.select(*[F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in w.columns]))


def propagate(spark, d):
    """Chart positions of every point from the training points' positions."""
    p = _points(spark, d)
    fitted = p.filter(~F.col("is_test")).select("id", "vec", F.col("vec")[0].alias("z1"), F.col("vec")[1].alias("z2"))
    return publish(CH.propagate(fitted, p))


def geographic_rgb(spark, d):
    return publish(CH.geographic_rgb(_points(spark, d)))


def frobenius_nearest(spark, d):
    return publish(CH.frobenius_distance(_points(spark, d)))


# ---------------------------------------------------------------- SQL twins
_NN = """nn AS (SELECT t.id AS query_id, c.id AS cand_id, c.x, c.y, list_distance(t.vec, c.vec) AS dist,
    CAST(row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS INTEGER) AS rank
  FROM points t JOIN points c ON t.is_test AND NOT c.is_test)"""
_CV = """nn AS (SELECT t.id AS query_id, t.fold, t.x AS tx, t.y AS ty, c.x, c.y, list_distance(t.vec, c.vec) AS dist,
    CAST(row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS INTEGER) AS rank
  FROM points t JOIN points c ON NOT t.is_test AND NOT c.is_test AND t.fold <> c.fold)"""
_GRID25 = f"""{_CV}, sw AS (SELECT query_id, fold, tx, ty, rank AS k, p.p, sum(1/(pow(dist, p.p)+1e-10)) OVER w AS s,
    sum(x/(pow(dist, p.p)+1e-10)) OVER w AS sx, sum(y/(pow(dist, p.p)+1e-10)) OVER w AS sy
  FROM nn CROSS JOIN (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) p(p) WHERE rank <= 25
  WINDOW w AS (PARTITION BY query_id, p.p ORDER BY rank)),
  fe AS (SELECT k, p, fold, avg(sqrt(pow(sx/s-tx, 2)+pow(sy/s-ty, 2))) AS e FROM sw GROUP BY k, p, fold),
  grid AS (SELECT k, p, avg(e) AS cv_err FROM fe GROUP BY k, p)"""
_W = "1/(dist+1e-10)"


def _pct(err: str = "err") -> str:
    return f"""count(*) AS n, {q(f'avg({err})', 'mae')}, {q(f'sqrt(avg({err}*{err}))', 'rmse')}, {q(f'quantile_cont({err}, 0.5)', 'median')},
  {q(f'quantile_cont({err}, 0.9)', 'p90')}, {q(f'quantile_cont({err}, 0.95)', 'p95')}"""


_MM = f", {q('min(err)', 'min_err')}, {q('max(err)', 'max_err')}"
_MEMB = f"""{_NN}, pred AS (
    SELECT query_id, 'k1' AS method, sum({_W}*x)/sum({_W}) AS px, sum({_W}*y)/sum({_W}) AS py FROM nn WHERE rank <= 1 GROUP BY query_id
    UNION ALL SELECT query_id, 'k3', sum({_W}*x)/sum({_W}), sum({_W}*y)/sum({_W}) FROM nn WHERE rank <= 3 GROUP BY query_id
    UNION ALL SELECT query_id, 'k9', sum(x/(dist*dist+1e-10))/sum(1/(dist*dist+1e-10)), sum(y/(dist*dist+1e-10))/sum(1/(dist*dist+1e-10)) FROM nn WHERE rank <= 9 GROUP BY query_id
    UNION ALL SELECT query_id, 'k25', sum({_W}*x)/sum({_W}), sum({_W}*y)/sum({_W}) FROM nn WHERE rank <= 25 GROUP BY query_id),
  errs AS (SELECT pred.*, p.x, p.y, sqrt(pow(px-p.x, 2)+pow(py-p.y, 2)) AS err FROM pred JOIN points p ON p.id = query_id)"""
_TRSTAT = """ut AS (SELECT id, is_test, x, y, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM points),
  st AS (SELECT dim, avg(v) AS mu, stddev_pop(v) AS sd FROM ut WHERE NOT is_test GROUP BY dim)"""
_COARSE_SQL = f"co AS (SELECT query_id, sum({_W}*x)/sum({_W}) AS cx, sum({_W}*y)/sum({_W}) AS cy FROM nn WHERE rank <= 5 GROUP BY query_id)"


def _combo_sql() -> str:
    rows = []
    for n, e in AB.combinations().items():
        rows.append(f"('{n}', " + ", ".join("1" if g in e else "0" for g in AB.GROUPS) + ")")
    return ", ".join(rows)


_ABL = f"""{_TRSTAT}, sc AS (SELECT id, is_test, x, y, list((v-mu)/(CASE WHEN sd > 0 THEN sd ELSE 1 END) ORDER BY dim) AS vec FROM ut JOIN st USING (dim) GROUP BY id, is_test, x, y),
  pr AS (SELECT t.id AS query_id, t.x AS tx, t.y AS ty, c.id AS cand_id, c.x, c.y,
    {', '.join(f'pow(list_distance(t.vec[{1 + 8 * i}:{8 + 8 * i}], c.vec[{1 + 8 * i}:{8 + 8 * i}]), 2)/8 AS d{i}' for i in range(8))}
    FROM sc t JOIN sc c ON t.is_test AND NOT c.is_test),
  cb(combo, {', '.join(f'g{i}' for i in range(8))}) AS (VALUES {_combo_sql()}),
  nn AS (SELECT combo, query_id, tx, ty, x, y, sqrt({' + '.join(f'g{i}*d{i}' for i in range(8))}) AS dist,
    row_number() OVER (PARTITION BY combo, query_id ORDER BY {' + '.join(f'g{i}*d{i}' for i in range(8))}, cand_id) AS rank FROM pr CROSS JOIN cb),
  e AS (SELECT combo, query_id, sqrt(pow(sum({_W}*x)/sum({_W})-any_value(tx), 2)+pow(sum({_W}*y)/sum({_W})-any_value(ty), 2)) AS err
    FROM nn WHERE rank <= 5 GROUP BY combo, query_id),
  t AS (SELECT combo, avg(err) AS mae, sqrt(avg(err*err)) AS rmse, quantile_cont(err, 0.9) AS p90 FROM e GROUP BY combo)"""
_ABBR = ", ".join(f"CASE WHEN g{i} = 1 THEN '{s}' END" for i, (_, s) in enumerate(X.FEATURE_LABELS))


def _ranks(a: int, own: bool, tag: str = "") -> str:
    cond = "" if own else "WHERE i.id <> j.id"
    return f"""rk{tag} AS (SELECT i.id AS i, j.id AS j, list_distance(i.vec, j.vec) AS dh, list_distance(i.vec[{a + 1}:{a + 2}], j.vec[{a + 1}:{a + 2}]) AS dl,
    row_number() OVER (PARTITION BY i.id ORDER BY list_distance(i.vec, j.vec), j.id) AS rh,
    row_number() OVER (PARTITION BY i.id ORDER BY list_distance(i.vec[{a + 1}:{a + 2}], j.vec[{a + 1}:{a + 2}]), j.id) AS rl
  FROM points i CROSS JOIN points j {cond})"""


def _twct(tag: str = "") -> str:
    return f"""1 - 2.0::DOUBLE/(n*10*(2*n-3*10-1)) * coalesce(sum(CASE WHEN rl <= 10 AND rh > 10 THEN rh - 10 END), 0) AS tw,
      1 - 2.0::DOUBLE/(n*10*(2*n-3*10-1)) * coalesce(sum(CASE WHEN rh <= 10 AND rl > 10 THEN rl - 10 END), 0) AS ct"""


_STRESS = "sqrt(sum(CASE WHEN dh > 0 THEN (dh-dl)*(dh-dl) END)/sum(CASE WHEN dh > 0 THEN dh*dh END))"


def _winner_sql() -> str:
    parts, ctes = [], []
    for a in (0, 2, 4):
        ctes.append(_ranks(a, False, str(a)))
        parts.append(
            f"""SELECT 'dims{a}' AS method, {_twct()}, {_STRESS} AS ks,
            avg(CASE WHEN rl = 1 THEN sqrt(pow(pi.x-pj.x, 2)+pow(pi.y-pj.y, 2)) END) AS nnle
            FROM rk{a} JOIN points pi ON pi.id = i JOIN points pj ON pj.id = j CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM points) GROUP BY n"""
        )
    nrm = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-12)"
    return f"""WITH {PT}, {', '.join(ctes)}, s AS ({' UNION ALL '.join(parts)}),
      c AS (SELECT *, ({nrm('tw')} + {nrm('ct')} + (1 - {nrm('ks')})) / 3 AS combined FROM s)
      SELECT method, {qs('tw', 'ct', 'ks', 'nnle', 'combined')},
        CASE WHEN tw > 0.9 THEN 'good' WHEN tw > 0.8 THEN 'ok' ELSE 'poor' END AS tw_verdict,
        CASE WHEN ct > 0.9 THEN 'good' WHEN ct > 0.8 THEN 'ok' ELSE 'poor' END AS ct_verdict,
        CASE WHEN ks < 0.1 THEN 'good' WHEN ks < 0.2 THEN 'ok' ELSE 'poor' END AS ks_verdict,
        CAST(row_number() OVER (ORDER BY combined DESC, method) = 1 AS INTEGER) AS best_overall,
        CAST(tw = max(tw) OVER () AS INTEGER) AS best_tw, CAST(ct = max(ct) OVER () AS INTEGER) AS best_ct,
        CAST(ks = min(ks) OVER () AS INTEGER) AS best_ks, CAST(nnle = min(nnle) OVER () AS INTEGER) AS best_nnle FROM c"""


QUERIES = {
    f.__name__: f
    for f in (
        split_random, split_mod, split_checkerboard, split_block, column_stats, standardize, group_weights, grid_cells,
        cell_centroids, knn_topk, knn_cosine, knn_loo, accuracy_knn_class, wknn_predict, wknn_cv_grid, wknn_best,
        wknn_metrics, loo_k_sweep, localize_new, c2f_refine, c2f_cv_grid, ensemble_mean, ensemble_trimmed,
        ensemble_weights, error_metrics, path_percentiles, error_cdf, error_heatmap, pct_within, accuracy_labels,
        results_wide, ablation_table, ablation_ranked, delta_vs_baseline, intruder_ranks, trustworthiness, trustworthiness_doubled,
        kruskal_stress, nnle, nnle_idw, chart_winners, propagate, geographic_rgb, frobenius_nearest,
    )
}

_SHAPE = "shape AS (SELECT CAST(floor((max(x)+1.25)/5) AS INTEGER) + 1 AS nx, CAST(floor((max(y)+1.25)/5) AS INTEGER) + 1 AS ny FROM points)"
_CELL = "CAST(floor((x+1.25)/5) + nx*floor((y+1.25)/5) AS INTEGER)"

ORACLES = {
    "split_random": "SELECT vec_id AS id, CAST(CAST('0x' || substr(md5(vec_id::VARCHAR || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3 AS INTEGER) AS is_test FROM embeddings",
    "split_mod": f"WITH {PT} SELECT is_test, fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id FROM points GROUP BY is_test, fold",
    "split_checkerboard": f"WITH {PT} SELECT id, CAST((id % 25 + id // 25) % 2 AS INTEGER) AS is_test FROM points",
    "split_block": f"""WITH {PT}, c AS (SELECT quantile_cont(x + y, 0.7) AS cut FROM points)
        SELECT id, CAST(x + y >= cut AS INTEGER) AS is_test FROM points, c""",
    "column_stats": f"""WITH {PT}, u AS (SELECT unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM points)
        SELECT CAST(dim AS INTEGER) AS dim, {q('avg(v)', 'mean')}, {q('CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END', 'std')} FROM u GROUP BY dim""",
    "standardize": f"""WITH {PT}, {_TRSTAT} SELECT id, CAST(dim AS INTEGER) AS dim, {q('(v - mu) / (CASE WHEN sd > 0 THEN sd ELSE 1 END)', 'v')}
        FROM ut JOIN st USING (dim) WHERE is_test""",
    "group_weights": f"""WITH {PT}, u AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS d FROM points)
        SELECT id, {q('sum(CASE WHEN d < 32 THEN v*v/32 ELSE 0 END)', 'g0')}, {q('sum(CASE WHEN d >= 32 AND d < 48 THEN v*v/16 ELSE 0 END)', 'g1')},
          {q('sum(CASE WHEN d >= 48 AND d < 56 THEN v*v/8 ELSE 0 END)', 'g2')}, {q('sum(CASE WHEN d >= 56 THEN v*v ELSE 0 END)', 'tail')} FROM u GROUP BY id""",
    "grid_cells": f"""WITH {PT}, {_SHAPE} SELECT id, {_CELL} AS cell FROM points, shape""",
    "cell_centroids": f"""WITH {PT}, {_SHAPE}, c AS (SELECT {_CELL} AS cell, nx FROM points, shape)
        SELECT cell, count(*) AS n, {q('-1.25::DOUBLE + (cell % nx)*5.0::DOUBLE + 2.5', 'cx')}, {q('-1.25::DOUBLE + (cell // nx)*5.0::DOUBLE + 2.5', 'cy')} FROM c GROUP BY cell, nx""",
    "knn_topk": f"WITH {PT}, {_NN} SELECT query_id, rank, cand_id, {qs('dist')} FROM nn WHERE rank <= 5",
    "knn_cosine": f"""WITH {PT}, nn AS (SELECT t.id AS query_id, c.id AS cand_id, 1 - list_cosine_similarity(t.vec, c.vec) AS dist,
          CAST(row_number() OVER (PARTITION BY t.id ORDER BY 1 - list_cosine_similarity(t.vec, c.vec), c.id) AS INTEGER) AS rank
          FROM points t JOIN points c ON t.is_test AND NOT c.is_test)
        SELECT query_id, rank, cand_id, {qs('dist')} FROM nn WHERE rank <= 5""",
    "knn_loo": f"""WITH {PT}, nn AS (SELECT t.id AS query_id, c.id AS cand_id, list_distance(t.vec, c.vec) AS dist,
          CAST(row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS INTEGER) AS rank FROM points t JOIN points c ON t.id <> c.id)
        SELECT query_id, rank, cand_id, {qs('dist')} FROM nn WHERE rank <= 3""",
    "accuracy_knn_class": f"""WITH {PT}, {_NN} SELECT count(*) AS n, {q('avg(CASE WHEN t.label = c.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'accuracy')}
        FROM nn JOIN points t ON t.id = query_id JOIN points c ON c.id = cand_id WHERE rank = 1""",
    "wknn_predict": f"""WITH {PT}, {_NN} SELECT query_id, {q('sum(x/(dist*dist+1e-10))/sum(1/(dist*dist+1e-10))', 'px')},
          {q('sum(y/(dist*dist+1e-10))/sum(1/(dist*dist+1e-10))', 'py')} FROM nn WHERE rank <= 5 GROUP BY query_id""",
    "wknn_cv_grid": f"WITH {PT}, {_GRID25} SELECT k, {q('p', 'p')}, {qs('cv_err')} FROM grid",
    "wknn_best": f"WITH {PT}, {_GRID25} SELECT k, {q('p', 'p')}, {qs('cv_err')} FROM grid ORDER BY grid.cv_err, grid.k, grid.p LIMIT 1",
    "wknn_metrics": f"""WITH {PT}, {_GRID25}, best AS (SELECT k, p FROM grid ORDER BY cv_err, k, p LIMIT 1),
          n2 AS (SELECT t.id, t.x AS tx, t.y AS ty, c.x, c.y, list_distance(t.vec, c.vec) AS dist,
            row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS rank FROM points t JOIN points c ON t.is_test AND NOT c.is_test),
          e AS (SELECT id, sqrt(pow(sum(x/(pow(dist, best.p)+1e-10))/sum(1/(pow(dist, best.p)+1e-10)) - any_value(tx), 2)
            + pow(sum(y/(pow(dist, best.p)+1e-10))/sum(1/(pow(dist, best.p)+1e-10)) - any_value(ty), 2)) AS err FROM n2, best WHERE rank <= best.k GROUP BY id)
        SELECT 'WKNN (IDW)' AS method, {_pct()}{_MM} FROM e""",
    "loo_k_sweep": f"""WITH {PT}, u AS (SELECT id, x, y, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM points),
          st AS (SELECT dim, avg(v) AS mu, stddev_samp(v) AS sd FROM u GROUP BY dim),
          sc AS (SELECT id, x, y, list((v-mu)/(CASE WHEN sd > 0 THEN sd ELSE 1 END) ORDER BY dim) AS vec FROM u JOIN st USING (dim) GROUP BY id, x, y),
          nn AS (SELECT t.id, t.x AS tx, t.y AS ty, c.x, c.y, list_distance(t.vec, c.vec) AS dist,
            row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS rank FROM sc t JOIN sc c ON t.id <> c.id),
          e AS (SELECT CAST(k.k AS INTEGER) AS k, id, sqrt(pow(sum({_W}*x)/sum({_W})-any_value(tx), 2)+pow(sum({_W}*y)/sum({_W})-any_value(ty), 2)) AS err
            FROM nn JOIN (VALUES (1), (3), (5), (7), (9), (11), (15)) k(k) ON rank <= k.k GROUP BY k.k, id)
        SELECT k, {_pct()} FROM e GROUP BY k""",
    "localize_new": f"""WITH {PT}, u AS (SELECT id, x, y, is_test, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM points),
          st AS (SELECT dim, avg(v) AS mu, stddev_samp(v) AS sd FROM u WHERE NOT is_test GROUP BY dim),
          sc AS (SELECT id, x, y, is_test, list((v-mu)/(CASE WHEN sd > 0 THEN sd ELSE 1 END) ORDER BY dim) AS vec FROM u JOIN st USING (dim) GROUP BY id, x, y, is_test),
          nn AS (SELECT t.id AS query_id, c.x, c.y, list_distance(t.vec, c.vec) AS dist,
            row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS rank FROM sc t JOIN sc c ON t.is_test AND NOT c.is_test)
        SELECT query_id, {q(f'sum({_W}*x)/sum({_W})', 'px')}, {q(f'sum({_W}*y)/sum({_W})', 'py')} FROM nn WHERE rank <= 5 GROUP BY query_id""",
    "c2f_refine": f"""WITH {PT}, {_NN}, {_COARSE_SQL},
          pool AS (SELECT co.query_id, nn.x, nn.y, nn.dist, count(*) OVER (PARTITION BY co.query_id) AS n,
            row_number() OVER (PARTITION BY co.query_id ORDER BY nn.dist, nn.cand_id) AS r
            FROM co JOIN nn ON nn.query_id = co.query_id AND sqrt(pow(nn.x-cx, 2)+pow(nn.y-cy, 2)) <= 5),
          fi AS (SELECT query_id, any_value(n) AS n, sum(x/(dist*dist+1e-10))/sum(1/(dist*dist+1e-10)) AS fx, sum(y/(dist*dist+1e-10))/sum(1/(dist*dist+1e-10)) AS fy
            FROM pool WHERE r <= 3 GROUP BY query_id),
          o AS (SELECT co.query_id, coalesce(n, 0) < 3 AS fb, CASE WHEN coalesce(n, 0) < 3 THEN cx ELSE fx END AS px, CASE WHEN coalesce(n, 0) < 3 THEN cy ELSE fy END AS py
            FROM co LEFT JOIN fi USING (query_id))
        SELECT query_id, CAST(fb AS INTEGER) AS fallback, {qs('px', 'py')}, {q('sqrt(pow(px-p.x, 2)+pow(py-p.y, 2))', 'err')} FROM o JOIN points p ON p.id = query_id""",
    "c2f_cv_grid": f"""WITH {PT}, {_CV}, {_COARSE_SQL},
          rad(radius) AS (VALUES (3.0::DOUBLE), (5.0::DOUBLE), (7.5::DOUBLE), (10.0::DOUBLE), (15.0::DOUBLE)),
          pool AS (SELECT radius, nn.query_id, nn.x, nn.y, nn.dist, count(*) OVER (PARTITION BY radius, nn.query_id) AS n,
            row_number() OVER (PARTITION BY radius, nn.query_id ORDER BY nn.rank) AS r
            FROM nn JOIN co ON nn.query_id = co.query_id JOIN rad ON sqrt(pow(nn.x-cx, 2)+pow(nn.y-cy, 2)) <= radius),
          fi AS (SELECT radius, query_id, r AS k, p.p, n, sum(x/(pow(dist, p.p)+1e-10)) OVER w / sum(1/(pow(dist, p.p)+1e-10)) OVER w AS fx,
            sum(y/(pow(dist, p.p)+1e-10)) OVER w / sum(1/(pow(dist, p.p)+1e-10)) OVER w AS fy FROM pool
            CROSS JOIN (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) p(p) WHERE r <= 15 WINDOW w AS (PARTITION BY radius, query_id, p.p ORDER BY r)),
          base AS (SELECT radius, co.query_id, cx, cy, k.k, p.p, t.x AS tx, t.y AS ty, t.fold FROM co JOIN points t ON t.id = co.query_id CROSS JOIN rad
            CROSS JOIN range(1, 16) k(k) CROSS JOIN (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) p(p)),
          e AS (SELECT b.radius, b.k, b.p, b.fold, CASE WHEN coalesce(n, 0) >= greatest(3, b.k) THEN sqrt(pow(fx-tx, 2)+pow(fy-ty, 2)) ELSE sqrt(pow(cx-tx, 2)+pow(cy-ty, 2)) END AS err
            FROM base b LEFT JOIN fi f ON f.radius = b.radius AND f.query_id = b.query_id AND f.k = b.k AND f.p = b.p),
          fe AS (SELECT radius, k, p, fold, avg(err) AS m FROM e GROUP BY radius, k, p, fold)
        SELECT {q('radius', 'radius')}, CAST(k AS INTEGER) AS k, {q('p', 'p')}, {q('avg(m)', 'cv_err')} FROM fe GROUP BY fe.radius, fe.k, fe.p""",
    "ensemble_mean": f"""WITH {PT}, {_MEMB}, w(method, w) AS (VALUES ('k1', 1.0::DOUBLE), ('k3', 3.0::DOUBLE), ('k9', 2.0::DOUBLE), ('k25', 0.5::DOUBLE))
        SELECT query_id, {q('sum(w*px)/sum(w)', 'px')}, {q('sum(w*py)/sum(w)', 'py')} FROM pred JOIN w USING (method) GROUP BY query_id""",
    "ensemble_trimmed": f"""WITH {PT}, {_MEMB} SELECT query_id, {q('(sum(px)-min(px)-max(px))/2', 'px')}, {q('(sum(py)-min(py)-max(py))/2', 'py')} FROM pred GROUP BY query_id""",
    "ensemble_weights": f"WITH {PT}, {_MEMB} SELECT method, {q('1/greatest(avg(err), 1e-6)', 'weight')} FROM errs GROUP BY method",
    "error_metrics": f"WITH {PT}, {_MEMB} SELECT method, {_pct()}{_MM} FROM errs GROUP BY method",
    "path_percentiles": f"WITH {C.LINEITEM_SQL}, e AS (SELECT tx_id, amp * 1e6 AS err FROM paths) SELECT tx_id, {_pct()} FROM e GROUP BY tx_id",
    "error_cdf": f"""WITH {PT}, {_MEMB}, e AS (SELECT method, {q('err', 'err')} FROM errs), c AS (SELECT method, err, count(*) AS n_tied FROM e GROUP BY method, err)
        SELECT method, {q('err', 'err')}, n_tied, {q('sum(n_tied) OVER (PARTITION BY method ORDER BY c.err) / sum(n_tied) OVER (PARTITION BY method)', 'cdf')} FROM c""",
    "error_heatmap": f"""WITH {PT}, {_MEMB}, {_SHAPE}, c AS (SELECT method, CAST(floor((x+1.25)/5) AS INTEGER) AS xi, CAST(floor((y+1.25)/5) AS INTEGER) AS yi,
          avg(err) AS m, count(*) AS n FROM errs GROUP BY 1, 2, 3), g AS (SELECT DISTINCT method, CAST(a.a AS INTEGER) AS xi, CAST(b.b AS INTEGER) AS yi FROM errs, (SELECT unnest(range(nx)) AS a FROM shape) a, (SELECT unnest(range(ny)) AS b FROM shape) b)
        SELECT method, xi, yi, {q('m', 'mean_err')}, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (method, xi, yi)""",
    "pct_within": f"WITH {PT}, {_MEMB}, e AS (SELECT method, {q('err', 'err')} FROM errs) SELECT method, {', '.join(q(f'avg(CASE WHEN err <= {t} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)', f'within_{t}') for t in (5, 10, 20, 40))} FROM e GROUP BY method",
    "accuracy_labels": f"""WITH {PT}, {_MEMB}, m AS (SELECT method, avg(err) AS mae FROM errs GROUP BY method)
        SELECT method, CASE {' '.join(f"WHEN mae < {b} THEN '{t}'" for b, t in X.ACCURACY_BANDS)} ELSE concat(CAST(CAST(round_even(mae, 0) AS BIGINT) AS VARCHAR), ' m — neighbourhood level') END AS label,
          CASE {' '.join(f"WHEN mae < {b} THEN '{t}'" for b, t in X.VERDICT_BANDS)} ELSE '{X.COARSE_VERDICT}' END AS verdict FROM m""",
    "results_wide": f"""WITH {PT}, {_MEMB} SELECT query_id AS rx_id, {', '.join(q(f"max(CASE WHEN method = '{m}' THEN {c} END)", f'{m}_{n}')
          for m in ('k1', 'k3', 'k9', 'k25') for c, n in (('px', 'Pred_X'), ('py', 'Pred_Y'), ('err', 'Error')))} FROM errs GROUP BY query_id""",
    "ablation_table": f"""WITH {PT}, {_ABL} SELECT combo, 8*({' + '.join(f'g{i}' for i in range(8))}) AS n_feat, concat_ws('+', {_ABBR}) AS feat_abbrev,
          {q('mae', 'wknn_mae')}, {q('rmse', 'wknn_rmse')}, {q('p90', 'wknn_p90')}, {q('mae', 'best_mae')}, 'WKNN (IDW)' AS best_method FROM t JOIN cb USING (combo)""",
    "ablation_ranked": f"""WITH {PT}, {_ABL} SELECT combo, {q('mae', 'wknn_mae')}, CAST(row_number() OVER (ORDER BY {q('mae')}, combo) AS INTEGER) AS place FROM t JOIN cb USING (combo)""",
    "delta_vs_baseline": f"""WITH {PT}, {_ABL} SELECT combo, {q('mae', 'best_mae')}, {q("mae - (SELECT mae FROM t WHERE combo = 'ALL')", 'delta')} FROM t WHERE combo <> 'ALL'""",
    "intruder_ranks": f"WITH {PT}, {_ranks(0, False)} SELECT i AS query_id, j AS cand_id, rh AS rank FROM rk WHERE rl <= 10 AND rh > 10",
    "trustworthiness": f"""WITH {PT}, {_ranks(0, False)}, s AS (SELECT n, {_twct()} FROM rk CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM points) GROUP BY n)
        SELECT CAST(n AS BIGINT) AS n, 10 AS k, {qs('tw', 'ct')} FROM s""",
    "trustworthiness_doubled": f"""WITH {PT}, {_ranks(0, True)}, s AS (SELECT n,
          1 - 4.0::DOUBLE/(n*10*(2*n-31)) * coalesce(sum(CASE WHEN rl <= 10 AND rh > 10 THEN CASE WHEN rh = n THEN 0 ELSE rh END - 10 END), 0) AS tw,
          1 - 4.0::DOUBLE/(n*10*(2*n-31)) * coalesce(sum(CASE WHEN rh <= 10 AND rl > 10 THEN CASE WHEN rl = n THEN 0 ELSE rl END - 10 END), 0) AS ct
          FROM rk CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM points) GROUP BY n) SELECT CAST(n AS BIGINT) AS n, 10 AS k, {qs('tw', 'ct')} FROM s""",
    "kruskal_stress": f"WITH {PT}, {_ranks(0, False)} SELECT {q(_STRESS, 'stress')} FROM rk",
    "nnle": f"""WITH {PT}, {_ranks(0, False)} SELECT {q('avg(sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)))', 'nnle')} FROM rk JOIN points a ON a.id = i JOIN points b ON b.id = j WHERE rl = 1""",
    "nnle_idw": f"""WITH {PT}, {_ranks(0, False)}, e AS (SELECT i, sqrt(pow(sum(b.x/(dl+1e-10))/sum(1/(dl+1e-10))-any_value(a.x), 2)+pow(sum(b.y/(dl+1e-10))/sum(1/(dl+1e-10))-any_value(a.y), 2)) AS err
          FROM rk JOIN points a ON a.id = i JOIN points b ON b.id = j WHERE rl <= 5 GROUP BY i) SELECT {q('avg(err)', 'nnle_idw')} FROM e""",
    "chart_winners": _winner_sql(),
    "propagate": f"""WITH {PT}, nn AS (SELECT t.id AS query_id, c.id AS cand_id, list_distance(t.vec, c.vec) AS dist,
          row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS rank FROM points t JOIN points c ON NOT c.is_test) SELECT query_id AS id, {q(f'sum({_W}*c.vec[1])/sum({_W})', 'z1')}, {q(f'sum({_W}*c.vec[2])/sum({_W})', 'z2')}
        FROM nn JOIN points c ON c.id = cand_id WHERE rank <= 5 GROUP BY query_id""",
    "geographic_rgb": f"""WITH {PT}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points)
        SELECT id, {q('(x-x0)/(x1-x0)', 'r')}, {q('(y-y0)/(y1-y0)', 'g')}, {q('0.4::DOUBLE', 'b')} FROM points, b""",
    "frobenius_nearest": f"""WITH {PT}, nn AS (SELECT t.id AS query_id, c.id AS cand_id, list_distance(t.vec, c.vec) AS dist,
          CAST(row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.vec, c.vec), c.id) AS INTEGER) AS rank FROM points t JOIN points c ON t.id <> c.id)
        SELECT query_id, rank, cand_id, {qs('dist')} FROM nn WHERE rank = 1""",
}
