"""Positioning: splits, scaling, weighted kNN, coarse-to-fine refinement and ensembles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators import blocks as B
from pathloom.operators.evaluate import exact_percentiles
from pathloom.operators.knn import BLOCK_ROWS, LOCAL_BYTES, LOCAL_ROWS, knn_join
from pathloom.operators.skew import salted_lookup
from pathloom.session import fresh, materialize, spread

# fixed hyper-parameter grids
WKNN_K = list(range(1, 26))
C2F_K = list(range(1, 16))
POWERS = [1.0, 2.0, 3.0]
RADII = [3.0, 5.0, 7.5, 10.0, 15.0]
LOO_K = [1, 3, 5, 7, 9, 11, 15]
CV_FOLDS = 5
WIDE_AXES = 256  # columns from which on the covariance is summed and decomposed in NumPy
AXES_PIECE = 64  # rows of that covariance in one piece


# ---------------------------------------------------------------- splits
def split_random(df: DataFrame, test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Pseudo-random row-wise split: a seeded id hash (the first 32 bits of an MD5) below the fraction is test.

    Deterministic per id, so it needs no sort, no shuffle and no shared state.
    """
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("is_test", u < test_fraction)


def split_checkerboard(df: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    return df.withColumn("is_test", X.checkerboard_parity(F.col("x"), F.col("y"), x0, y0, step) == 1)


def split_block(df: DataFrame, test_fraction: float = 0.3) -> DataFrame:
    """Hold out the top-right corner: x + y at or above its (1 - fraction) percentile."""
    diag = df.select((F.col("x") + F.col("y")).alias("diag"))
    cut = exact_percentiles(diag, [], "diag", [1.0 - test_fraction]).select("pct").first()["pct"]
    return df.withColumn("is_test", (F.col("x") + F.col("y")) >= F.lit(cut))


# ---------------------------------------------------------------- scaling
def column_stats(df: DataFrame, vec: str = "vec", ddof: int = 0) -> DataFrame:
    """One row: per-column mean and std of an array column (zero std read as 1).

    The summary merges partial moments of whole vectors, so nothing is exploded.
    """
    s = df.select(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(vec)).alias("s")
    ).select(
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("var"),
        F.col("s.count").alias("n"),
    )
    scale = F.lit(1.0) if ddof == 1 else (F.col("n") - 1) / F.col("n")
    return s.select(
        "mean", F.transform("var", lambda v: F.when(v > 0, F.sqrt(v * scale)).otherwise(1.0)).alias("std")
    )


def standardize(df: DataFrame, fit_on: DataFrame | None = None, vec: str = "vec", ddof: int = 0) -> DataFrame:
    """(v - mean) / std per column, with statistics of ``fit_on`` (default: all rows)."""
    # one row as wide as the feature vector
    s = column_stats(fit_on if fit_on is not None else df, vec, ddof).first()
    mean, std = F.lit(list(s["mean"])), F.lit(list(s["std"]))
    scaled = F.transform(vec, lambda v, i: (v - F.get(mean, i)) / F.get(std, i))
    return df.withColumn(vec, scaled)


def group_weights(sizes: list[int]) -> list[float]:
    """1 / sqrt(group width) for every column of every group."""
    return [1.0 / float(np.sqrt(n)) for n in sizes for _ in range(n)]


def apply_group_weights(df: DataFrame, sizes: list[int], vec: str = "vec") -> DataFrame:
    """Weight the columns group by group; columns beyond the listed groups keep weight 1."""
    w = F.lit(group_weights(sizes))
    return df.withColumn(vec, F.transform(vec, lambda v, i: v * F.coalesce(F.get(w, i), F.lit(1.0))))


def covariance_of(df: DataFrame, mean: np.ndarray, vec: str = "vec") -> np.ndarray:
    """Sample covariance of the columns. Each task multiplies its rows as a matrix and returns one sum, in pieces; there are as
    many tasks as cores, so what moves is set by the width and the cores and not by the rows."""
    width = len(mean)
    shared = df.sparkSession.sparkContext.broadcast(mean)

    def run(batches):
        gram, n = np.zeros((width, width)), 0
        for b in batches:
            if b["vec"].null_count:
                raise ValueError("a row without a vector")
            x = B.matrix(b["vec"]) - shared.value if b.num_rows else np.zeros((0, width))
            gram += x.T @ x
            n += len(x)
        if n:
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            for s in range(0, width, AXES_PIECE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), part, pa.array([n], pa.int64()), pa.array([gram[s : s + AXES_PIECE].tobytes()], pa.binary())],
                    names=["start", "part", "n", "g"],
                )

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = np.zeros(len(B.unpack(t["g"][0])))
        for g in t["g"]:
            total += B.unpack(g)
        return pa.table({"start": t["start"][:1], "part": t["part"][:1], "n": [sum(t["n"].to_pylist())], "g": pa.array([total.tobytes()], pa.binary())})

    ddl = "start int, part int, n bigint, g binary"
    rows = df.select(F.col(vec).alias("vec")).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    got = rows.mapInArrow(run, ddl).groupBy("start").applyInArrow(add, ddl).toArrow().sort_by("start")  # as wide as the vector
    n = got["n"][0].as_py() if got.num_rows else 0
    if n < 2:
        raise ValueError("principal axes need two rows")
    return np.concatenate([B.unpack(g) for g in got["g"]]).reshape(width, width) / (n - 1)


def pca_fit(df: DataFrame, n_comp: int, vec: str = "vec"):
    """Principal axes of centred rows: (mean, axes [D x n_comp], variances).

    The Gram matrix is summed across tasks; its size is set by the feature width.
    """
    mean = column_stats(df, vec).first()["mean"]
    if len(mean) > WIDE_AXES:
        cov = covariance_of(df, np.array(mean), vec)
        axes, var, _ = np.linalg.svd(cov)
        total = float(np.trace(cov))
        return np.array(mean), axes[:, :n_comp], var[:n_comp] / var.sum() * total, total
    centred = df.select(
        array_to_vector(F.transform(vec, lambda v, i: v - F.get(F.lit(list(mean)), i))).alias("v")
    )
    total = centred.select(Summarizer.variance(F.col("v")).alias("var")).first()["var"].toArray().sum()
    model = PCA(k=n_comp, inputCol="v", outputCol="p").fit(centred)
    return np.array(mean), model.pc.toArray(), model.explainedVariance.toArray() * total, total


def pca_project(df: DataFrame, mean, axes, vec: str = "vec", out: str = "vec", scale=None) -> DataFrame:
    """Project rows on the axes (optionally divided by the per-axis std: whitening)."""
    a = axes if scale is None else axes / scale[None, :]
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(mean), a))

    @F.pandas_udf("array<double>")
    def project(v):
        m, ax = shared.value
        return v.__class__(list((np.stack(v) - m) @ ax)) if len(v) else v

    return df.withColumn(out, project(vec))


def pca_whiten(df: DataFrame, fit_on: DataFrame, variance: float = 0.95) -> DataFrame:
    """Whitened principal components holding a share (<= 1) of the variance or a fixed count (> 1)."""
    width = fit_on.select(F.size("vec")).first()[0]
    if variance > 1:
        n = int(variance)
        mean, axes, var, _ = pca_fit(fit_on, n)
    else:
        mean, axes, var, total = pca_fit(fit_on, width)
        n = int(np.searchsorted(np.cumsum(var) / total, variance) + 1)
    return pca_project(df, mean, axes[:, :n], scale=np.sqrt(np.maximum(var[:n], 1e-300)))


# ---------------------------------------------------------------- weighted kNN
def idw_predict(nb: DataFrame, k: int, power: float = 1.0) -> DataFrame:
    """Inverse-distance-weighted position from neighbours(query_id, rank, dist, x, y)."""
    w = X.idw_weight(F.col("dist"), F.lit(float(power)))
    return (
        nb.filter(F.col("rank") <= k)
        .groupBy("query_id")
        .agg((F.sum(w * F.col("x")) / F.sum(w)).alias("px"), (F.sum(w * F.col("y")) / F.sum(w)).alias("py"))
    )


def idw_sweep(nb: DataFrame, powers: list[float] = POWERS) -> DataFrame:
    """Predictions for every k up to the neighbour count and every power, from one neighbour list.

    Prefix sums over the rank replace one neighbour search per k; a window holds at most
    k_max rows of one query.
    """
    p = nb.withColumn("p", F.explode(F.lit([float(v) for v in powers])))
    p = p.withColumn("w", X.idw_weight(F.col("dist"), F.col("p")))
    w = W.partitionBy("query_id", "p").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sw = F.sum("w").over(w)
    return p.select(
        "query_id",
        F.col("rank").alias("k"),
        "p",
        (F.sum(F.col("w") * F.col("x")).over(w) / sw).alias("px"),
        (F.sum(F.col("w") * F.col("y")).over(w) / sw).alias("py"),
    )


def with_error(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach true positions (one row per id) and the Euclidean error."""
    t = truth.select(F.col("id").alias("query_id"), "x", "y", *(["fold"] if "fold" in truth.columns else []))
    return pred.join(t, "query_id").withColumn(
        "err", X.euclid2(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    )


def wknn_cv_grid(train: DataFrame, k_max: int = 25, powers: list[float] = POWERS, **knn) -> DataFrame:
    """Mean over folds of the mean error for every (k, power), from one search at k_max."""
    nb = knn_join(train, train, k_max, use_folds=True, carry=("x", "y"), **knn)
    e = with_error(idw_sweep(nb, powers), train)
    per_fold = e.groupBy("k", "p", "fold").agg(F.avg("err").alias("fold_err"))
    return per_fold.groupBy("k", "p").agg(F.avg("fold_err").alias("cv_err"))


def best_params(grid: DataFrame, *params: str) -> DataFrame:
    """Row with the least CV error; ties go to the earlier parameters."""
    return grid.orderBy("cv_err", *params).limit(1)


def wknn(train: DataFrame, test: DataFrame, grid: DataFrame | None = None, **knn) -> DataFrame:
    """Cross-validated wKNN: predictions of ``test`` at the best (k, power)."""
    grid = wknn_cv_grid(train, **knn) if grid is None else grid
    best = best_params(grid, "k", "p").first()  # one row of hyper-parameters
    nb = knn_join(test, train, int(best["k"]), carry=("x", "y"), **knn)
    return with_error(idw_predict(nb, int(best["k"]), best["p"]), test).withColumn("method", F.lit("WKNN (IDW)"))


def loo_sweep(points: DataFrame, ks: list[int] = LOO_K, metric: str = "euclidean") -> DataFrame:
    """Leave-one-out errors for a list of K, from one search at the largest."""
    nb = knn_join(points, points, max(ks), exclude_self=True, metric=metric, carry=("x", "y"))
    sweep = idw_sweep(nb, [1.0]).filter(F.col("k").isin(*ks))
    return with_error(sweep, points)


def localize_new(measured: DataFrame, database: DataFrame, k: int, power: float = 1.0) -> DataFrame:
    """Position of new measurements: scale with the database statistics, search, weight."""
    q = standardize(measured.select("id", "vec"), database, ddof=1)
    db = standardize(database, ddof=1)
    return idw_predict(knn_join(q, db, k, carry=("x", "y")), k, power)


# ---------------------------------------------------------------- coarse to fine
_POOL = "radius double, query_id bigint, pool bigint, cand_id bigint, dist double, x double, y double"
_POOL_NAMES = ["radius", "query_id", "pool", "cand_id", "dist", "x", "y"]


def _pool_topk(lt: dict, rt: dict, radius: float, k: int) -> pa.Table:
    """Candidates within ``radius`` of each query's coarse position: their number and k nearest in features."""
    near = np.hypot(lt["cx"][:, None] - rt["x"][None, :], lt["cy"][:, None] - rt["y"][None, :])
    ok = (near <= radius) & (lt["fold"][:, None] != rt["fold"][None, :])
    rows, at, d = B.topk(lt["vec"], rt["vec"], rt["id"], k, lambda s: ok[s])
    # the pool size rides on the first row of each query
    pool = ok.sum(axis=1)
    lead = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    return pa.Table.from_arrays(
        [
            pa.array(np.full(len(rows), radius)),
            pa.array(lt["id"][rows]),
            pa.array(np.where(lead, pool[rows], 0).astype(np.int64)),
            pa.array(rt["id"][at]),
            pa.array(d),
            pa.array(rt["x"][at]),
            pa.array(rt["y"][at]),
        ],
        names=_POOL_NAMES,
    )


def _columns(t, *names: str) -> dict:
    out = {n: B.vector(t[n]) for n in names}
    out["vec"], out["id"], out["fold"] = B.matrix(t["vec"]), B.vector(t["id"], np.int64), B.vector(t["fold"], np.int64)
    return out


def radius_topk(
    queries: DataFrame,
    cands: DataFrame,
    radii: list[float],
    k: int,
    block_rows: int = BLOCK_ROWS,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """(radius, query_id, pool, nb): candidates within each radius of (cx, cy), and the k of them
    nearest in features.

    ``queries(id, vec, cx, cy, fold)``, ``cands(id, vec, x, y, fold)``; a query with an empty
    pool is absent. Large candidate sets are joined on a grid of cells one radius wide (a query
    looks at 3 x 3 of them); crowded cells are cut into bounded blocks on both sides.
    """
    q = queries.select("id", "vec", "cx", "cy", "fold")
    c = cands.select("id", "vec", "x", "y", "fold")
    width = c.limit(1).select(F.size("vec")).first()[0]
    cap = min(local_rows, LOCAL_BYTES // (8 * max(width, 1)))
    small = c.limit(cap + 1).toArrow() if cap else None
    if small is not None and small.num_rows <= cap:
        shared = q.sparkSession.sparkContext.broadcast(_columns(small, "x", "y"))

        def stream(batches):
            for b in batches:
                if b.num_rows:
                    cols = _columns(b, "cx", "cy")
                    for r in radii:
                        yield from _pool_topk(cols, shared.value, r, k).to_batches()

        parts = spread(q).mapInArrow(stream, _POOL)
    else:
        rows = min(block_rows, max(LOCAL_BYTES // (8 * max(width, 1)), 1))
        parts = None
        for r in radii:
            one = _grid_pools(q, c, r, k, rows)
            parts = one if parts is None else parts.unionByName(one)
    entry = F.struct("dist", "cand_id", "x", "y")
    # k rows per visited block of a query
    return parts.groupBy("radius", "query_id").agg(
        F.sum("pool").alias("pool"), F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("nb")
    )


def _grid_pools(q: DataFrame, c: DataFrame, radius: float, k: int, rows: int) -> DataFrame:
    c = c.withColumn("gx", F.floor(F.col("x") / radius)).withColumn("gy", F.floor(F.col("y") / radius))
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = (
        q.withColumn("o", F.explode(off))
        .withColumn("gx", F.floor(F.col("cx") / radius) + F.col("o.i"))
        .withColumn("gy", F.floor(F.col("cy") / radius) + F.col("o.j"))
        .drop("o")
    )
    cell = ["gx", "gy"]
    sizes = materialize(
        c.groupBy(*cell)
        .agg(F.count("*").alias("nc"))
        .join(q.groupBy(*cell).agg(F.count("*").alias("nq")), cell)
        .withColumn("subs", F.ceil(F.col("nc") / rows).cast("int"))
        .withColumn("chunks", F.ceil(F.col("nq") / rows).cast("int"))
    )
    qn = sizes.select(*cell, "subs", "chunks", F.col("nq").alias("n"))
    cn = sizes.select(*cell, "subs", "chunks", F.col("nc").alias("n"))
    q = (
        salted_lookup(q, qn, cell, "id", rows)
        .withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    )
    c = (
        salted_lookup(c, cn, cell, "id", rows)
        .withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    keys = [*cell, "sub", "chunk"]

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if not lt.num_rows or not rt.num_rows:
            kinds = [pa.float64()] + [pa.int64()] * 3 + [pa.float64()] * 3
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=_POOL_NAMES)
        return _pool_topk(_columns(lt, "cx", "cy"), _columns(rt, "x", "y"), radius, k)

    return fresh(q).groupBy(*keys).cogroup(fresh(c).groupBy(*keys)).applyInArrow(run, _POOL)


def _idw_of(nb, k, p, axis: str):
    w = F.transform(F.slice(nb, 1, k), lambda e: F.struct(X.idw_weight(e["dist"], p).alias("w"), e[axis].alias("v")))
    total = F.aggregate(w, F.lit(0.0), lambda a, e: a + e["w"])
    return F.aggregate(w, F.lit(0.0), lambda a, e: a + e["w"] * e["v"]) / total


def refine(
    queries: DataFrame, pools: DataFrame, radii: list[float], ks: list[int], powers: list[float], min_candidates: int = 3
) -> DataFrame:
    """Refined predictions for every (radius, k, power); the coarse estimate where the pool is too small."""
    base = queries.select(
        F.col("id").alias("query_id"), "cx", "cy", F.explode(F.lit([float(r) for r in radii])).alias("radius")
    )
    j = base.join(pools, ["radius", "query_id"], "left")
    g = j.withColumn("k", F.explode(F.lit(ks))).withColumn("p", F.explode(F.lit([float(v) for v in powers])))
    fine = F.coalesce(F.col("pool"), F.lit(0)) >= F.greatest(F.lit(min_candidates), F.col("k"))
    return g.select(
        "radius",
        "query_id",
        "k",
        "p",
        (~fine).alias("fallback"),
        F.when(fine, _idw_of(F.col("nb"), F.col("k"), F.col("p"), "x")).otherwise(F.col("cx")).alias("px"),
        F.when(fine, _idw_of(F.col("nb"), F.col("k"), F.col("p"), "y")).otherwise(F.col("cy")).alias("py"),
    )


def coarse_oof(train: DataFrame, k: int, power: float) -> DataFrame:
    """Leak-free coarse positions of training rows: neighbours from the other folds only."""
    nb = knn_join(train, train, k, use_folds=True, carry=("x", "y"))
    pred = idw_predict(nb, k, power).select(F.col("query_id").alias("id"), F.col("px").alias("cx"), F.col("py").alias("cy"))
    return train.join(pred, "id")


def c2f_cv_grid(
    train: DataFrame, coarse_k: int, coarse_p: float, radii=RADII, ks=C2F_K, powers=POWERS, min_candidates: int = 3
) -> DataFrame:
    """Mean over folds of the refined error for every (radius, k, power)."""
    q = materialize(coarse_oof(train, coarse_k, coarse_p))
    pools = radius_topk(q, train, list(radii), max(ks))
    out = with_error(refine(q, pools, list(radii), ks, powers, min_candidates), train)
    per_fold = out.groupBy("radius", "k", "p", "fold").agg(F.avg("err").alias("fold_err"))
    return per_fold.groupBy("radius", "k", "p").agg(F.avg("fold_err").alias("cv_err"))


def c2f(
    train: DataFrame, test: DataFrame, coarse_k: int, coarse_p: float, radius: float, k: int, power: float, min_candidates: int = 3
) -> DataFrame:
    """Coarse wKNN on all rows, then kNN among training rows near the coarse estimate."""
    coarse = idw_predict(knn_join(test, train, coarse_k, carry=("x", "y")), coarse_k, coarse_p)
    q = materialize(
        test.join(coarse.select(F.col("query_id").alias("id"), F.col("px").alias("cx"), F.col("py").alias("cy")), "id")
        .withColumn("fold", F.lit(-1))
    )
    pools = radius_topk(q, train.withColumn("fold", F.lit(-2)), [radius], k)
    return with_error(refine(q, pools, [radius], [k], [power], min_candidates), test.drop("fold")).withColumn(
        "method", F.lit("WKNN C2F")
    )


# ---------------------------------------------------------------- ensembles
def ensemble_mean(pred: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean position per receiver over methods (uniform weights by default)."""
    if weights is not None:
        if not weights:
            raise ValueError("an ensemble needs at least one member")
        if any(v < 0 for v in weights.values()):
            raise ValueError("ensemble weights must not be negative")
        w = F.coalesce(*[F.when(F.col("method") == m, F.lit(float(v))) for m, v in weights.items()])
        pred = pred.withColumn("_w", w).filter(F.col("_w").isNotNull())
    else:
        pred = pred.withColumn("_w", F.lit(1.0))
    s = F.sum("_w")
    return pred.groupBy("query_id").agg(
        (F.sum(F.col("_w") * F.col("px")) / s).alias("px"), (F.sum(F.col("_w") * F.col("py")) / s).alias("py")
    )


def ensemble_trimmed(pred: DataFrame, trim: float) -> DataFrame:
    """Unweighted mean per axis after dropping floor(trim * members) values at either end."""
    if not 0.0 < trim < 0.5:
        raise ValueError("trim must lie in (0, 0.5)")
    # one value per method: as short as the member list
    g = pred.groupBy("query_id").agg(
        F.sort_array(F.collect_list("px")).alias("xs"), F.sort_array(F.collect_list("py")).alias("ys")
    )
    cut = F.floor(F.size("xs") * F.lit(trim)).cast("int")

    def mean(a: str):
        kept = F.slice(a, cut + 1, F.size(a) - cut * 2)
        return F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept)

    return g.select("query_id", mean("xs").alias("px"), mean("ys").alias("py"))


def inverse_mae_weights(metrics: DataFrame) -> DataFrame:
    return metrics.select("method", (F.lit(1.0) / F.greatest(F.col("mae"), F.lit(1e-6))).alias("weight"))
