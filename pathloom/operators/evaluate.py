"""Error evaluation: exact percentiles and CDFs without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.session import materialize

MAX_GROUPS = 10_000  # group labels that may be broadcast
ROWS_PER_RANGE = 1_000_000  # rows of a range that one task sorts


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a materialised per-group table only if it is in fact short."""
    return F.broadcast(df) if df.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else df


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` up to and with each row, by ``order`` within ``keys``; equal orders must not repeat.

    Rows are cut into ranges, as many as the row count asks for; a running sum inside a range is completed
    by the totals of the ranges before it, so a key of any size spreads over many tasks.
    """
    rows = materialize(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    cut = materialize(rows.repartitionByRange(parts, *keys, order).withColumn("_k", F.spark_partition_id()))
    per = cut.groupBy(*keys, "_k").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(*keys, "_k", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_k").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.withColumn("_in", F.sum(value).over(inside))
        .join(offsets, [*keys, "_k"])
        .select(*df.columns, (F.col("_off") + F.col("_in")).alias(name))
    )


def exact_percentiles(
    df: DataFrame, groups: list[str], value: str, probs: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Exact linearly interpolated percentiles: (groups, i, pct), ``i`` indexes ``probs``.

    A mergeable quantile sketch brackets every wanted rank. One more pass counts the rows
    below each bracket (they collapse map-side) and the values inside it (a few rows in ten
    thousand); only those few are sorted. A bracket that misses its rank raises an error.
    """
    margin = 4.0 / accuracy
    bounds = [b for p in probs for b in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = materialize(
        df.groupBy(*groups).agg(
            F.count(value).alias("_n"),
            F.percentile_approx(value, [float(b) for b in bounds], accuracy).alias("_b"),
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
        )
    )
    # a group of a few thousand rows is its own bracket
    whole = F.col("_n") * margin < 3.0
    targets = sketch.select(
        *groups,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        F.when(whole, F.col("_lo")).otherwise(F.col("_b")[2 * i]).alias("lo"),
                        F.when(whole, F.col("_hi")).otherwise(F.col("_b")[2 * i + 1]).alias("hi"),
                        ((F.col("_n") - 1) * F.lit(float(p))).alias("r"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ).alias("t"),
    ).select(*groups, "t.*")
    wide = targets.groupBy(*groups).agg(F.collect_list(F.struct("i", "lo", "hi")).alias("_t"))
    wide = materialize(wide)
    d = df.select(*groups, F.col(value).alias("_v"))
    rows = d.join(_small(wide), groups) if groups else d.withColumn("_t", wide.select("_t").scalar())
    counts = (
        rows.select(*groups, "_v", F.explode("_t").alias("t"))
        .filter(F.col("_v") <= F.col("t.hi"))
        .select(*groups, F.col("t.i").alias("i"), F.when(F.col("_v") >= F.col("t.lo"), F.col("_v")).alias("v"))
        .groupBy(*groups, "i", "v")
        .agg(F.count("*").alias("c"))
    )
    cum = running_sum(counts, [*groups, "i"], "v", "c", "cum")
    cum = cum.join(targets.select(*groups, "i", "r"), [*groups, "i"])
    lo_rank = F.floor("r")
    picked = cum.groupBy(*groups, "i").agg(
        F.first("r").alias("r"),
        F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("cum"))), F.lit(0)).alias("below"),
        F.min(F.when(F.col("cum") > lo_rank, F.col("v"))).alias("a"),
        F.min(F.when(F.col("cum") > F.ceil("r"), F.col("v"))).alias("b"),
    )
    missed = (F.col("below") > lo_rank) | F.col("a").isNull() | F.col("b").isNull()
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - lo_rank)
    return picked.select(
        *groups,
        "i",
        F.when(missed, F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"))
        .otherwise(value_at)
        .alias("pct"),
    )


def error_metrics(pred: DataFrame, *groups: str, err: str = "err") -> DataFrame:
    """n, MAE, RMSE, median, P90, P95, min and max per group. ``pred`` is read three times:
    pass a table or a materialised frame."""
    base = pred.groupBy(*groups).agg(
        F.count(err).alias("n"),
        F.avg(err).alias("mae"),
        F.sqrt(F.avg(F.col(err) * F.col(err))).alias("rmse"),
        F.min(err).alias("min_err"),
        F.max(err).alias("max_err"),
    )
    names = ["median", "p90", "p95"]
    pct = exact_percentiles(pred, list(groups), err, [0.5, 0.9, 0.95])
    wide = pct.groupBy(*groups).agg(*[F.max(F.when(F.col("i") == i, F.col("pct"))).alias(n) for i, n in enumerate(names)])
    return base.join(wide, list(groups))


def error_cdf(pred: DataFrame, *groups: str, err: str = "err") -> DataFrame:
    """Empirical CDF: one row per distinct error with its multiplicity and cumulative share.

    No window covers a whole group: see ``running_sum``.
    """
    g = list(groups)
    counts = pred.groupBy(*g, F.col(err).alias("err")).agg(F.count("*").alias("n_tied"))
    running = running_sum(counts, g, "err", "n_tied", "_c")
    totals = running.groupBy(*g).agg(F.max("_c").alias("_n"))
    placed = running.join(totals, g) if g else running.crossJoin(F.broadcast(totals))
    return placed.select(*g, "err", "n_tied", (F.col("_c") / F.col("_n")).alias("cdf"))


def percent_within(pred: DataFrame, limits: list[float], *groups: str) -> DataFrame:
    return pred.groupBy(*groups).agg(
        *[(F.avg((F.col("err") <= t).cast("int")) * 100.0).alias(f"within_{t:g}".replace(".", "_")) for t in limits]
    )


def grid_shape(points: DataFrame, x0: float, y0: float, step: float) -> tuple[int, int]:
    """How many cells from the origin cover all points, in x and y."""
    top = points.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    return tuple(max(1, int((v - o) // step) + 1) if v is not None else 1 for v, o in ((top["x"], x0), (top["y"], y0)))


def error_heatmap(pred: DataFrame, x0: float, y0: float, step: float, nx: int, ny: int, *groups: str) -> DataFrame:
    """Mean error per map cell (left-closed cells); every cell of the grid appears, empty ones NULL."""
    cells = pred.groupBy(
        *groups,
        X.grid_index(F.col("x"), x0, step, nx).alias("xi"),
        X.grid_index(F.col("y"), y0, step, ny).alias("yi"),
    ).agg(F.avg("err").alias("mean_err"), F.count("*").alias("n"))
    grid = pred.sparkSession.range(nx * ny).select(
        F.pmod("id", F.lit(nx)).cast("int").alias("xi"), F.floor(F.col("id") / nx).cast("int").alias("yi")
    )
    if not groups:
        return grid.join(cells, ["xi", "yi"], "left").fillna({"n": 0})
    names = pred.select(*groups).distinct()
    full = names.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1)))).select(
        *groups,
        F.pmod("_c", F.lit(nx)).cast("int").alias("xi"),
        F.floor(F.col("_c") / nx).cast("int").alias("yi"),
    )
    return full.join(cells, [*groups, "xi", "yi"], "left").fillna({"n": 0})


def results_wide(pred: DataFrame, methods: list[str]) -> DataFrame:
    """One row per position with <method>_Pred_X / _Pred_Y / _Error columns."""
    wide = pred.groupBy("rx_id").pivot("method", methods).agg(
        F.first("px").alias("Pred_X"), F.first("py").alias("Pred_Y"), F.first("err").alias("Error")
    )
    for m in methods:
        prefix = m.replace(" ", "_").replace("(", "").replace(")", "")
        for c in ("Pred_X", "Pred_Y", "Error"):
            wide = wide.withColumnRenamed(f"{m}_{c}", f"{prefix}_{c}")
    return wide


# ---------------------------------------------------------------- comparison tables
# fixed names: summary key of each method and its column prefix in the comparison table
TABLE_METHODS = [
    ("WKNN (IDW)", "wknn"),
    ("WKNN C2F", "c2f"),
    ("NN Regression", "nn"),
    ("CNN Regression", "cnn"),
]


def comparison_table(summaries: DataFrame) -> DataFrame:
    """Ablation table from summaries(combo, n_feat, enabled array, method, mae, rmse, p90).

    NaN counts as missing; the best method is the smallest MAE over whatever methods a
    combination has.
    """
    val = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("mae", "rmse", "p90")}
    s = summaries.select("combo", "n_feat", "enabled", "method", *[v.alias(c) for c, v in val.items()])
    cols = [
        F.max(F.when(F.col("method") == name, F.col(c))).alias(f"{prefix}_{c}")
        for name, prefix in TABLE_METHODS
        for c in ("mae", "rmse", "p90")
    ]
    by_mae = F.when(F.col("mae").isNotNull(), F.struct("mae", "method"))
    return (
        s.groupBy("combo")
        .agg(
            F.max("n_feat").alias("n_feat"),
            X.feature_abbrev(F.max("enabled")).alias("feat_abbrev"),
            *cols,
            F.min("mae").alias("best_mae"),
            F.coalesce(F.min(by_mae)["method"], F.lit("—")).alias("best_method"),
        )
    )


def sort_table(table: DataFrame, by: str = "wknn_mae") -> DataFrame:
    return table.orderBy(F.col(by).asc_nulls_last(), "combo")


def delta_vs_baseline(table: DataFrame, names=("ALL", "all", "baseline")) -> DataFrame:
    """Best-MAE difference of every combination to the baseline row (negative = better)."""
    base = table.filter(F.col("combo").isin(*names)).agg(F.min("best_mae")).scalar()
    return table.filter(~F.col("combo").isin(*names)).select(
        "combo", "best_mae", (F.col("best_mae") - base).alias("delta")
    )


def metric_winners(charts: DataFrame) -> DataFrame:
    """Per-metric winners and a combined min-max score over charts(method, tw, ct, ks, nnle).

    One row per charting method, so the ungrouped windows see a handful of rows.
    """
    w = W.partitionBy()

    def norm(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - lo) / (hi - lo + F.lit(1e-12))

    scored = charts.withColumn("combined", (norm("tw") + norm("ct") + (F.lit(1.0) - norm("ks"))) / 3.0)
    first = F.min_by("method", F.struct(-F.col("combined"), F.col("method"))).over(w)
    return scored.select(
        "method",
        "tw",
        "ct",
        "ks",
        "nnle",
        "combined",
        X.high_verdict(F.col("tw")).alias("tw_verdict"),
        X.high_verdict(F.col("ct")).alias("ct_verdict"),
        X.low_verdict(F.col("ks")).alias("ks_verdict"),
        (F.col("method") == first).alias("best_overall"),
        (F.col("tw") == F.max("tw").over(w)).alias("best_tw"),
        (F.col("ct") == F.max("ct").over(w)).alias("best_ct"),
        (F.col("ks") == F.min("ks").over(w)).alias("best_ks"),
        F.coalesce(F.col("nnle") == F.min("nnle").over(w), F.lit(False)).alias("best_nnle"),
    )
