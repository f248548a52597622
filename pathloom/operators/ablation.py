"""Feature ablation: the same scaled features, many enabled-group combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators import localize as LZ
from pathloom.operators.evaluate import error_metrics
from pathloom.operators.knn import knn_join_views
from pathloom.session import materialize

# fixed group names, in concatenation order
GROUPS = ["ofdm_mag_gd", "tdoa", "aoa", "rss", "path_loss", "delay", "cov_eigenvalues", "reached_flags"]
# fixed display names of the groups in combination names
NAMES = ["OFDM", "TDoA", "AoA", "RSS", "PathLoss", "Delay", "CovEig", "Reached"]
# fixed logical combinations
LOGICAL = {
    "Geometry": ["tdoa", "aoa", "delay"],
    "Radio": ["rss", "path_loss", "reached_flags"],
    "Spectral": ["ofdm_mag_gd"],
    "Light": ["tdoa", "aoa", "rss", "reached_flags"],
    "No_OFDM_Light": ["tdoa", "aoa", "rss", "path_loss", "delay", "reached_flags"],
    "OFDM_Radio": ["ofdm_mag_gd", "rss", "path_loss"],
}


def combinations() -> dict[str, list[str]]:
    """ALL, leave-one-out, solo and logical combinations."""
    out = {"ALL": list(GROUPS)}
    out.update({f"No_{n}": [g for g in GROUPS if g != own] for n, own in zip(NAMES, GROUPS)})
    out.update({f"Solo_{n}": [own] for n, own in zip(NAMES, GROUPS)})
    out.update(LOGICAL)
    return out


def _stacked(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All groups side by side, each column divided by the square root of its group's width."""
    parts = [F.transform(F.col(c), _divide_by(F.sqrt(F.size(c).cast("double")))) for c in columns.values()]
    return df.select("id", "x", "y", F.concat(*parts).alias("vec"))


def _divide_by(scale):
    return lambda v: v / scale


def run(test: DataFrame, train: DataFrame, columns: dict[str, str], combos: dict[str, list[str]], k: int, power: float) -> DataFrame:
    """Summaries (combo, n_feat, enabled, method, n, mae, rmse, ...) of wKNN per combination.

    Scaling and weights are per column, so a combination is a column subset of one stacked
    vector; the metrics of all combinations come from one pass over one prediction table.
    """
    sizes = train.limit(1).select(*[F.size(c).alias(g) for g, c in columns.items()]).first()
    start, at = 0, {}
    for g in columns:
        at[g] = list(range(start, start + sizes[g]))
        start += sizes[g]
    views = {n: [i for g in columns if g in e for i in at[g]] for n, e in combos.items()}
    nb = knn_join_views(_stacked(test, columns), _stacked(train, columns), k, views, carry=("x", "y"))
    w = X.idw_weight(F.col("dist"), F.lit(float(power)))
    pred = nb.groupBy(F.col("view").alias("combo"), "query_id").agg(
        (F.sum(w * F.col("x")) / F.sum(w)).alias("px"), (F.sum(w * F.col("y")) / F.sum(w)).alias("py")
    )
    m = error_metrics(materialize(LZ.with_error(pred, test).select("combo", "err")), "combo")
    info = [(n, len(views[n]), list(e)) for n, e in combos.items()]
    info_df = train.sparkSession.createDataFrame(info, "combo string, n_feat int, enabled array<string>")
    # one row per combination
    return m.join(F.broadcast(info_df), "combo").withColumn("method", F.lit("WKNN (IDW)"))
