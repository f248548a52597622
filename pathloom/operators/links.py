"""Paths to links: one aggregate per (receiver, transmitter), the dense grid, and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators.evaluate import running_sum
from pathloom.operators.skew import ROWS_PER_SALT, salted_lookup
from pathloom.session import materialize

LINK = ["rx_id", "tx_id"]


def link_features(paths: DataFrame) -> DataFrame:
    """Every per-link scalar in one partial-aggregating pass (hot links combine map-side)."""
    amp, tau = F.col("amp"), F.col("delay_ns")
    az, el = F.radians("az_deg"), F.radians("el_deg")
    first = F.struct("delay_ns", "path_id")
    sum_amp = F.sum(amp) + F.lit(X.WEIGHT_EPS)
    return (
        paths.filter(X.valid_path(tau, amp))
        .groupBy(*LINK)
        .agg(
            F.count("*").alias("n_paths"),
            F.max(amp).alias("max_amp"),
            X.rss_db(F.sum(amp * amp)).alias("rss"),
            F.min(tau).alias("delay"),
            X.path_loss_db(F.min_by(amp, first)).alias("path_loss"),
            (F.sum(F.sin(az) * amp) / sum_amp).alias("sin_az"),
            (F.sum(F.cos(az) * amp) / sum_amp).alias("cos_az"),
            (F.sum(F.sin(el) * amp) / sum_amp).alias("sin_el"),
            (F.sum(F.cos(el) * amp) / sum_amp).alias("cos_el"),
        )
        .withColumn("reached", F.col("max_amp") > X.REACHED_AMP)
    )


def dominant_path(paths: DataFrame) -> DataFrame:
    """Attributes of the earliest path of each link (ties to the lowest path id)."""
    picked = F.struct("path_id", "delay_ns", "amp", "az_deg", "el_deg")
    return (
        paths.filter(X.valid_path(F.col("delay_ns"), F.col("amp")))
        .groupBy(*LINK)
        .agg(F.min_by(picked, F.struct("delay_ns", "path_id")).alias("p"))
        .select(*LINK, "p.*")
    )


def with_first_flag(paths: DataFrame) -> DataFrame:
    """Add ``is_first``: whether a path is the earliest of its link (hot links are split)."""
    first = F.min(F.struct("delay_ns", "path_id"))["path_id"]
    per = materialize(paths.groupBy(*LINK).agg(F.count("*").alias("n"), first.alias("_first")))
    out = salted_lookup(paths, per, LINK, "path_id", ROWS_PER_SALT)
    return out.withColumn("is_first", F.col("path_id") == F.col("_first")).drop("_first")


def strongest_path(paths: DataFrame) -> DataFrame:
    """Attributes of the path with the least path loss of each link."""
    picked = F.struct("path_id", "delay_ns", "amp", "az_deg", "el_deg")
    return (
        paths.filter(X.valid_path(F.col("delay_ns"), F.col("amp")))
        .groupBy(*LINK)
        .agg(F.min_by(picked, F.struct(-F.col("amp"), F.col("path_id"))).alias("p"))
        .select(*LINK, "p.*")
    )


def strongest_n(paths: DataFrame, n: int) -> DataFrame:
    """The n strongest paths per link; the rank limit is applied before the shuffle."""
    w = W.partitionBy(*LINK).orderBy(F.desc("amp"), "path_id")
    return paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def link_grid(rx: DataFrame, links: DataFrame, n_tx: int) -> DataFrame:
    """Every (rx, tx) pair, measured or not. ``n_tx`` is a layout constant, so rows are
    expanded in place instead of joined against a transmitter table."""
    grid = rx.select("rx_id", F.explode(F.sequence(F.lit(0), F.lit(n_tx - 1))).alias("tx_id"))
    return grid.join(links, LINK, "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def impute_links(grid: DataFrame) -> DataFrame:
    """Fill unreached links: RSS floor, path-loss ceiling, mean delay, zero angles.
    Reads the grid twice: pass a materialised frame."""
    ok = F.col("reached")
    stats = grid.groupBy("tx_id").agg(
        F.min(F.when(ok, F.col("rss"))).alias("_rss"),
        F.max(F.when(ok, F.col("path_loss"))).alias("_pl"),
        F.avg(F.when(ok, F.col("delay"))).alias("_dl"),
    )
    fill = {
        "rss": F.coalesce(F.col("_rss") - 10.0, F.lit(-200.0)),
        "path_loss": F.coalesce(F.col("_pl") + 10.0, F.lit(300.0)),
        "delay": F.coalesce(F.col("_dl"), F.lit(0.0)),
    }
    # one row per transmitter: its size is fixed by the layout, not by the data
    out = grid.join(F.broadcast(stats), "tx_id", "left")
    zeros = ["sin_az", "cos_az", "sin_el", "cos_el"]
    return out.select(
        *LINK,
        "reached",
        *[F.when(ok, F.col(c)).otherwise(v).alias(c) for c, v in fill.items()],
        *[F.when(ok, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in zeros],
    )


def tdoa_pairs(grid: DataFrame, n_tx: int) -> DataFrame:
    """First-arrival differences for every transmitter pair i < j of a receiver.

    The n_tx delays of a receiver are gathered into one short array (its length is the
    layout constant), then the fixed pair list is expanded from it: no self-join.
    """
    per_rx = grid.groupBy("rx_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("tx_id", F.when(F.col("reached"), F.col("delay")).alias("d")))
        ).alias("d")
    )
    pairs = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n_tx) for j in range(i + 1, n_tx)]
    )
    return per_rx.select("rx_id", "d", F.explode(pairs).alias("p")).select(
        "rx_id",
        F.col("p.i").alias("tx_i"),
        F.col("p.j").alias("tx_j"),
        (F.col("d")[F.col("p.i")] - F.col("d")[F.col("p.j")]).alias("tdoa"),
    )


def tdoa_imputed(pairs: DataFrame) -> DataFrame:
    """Missing pairs take the mean of the receivers that have the pair (0 if none has).
    Reads the pairs twice: pass pairs of a materialised grid."""
    means = pairs.groupBy("tx_i", "tx_j").agg(F.avg("tdoa").alias("_m"))
    return pairs.join(F.broadcast(means), ["tx_i", "tx_j"], "left").select(
        "rx_id", "tx_i", "tx_j", F.coalesce("tdoa", "_m", F.lit(0.0)).alias("tdoa")
    )


def all_reached_rx(links: DataFrame, n_tx: int) -> DataFrame:
    """Receivers reached by every transmitter."""
    return (
        links.filter("reached")
        .groupBy("rx_id")
        .agg(F.count("*").alias("n_reached"))
        .filter(F.col("n_reached") == n_tx)
    )


def link_gain(paths: DataFrame) -> DataFrame:
    """Total channel gain per link."""
    total = F.sum(F.col("amp") * F.col("amp"))
    return paths.groupBy(*LINK).agg(
        total.alias("gain"), X.power_to_db(total).alias("gain_db"), X.rss_dbm(total).alias("rss_dbm")
    )


def best_link(paths: DataFrame) -> DataFrame:
    """The link with the largest single-path amplitude."""
    return (
        paths.groupBy(*LINK)
        .agg(F.max("amp").alias("max_amp"), F.sum(F.col("amp") * F.col("amp")).alias("power"))
        .orderBy(F.desc("max_amp"), *LINK)
        .limit(1)
    )


def best_tx_paths(paths: DataFrame) -> DataFrame:
    """Paths of the transmitter with the largest total power, with their gain in dB and their place by delay in the link."""
    best = (
        paths.groupBy("tx_id")
        .agg(F.sum(F.col("amp") * F.col("amp")).alias("p"))
        .orderBy(F.desc("p"), "tx_id")
        .limit(1)
        .select("tx_id")
    )
    chosen = (
        paths.filter(X.valid_path_compare(F.col("delay_ns"), F.col("amp")))
        .join(F.broadcast(best), "tx_id", "left_semi")
        .select(*LINK, "path_id", "delay_ns", "amp", X.amp_to_db(F.col("amp")).alias("gain_db"))
    )
    # a running count over ranges: one link may hold most of the paths
    ordered = chosen.withColumns({"_o": F.struct("delay_ns", "path_id"), "_one": F.lit(1)})
    return running_sum(ordered, LINK, "_o", "_one", "delay_rank").drop("_o", "_one")
