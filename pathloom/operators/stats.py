"""Path-population statistics: one scan, map-side partial aggregation, no per-key task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators.skew import ROWS_PER_SALT, salted_lookup
from pathloom.session import materialize


def path_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Count, delay/amplitude/gain extremes and means, population std, total power gain."""
    g = X.amp_to_db(F.col("amp"))
    return df.withColumn("gain_db", g).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("delay_ns").alias("min_delay"),
        F.max("delay_ns").alias("max_delay"),
        F.avg("delay_ns").alias("mean_delay"),
        F.stddev_pop("delay_ns").alias("std_delay"),
        F.min("amp").alias("min_amp"),
        F.max("amp").alias("max_amp"),
        F.avg("amp").alias("mean_amp"),
        F.min("gain_db").alias("min_gain"),
        F.max("gain_db").alias("max_gain"),
        F.avg("gain_db").alias("mean_gain"),
        X.power_to_db(F.sum(X.db_to_linear(F.col("gain_db")))).alias("total_gain"),
    )


def weighted_spread(
    df: DataFrame,
    keys: list[str],
    value: Column,
    weights: dict[str, Column],
    extra: dict[str, tuple[str, Column]] | None = None,
    centre: Column | None = None,
    bin_width: float = 1.0,
) -> DataFrame:
    """Weighted means and stds of ``value`` for several weights, in one scan.

    A plain one-pass sum of squares loses precision and a second pass around the
    mean needs a join on the key, where one hot key would fill one task. So rows
    are first summed per (key, value bin) about the bin's own centre: partial
    aggregation runs before the shuffle, a hot key spreads over its bins, and the
    few bins of a key are then shifted to the common centre without cancellation.

    ``extra`` maps names to ("sum" | "min" | "max", column). Per weight name w the
    result has sum_w, mean_w and std_w; ``centre`` replaces the mean and may use these.
    """
    extra = extra or {}
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    off = F.col("_v") - F.col("_c")
    moments = []
    for w in weights:
        moments += [
            F.sum(w).alias(f"{w}0"),
            F.sum(F.col(w) * off).alias(f"{w}1"),
            F.sum(F.col(w) * off * off).alias(f"{w}2"),
        ]
    binned = (
        df.select(*keys, value.alias("_v"), *[c.alias(w) for w, c in weights.items()], *[c.alias(n) for n, (_, c) in extra.items()])
        .withColumn("_c", (F.floor(F.col("_v") / bin_width) + F.lit(0.5)) * bin_width)
        .groupBy(*keys, "_c")
        .agg(*moments, *[agg[how](n).alias(n) for n, (how, _) in extra.items()], F.count("*").alias("n"))
    )
    names = [f"{w}{i}" for w in weights for i in range(3)]
    per_key = binned.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(f"{w}0").alias(f"sum_{w}") for w in weights],
        *[(F.sum(F.col(f"{w}0") * F.col("_c") + F.col(f"{w}1")) / F.sum(f"{w}0")).alias(f"mean_{w}") for w in weights],
        # at most (value range / bin width) entries per key
        F.collect_list(F.struct("_c", *names)).alias("_bins"),
        *[agg[how](n).alias(n) for n, (how, _) in extra.items()],
    )

    def std(w: str) -> Column:
        m = F.col(f"mean_{w}") if centre is None else centre
        second = F.aggregate(
            F.transform(
                "_bins",
                lambda b: b[f"{w}2"] + F.lit(2.0) * (b["_c"] - m) * b[f"{w}1"] + (b["_c"] - m) * (b["_c"] - m) * b[f"{w}0"],
            ),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        return F.sqrt(F.greatest(second, F.lit(0.0)) / F.col(f"sum_{w}"))

    return per_key.select("*", *[std(w).alias(f"std_{w}") for w in weights]).drop("_bins")


def _power() -> Column:
    return X.db_to_linear(X.amp_to_db(F.col("amp")))


def path_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Path statistics and RMS delay spread from one scan."""
    g = X.amp_to_db(F.col("amp"))
    extra = {}
    for name, c in (("delay", F.col("delay_ns")), ("amp", F.col("amp")), ("gain", g)):
        extra |= {f"min_{name}": ("min", c), f"max_{name}": ("max", c)}
    extra |= {"_amp": ("sum", F.col("amp")), "_gain": ("sum", g)}
    s = weighted_spread(df, list(keys), F.col("delay_ns"), {"one": F.lit(1.0), "pw": _power()}, extra)
    return s.select(
        *keys,
        "n",
        "min_delay",
        "max_delay",
        F.col("mean_one").alias("mean_delay"),
        F.col("std_one").alias("std_delay"),
        "min_amp",
        "max_amp",
        (F.col("_amp") / F.col("n")).alias("mean_amp"),
        "min_gain",
        "max_gain",
        (F.col("_gain") / F.col("n")).alias("mean_gain"),
        X.power_to_db(F.col("sum_pw")).alias("total_gain"),
        F.col("std_pw").alias("rms_spread"),
    )


def rms_delay_spread(df: DataFrame, *keys: str) -> DataFrame:
    """Power-weighted mean delay and RMS spread per key."""
    out = weighted_spread(df, list(keys), F.col("delay_ns"), {"pw": _power()})
    return out.select(*keys, "n", F.col("mean_pw").alias("mean_delay"), F.col("std_pw").alias("rms_spread"))


def angular_spread(df: DataFrame, *keys: str) -> DataFrame:
    """Power-weighted circular azimuth mean, elevation mean, and spreads.

    The azimuth spread uses the plain difference to the mean (not wrapped at 180 degrees).
    Both angles go through one scan, as two labelled values per path.
    """
    both = F.explode(
        F.array(
            F.struct(F.lit(True).alias("is_az"), F.col("az_deg").alias("deg")),
            F.struct(F.lit(False).alias("is_az"), F.col("el_deg").alias("deg")),
        )
    )
    long = df.select(*keys, "amp", both.alias("a")).select(*keys, "amp", "a.is_az", "a.deg")
    circular = F.degrees(F.atan2(F.col("_sin"), F.col("_cos")))
    s = weighted_spread(
        long,
        [*keys, "is_az"],
        F.col("deg"),
        {"pw": _power()},
        {"_sin": ("sum", _power() * F.sin(F.radians("deg"))), "_cos": ("sum", _power() * F.cos(F.radians("deg")))},
        centre=F.when(F.col("is_az"), circular).otherwise(F.col("mean_pw")),
    )
    az = F.col("is_az")
    return s.groupBy(*keys).agg(
        F.max(F.when(az, circular)).alias("mean_az"),
        F.max(F.when(az, F.col("std_pw"))).alias("std_az"),
        F.max("n").alias("n"),
        F.max(F.when(~az, F.col("mean_pw"))).alias("mean_el"),
        F.max(F.when(~az, F.col("std_pw"))).alias("std_el"),
    )


def delay_spread_profile(df: DataFrame, *keys: str, bin_width: float = 1.0) -> DataFrame:
    """Delay spread relative to the first arrival, with the delay rank of the strongest path.

    The rank is the number of paths before the strongest one. Whole delay bins are counted
    from a partial aggregate; only the strongest path's own bin is looked at path by path,
    so the rows of a hot key never meet in one task.
    """
    p = df.select(
        *keys,
        "delay_ns",
        "path_id",
        (F.col("amp") * F.col("amp")).alias("power"),
        F.floor(F.col("delay_ns") / bin_width).alias("_bin"),
    )
    binned = p.groupBy(*keys, "_bin").agg(
        F.count("*").alias("_n"),
        F.min("delay_ns").alias("_first"),
        # strongest first, ties to the earliest arrival
        F.min(F.struct((-F.col("power")).alias("np"), F.col("delay_ns"), F.col("path_id"))).alias("_top"),
    )
    top = binned.groupBy(*keys).agg(
        F.min("_first").alias("first_delay"),
        F.min("_top").alias("_top"),
        F.min_by("_bin", "_top").alias("_bin"),
        F.collect_list(F.struct("_bin", "_n")).alias("_counts"),
    )
    top = top.withColumn(
        "_before",
        F.aggregate(
            F.filter("_counts", lambda c: c["_bin"] < F.col("_bin")),
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + c["_n"],
        ),
    ).withColumn("_in_bin", F.filter("_counts", lambda c: c["_bin"] == F.col("_bin"))[0]["_n"]).drop("_counts")
    top = materialize(top)
    lookup = top.select(*keys, "_bin", "_top", F.col("_in_bin").alias("n"))
    inside = (
        salted_lookup(p, lookup, [*keys, "_bin"], "path_id", ROWS_PER_SALT)
        .groupBy(*keys)
        .agg(
            F.sum(
                (F.struct("delay_ns", "path_id") < F.struct("_top.delay_ns", "_top.path_id")).cast("bigint")
            ).alias("_inside")
        )
    )
    spread = weighted_spread(p, list(keys), F.col("delay_ns"), {"pw": F.col("power")}, bin_width=bin_width)
    return (
        spread.join(top, list(keys))
        .join(inside, list(keys))
        .select(
            *keys,
            "n",
            (F.col("mean_pw") - F.col("first_delay")).alias("mean_spread"),
            F.col("std_pw").alias("spread_std"),
            (F.col("_before") + F.col("_inside")).alias("strong_idx"),
        )
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, *keys: str) -> DataFrame:
    """Fixed-width counts; the last bin includes its right edge."""
    v = F.col(value)
    b = F.least(F.floor((v - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return (
        df.filter((v >= lo) & (v <= hi))
        .groupBy(*keys, b.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def width_histogram(df: DataFrame, value: str, lo: float, width: float, *keys: str) -> DataFrame:
    """Counts by bins of one width from ``lo`` on, as many bins as the values reach."""
    b = F.floor((F.col(value) - lo) / width).cast("int")
    return df.filter(F.col(value) >= lo).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def auto_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Histogram between the observed extremes. Reads its input twice: pass a materialised frame."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return histogram(df, value, bounds["lo"], bounds["hi"], bins)


def best_key(df: DataFrame, key: str, score: Column) -> DataFrame:
    """Key with the largest total score; ties to the smallest key."""
    return df.groupBy(key).agg(F.sum(score).alias("score")).orderBy(F.desc("score"), key).limit(1)


def paths_per_rx(df: DataFrame) -> DataFrame:
    """How many receivers have n paths, as a share of all reached receivers."""
    per = df.groupBy("rx_id").agg(F.count("*").alias("n_paths"))
    hist = materialize(per.groupBy("n_paths").agg(F.count("*").alias("n_rx")))
    total = hist.agg(F.sum("n_rx")).scalar()
    return hist.select("n_paths", "n_rx", (F.col("n_rx") * 100.0 / total).alias("pct"))


def data_quality(df: DataFrame, *keys: str) -> DataFrame:
    """Read-back check per key: reached receivers, paths per receiver, NaN and zero counts."""
    per = df.groupBy(*keys, "rx_id").agg(
        F.count("*").alias("np"),
        F.sum(F.isnan("delay_ns").cast("int") + F.isnan("amp").cast("int")).alias("nn"),
        F.sum((F.col("amp") == 0).cast("int")).alias("nz"),
    )
    return per.groupBy(*keys).agg(
        F.count("*").alias("reached_rx"),
        F.avg("np").alias("mean_paths"),
        F.max("np").alias("max_paths"),
        F.min("np").alias("min_paths"),
        F.sum("nn").alias("nan_values"),
        F.sum("nz").alias("zero_amps"),
    )
