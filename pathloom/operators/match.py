"""Path matching between two sources: an interval join on delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators.skew import ROWS_PER_SALT, salted_lookup
from pathloom.session import materialize

SUB_BINS = 64  # delay bins per threshold width


def match_paths(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """For each path of ``a`` the first (lowest id) path of the same receiver in ``b`` whose
    delay differs by less than ``threshold``; a path of ``b`` may serve several.

    Candidate pairs are never listed. Both sides are reduced to distinct delays, and the
    lowest id over a delay interval comes from three pieces:
      * whole delay bins inside the interval - a range window over per-bin minima,
      * the cut bins at either end - running minima inside a bin; values within rounding of
        the end are compared one by one.
    Bins are 1/64 of the threshold wide, so a receiver with many paths spreads over many.
    """
    width = threshold / SUB_BINS
    ga, gb = X.amp_to_db(F.col("amp")), X.amp_to_db(F.col("amp"))
    bin_of = lambda c: F.floor(c / width)
    # lowest id of b per distinct delay, with what the result needs of it
    best = F.struct(F.col("path_id").alias("j"), F.col("delay_ns").alias("db"), gb.alias("gb"))
    b1 = b.groupBy("rx_id", F.col("delay_ns").alias("pos")).agg(F.min(best).alias("best"))
    b1 = materialize(b1.withColumn("bin", bin_of(F.col("pos"))))
    qa = a.groupBy("rx_id", F.col("delay_ns").alias("d")).agg(F.count("*").alias("n"))
    qa = materialize(qa.withColumn("bin", bin_of(F.col("d"))))

    # whole bins: both interval ends lie at least one bin outside
    per_bin = b1.groupBy("rx_id", "bin").agg(F.min("best").alias("best"))
    entry_type = per_bin.schema["best"].dataType
    q_bins = qa.select("rx_id", "bin").distinct().withColumn("best", F.lit(None).cast(entry_type))
    both = per_bin.withColumn("is_q", F.lit(False)).unionByName(q_bins.withColumn("is_q", F.lit(True)))
    w = W.partitionBy("rx_id").orderBy("bin").rangeBetween(-(SUB_BINS - 2), SUB_BINS - 2)
    inner = both.withColumn("m", F.min("best").over(w)).filter("is_q").select("rx_id", "bin", F.col("m").alias("m0"))

    # cut bins: the bins around either end, by running minima of the rows clearly inside
    hair = threshold * 1e-9

    def edge(lower: bool) -> DataFrame:
        side = -SUB_BINS if lower else SUB_BINS
        pos = F.col("d") - (threshold - hair) if lower else F.col("d") + (threshold - hair)
        around = F.explode(F.array(*[F.col("bin") + side + i for i in (-1, 0, 1)]))
        probes = qa.select("rx_id", around.alias("bin"), "d", pos.alias("pos"), F.lit(None).cast(entry_type).alias("best"))
        rows = b1.select("rx_id", "bin", F.lit(None).cast("double").alias("d"), "pos", "best").unionByName(probes)
        order = F.col("pos").desc() if lower else F.col("pos").asc()
        w = W.partitionBy("rx_id", "bin").orderBy(order, F.col("d").asc_nulls_last())
        run = F.min("best").over(w.rowsBetween(W.unboundedPreceding, -1))
        return rows.withColumn("m", run).filter(F.col("d").isNotNull()).select("rx_id", "d", "m")

    # rows within rounding of an end: an equi-join on hair-wide cells and the condition itself
    cell = lambda c: F.floor(c / (2 * hair))
    ends_of = F.array(*[cell(F.col("d") + s * threshold) + i for s in (-1, 1) for i in (-1, 0, 1)])
    close = (
        b1.select("rx_id", "pos", "best", cell(F.col("pos")).alias("cell"))
        .join(qa.select("rx_id", "d", F.explode(F.array_distinct(ends_of)).alias("cell")), ["rx_id", "cell"])
        .filter(F.abs(F.col("pos") - F.col("d")) < threshold)
        .select("rx_id", "d", F.col("best").alias("m"))
    )
    ends = edge(True).unionByName(edge(False)).unionByName(close).groupBy("rx_id", "d").agg(F.min("m").alias("m1"))
    found = (
        qa.join(inner, ["rx_id", "bin"])
        .join(ends, ["rx_id", "d"])
        .select("rx_id", "d", "n", F.least("m0", "m1").alias("m"))
        .filter(F.col("m").isNotNull())
    )
    left = a.select("rx_id", F.col("path_id").alias("i"), F.col("delay_ns").alias("d"), ga.alias("gain_a"))
    # many paths of a may share one delay
    return salted_lookup(left, materialize(found), ["rx_id", "d"], "i", ROWS_PER_SALT).select(
        "rx_id",
        "i",
        F.col("m.j").alias("j"),
        F.col("d").alias("delay_a"),
        F.col("m.db").alias("delay_b"),
        "gain_a",
        F.col("m.gb").alias("gain_b"),
        F.abs(F.col("d") - F.col("m.db")).alias("delay_err"),
        F.abs(F.col("gain_a") - F.col("m.gb")).alias("gain_err"),
    )


def match_stats(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count("*").alias("n_matched"),
        F.avg("delay_err").alias("mean_delay_err"),
        F.sqrt(F.avg(F.col("gain_err") * F.col("gain_err"))).alias("rms_gain_err"),
    )
