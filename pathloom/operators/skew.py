"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import materialize

MAX_SENT_KEYS = 1_000_000  # hot keys that may be broadcast, 12 bytes each
ROWS_PER_SALT = 2_000_000  # rows of one key that may share a task


def salted_lookup(big: DataFrame, per_key: DataFrame, keys: list[str], spread: str, rows_per_salt: int) -> DataFrame:
    """Inner join ``big`` with ``per_key`` (one row per key, ``n`` = rows of that key in ``big``).

    Every key of more than ``rows_per_salt`` rows is split by a hash of ``spread``, and its single lookup row is
    repeated per split. The list of such keys has at most total / rows_per_salt entries; it is broadcast when it is
    short enough, else joined like any table. ``per_key`` is read twice: pass a materialised table. ``n`` is dropped.
    """
    salts = F.ceil(F.col("n") / rows_per_salt).cast("int")
    # keys are matched by hash: a collision only splits a key that did not need it
    hot = materialize(
        per_key.filter(F.col("n") > rows_per_salt)
        .select(F.xxhash64(*keys).alias("_kh"), salts.alias("_salts"))
        .groupBy("_kh")
        .agg(F.max("_salts").alias("_salts"))
    )
    n_hot = hot.limit(MAX_SENT_KEYS + 1).count()
    if not n_hot:
        return big.join(per_key.drop("n"), keys)
    if n_hot <= MAX_SENT_KEYS:
        hot = F.broadcast(hot)

    def with_salts(df: DataFrame) -> DataFrame:
        return df.withColumn("_kh", F.xxhash64(*keys)).join(hot, "_kh", "left").drop("_kh")

    split = F.coalesce(F.col("_salts"), F.lit(1))
    left = with_salts(big).withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), split).cast("int")).drop("_salts")
    right = (
        with_salts(per_key)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), split - 1)))
        .drop("_salts", "n")
    )
    return left.join(right, [*keys, "_salt"]).drop("_salt")
