"""Carrier adapters: present the given star-schema tables as propagation-path tables.

``events`` carries paths (one event = one path), its users are receivers and its
five event types are transmitters; ``embeddings`` carries a ready feature matrix
on a surrogate grid; ``lineitem`` carries a larger path table for the bench.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import expr as X

# fixed transmitter numbering: alphabetical event types
TX_TYPES = ["click", "error", "purchase", "signup", "view"]
N_TX = len(TX_TYPES)
GRID_COLS, GRID_STEP, GRID_X0, GRID_Y0 = 25, 2.5, -47.5, -60.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tx_of(event_type) -> F.Column:
    # position in the fixed list; array_position is 1-based
    return (F.array_position(F.array(*[F.lit(t) for t in TX_TYPES]), event_type) - 1).cast("int")


def event_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All path slots of the dense link tensor: one per event. As in a padded tensor, the slots
    of a link that is not reached (one transmitter per receiver) carry amplitude 0."""
    e = table(spark, sf_dir, "events").withColumn("tx_id", _tx_of(F.col("event_type")))
    eid = F.col("event_id")
    level = (F.pmod(eid, F.lit(97)) + 1) / (F.lit(1000.0) * (F.lit(1.0) + F.col("value")))
    return e.select(
        F.col("user_id").alias("rx_id"),
        "tx_id",
        eid.alias("path_id"),
        F.col("value").alias("delay_ns"),
        F.when(F.pmod("user_id", F.lit(10)) == F.col("tx_id"), 0.0).otherwise(level).alias("amp"),
        (F.pmod(eid * 37, F.lit(360)) - 180).cast("double").alias("az_deg"),
        F.pmod(eid * 53, F.lit(181)).cast("double").alias("el_deg"),
    )


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paths(rx_id, tx_id, path_id, delay_ns, amp, az_deg, el_deg): the valid slots."""
    return event_slots(spark, sf_dir).filter(X.valid_path(F.col("delay_ns"), F.col("amp")))


def event_rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver dimension: one grid position per user, reached or not."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("rx_id"))
        .distinct()
        .select("rx_id", *grid_position(F.col("rx_id")))
    )


def grid_position(rid) -> list:
    ix = F.pmod(rid, F.lit(GRID_COLS)).cast("int")
    iy = F.floor(rid / GRID_COLS).cast("int")
    return [
        ix.alias("ix"),
        iy.alias("iy"),
        (ix * GRID_STEP + GRID_X0).alias("x"),
        (iy * GRID_STEP + GRID_Y0).alias("y"),
    ]


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(id, vec, x, y, label, is_test, fold): feature matrix with split and CV fold."""
    vid = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vid.alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        (F.pmod(vid, F.lit(GRID_COLS)) * F.lit(GRID_STEP)).alias("x"),
        (F.floor(vid / GRID_COLS) * F.lit(GRID_STEP)).alias("y"),
        F.col("label").cast("int").alias("label"),
        (F.pmod(vid, F.lit(10)) < 3).alias("is_test"),
        F.pmod(F.floor(vid / 10), F.lit(5)).cast("int").alias("fold"),
    )


def lineitem_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger path table: orders are receivers, supplier number mod 9 is the transmitter."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("rx_id"),
        F.pmod(F.col("l_suppkey"), F.lit(9)).cast("int").alias("tx_id"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("path_id"),
        (F.col("l_quantity") * 10.0).alias("delay_ns"),
        (F.lit(1.0) / F.col("l_extendedprice")).alias("amp"),
        (F.pmod(F.col("l_partkey") * 37, F.lit(360)) - 180).cast("double").alias("az_deg"),
        F.pmod(F.col("l_partkey") * 53, F.lit(181)).cast("double").alias("el_deg"),
    )


# the same projections in SQL, for the side-by-side checks
PATHS_SQL = """slots AS (
  SELECT rx_id, tx_id, path_id, delay_ns, CASE WHEN rx_id % 10 = tx_id THEN 0.0::DOUBLE ELSE level END AS amp, az_deg, el_deg
  FROM (
    SELECT user_id AS rx_id,
           CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS tx_id,
           event_id AS path_id, value AS delay_ns,
           (event_id % 97 + 1) / (1000.0::DOUBLE * (1.0::DOUBLE + value)) AS level,
           CAST((event_id * 37) % 360 - 180 AS DOUBLE) AS az_deg,
           CAST((event_id * 53) % 181 AS DOUBLE) AS el_deg
    FROM events) p),
  paths AS (SELECT * FROM slots WHERE delay_ns > 0 AND amp > 0)"""

RX_SQL = """rx AS (
  SELECT rx_id, CAST(rx_id % 25 AS INTEGER) AS ix, CAST(rx_id // 25 AS INTEGER) AS iy,
         (rx_id % 25) * 2.5::DOUBLE - 47.5::DOUBLE AS x, (rx_id // 25) * 2.5::DOUBLE - 60.0::DOUBLE AS y
  FROM (SELECT DISTINCT user_id AS rx_id FROM events))"""

POINTS_SQL = """points AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec,
         (vec_id % 25) * 2.5::DOUBLE AS x, (vec_id // 25) * 2.5::DOUBLE AS y, label,
         (vec_id % 10) < 3 AS is_test, CAST((vec_id // 10) % 5 AS INTEGER) AS fold
  FROM embeddings)"""

LINEITEM_SQL = """paths AS (
  SELECT l_orderkey AS rx_id, CAST(l_suppkey % 9 AS INTEGER) AS tx_id,
         l_partkey * 8 + l_linenumber AS path_id, l_quantity * 10.0::DOUBLE AS delay_ns,
         1.0::DOUBLE / l_extendedprice AS amp,
         CAST((l_partkey * 37) % 360 - 180 AS DOUBLE) AS az_deg,
         CAST((l_partkey * 53) % 181 AS DOUBLE) AS el_deg FROM lineitem)"""
