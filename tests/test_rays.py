"""Rays brought to the path layout: all order keys, and no ray of a receiver that does not exist."""

import os

import pytest

from pathloom.plans import path_queries as Q
from pathloom.sources import ingest as SI


def test_every_ray_of_an_order_is_there(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("test tables not available")
    lines = [r["l_orderkey"] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").collect()]
    orders = {r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    got = sorted(r["rx_id"] for r in Q.ray_join(spark, sf).select("rx_id").collect())
    assert got == sorted(k for k in lines if k in orders)
    assert any(k % 7 == 0 for k in got)


def test_unmatched_rays_are_dropped(spark):
    rays = spark.createDataFrame(
        [(k, 0, 5e-9, 0.3, 0.4, 10.0, 80.0) for k in (1, 7, 8, 14)],
        "rx_index long, tx_idx int, delay double, gain_real double, gain_imag double, aoa_az double, aoa_el double",
    )
    rx = spark.createDataFrame([(1,), (7,), (14,)], "rx_id long")
    assert sorted(r["rx_id"] for r in SI.rays_to_paths(rays, rx).collect()) == [1, 7, 14]
