"""The t-SNE chart: weights, lattice forces and whole steps against dense NumPy, and what the chart keeps."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import layouts as L
from pathloom.operators.charts import trustworthiness_continuity
from pathloom.operators.manifold import pca_chart


def frame(spark, ids, vec, parts=3):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vec)], "id long, vec array<double>").repartition(parts)


def placed(spark, z, parts):
    rows = [(i, float(a), float(b), 0.0, 0.0, 1.0, 1.0) for i, (a, b) in enumerate(z)]
    return spark.createDataFrame(rows, L._STATE.replace("bigint", "long")).repartition(parts)


def test_lists_of_different_length():
    m, mask = L.padded(pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float64())))
    assert m.tolist() == [[1, 2], [0, 0], [3, 0]] and mask.tolist() == [[True, True], [False, False], [True, False]]


def test_weights_have_the_perplexity():
    r = np.random.default_rng(0)
    d = np.sort(r.uniform(0.5, 9, (40, 30)), 1) * r.uniform(1e-3, 1e3, (40, 1))
    p = L.entropy_weights(d, np.ones(d.shape, bool), 8.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p + 1e-300)).sum(1)), 8.0, rtol=1e-6)
    mask = np.ones((2, 6), bool)
    mask[1, 1:] = False
    q = L.entropy_weights(np.zeros((2, 6)), mask, 8.0)
    assert np.allclose(q[0], 1 / 6) and q[1].tolist() == [1, 0, 0, 0, 0, 0]


def test_lattice_fields_are_plain_sums():
    r = np.random.default_rng(2)
    w, step = r.normal(size=(7, 5)), 0.3
    x, y = np.meshgrid(np.arange(7) * step, np.arange(5) * step, indexing="ij")
    dx, dy = x.ravel()[:, None] - x.ravel(), y.ravel()[:, None] - y.ravel()
    k = 1 / (1 + dx**2 + dy**2)
    for got, kernel in zip(L.lattice_fields(w, step), (k, dx * k * k, dy * k * k)):
        assert np.allclose(got.ravel(), kernel @ w.ravel(), atol=1e-10)


@pytest.mark.parametrize("shipped", [True, False])
def test_gradient_and_step_against_all_pairs(spark, monkeypatch, shipped):
    n, r = 500, np.random.default_rng(5)
    if not shipped:
        monkeypatch.setattr(L, "SHIPPED_ROWS", 10)
    edges = L.affinities(frame(spark, range(n), r.normal(size=(n, 6))), 20.0).cache()
    p = np.zeros((n, n))
    for e in edges.collect():
        p[e["src"], e["dst"]] = e["w"] / n
    assert np.array_equal(p, p.T) and p.sum() == pytest.approx(1.0)
    z = r.normal(size=(n, 2)) * 6
    diff = z[:, None] - z[None]
    q = 1 / (1 + (diff**2).sum(-1))
    np.fill_diagonal(q, 0)
    want = n * (((p - q / q.sum()) * q)[..., None] * diff).sum(1)
    got = []
    for parts in (1, 4):
        state = placed(spark, z, parts)
        cells, width, extent = L._boxed(state, L._cell_width(float(np.ptp(z, axis=0).max())))
        rows = L.tsne_step(edges, state, L._repulsion(cells, width, n), n, 1.0, 0.5, 50.0).orderBy("id").toPandas()
        got.append(rows)
    assert got[0].equals(got[1])  # partitions do not matter, to the last bit
    d = got[0][["d1", "d2"]].to_numpy()
    assert np.linalg.norm(d - want) < 0.01 * np.linalg.norm(want)
    assert np.allclose(got[0][["z1", "z2"]].to_numpy(), z - 4 * 50.0 / n * 0.8 * d)
    edges.unpersist()


def test_cells_widen_where_points_are_far(spark):
    cells, width, extent = L._boxed(placed(spark, np.array([[0.0, 0.0], [1e4, 0.0]]), 1), 0.4)
    assert width > 0.4 and cells.num_rows == 2 and extent >= 1e4


@pytest.mark.xfail(reason="open: not reached in 40 rounds, see the README")
def test_chart_keeps_neighbours_better_than_axes(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 10)) * 4
    vec = centre[np.arange(240) % 12] + r.normal(size=(240, 10))
    p = frame(spark, range(240), vec)

    def tw(z):
        both = p.withColumnRenamed("vec", "hi").join(z.select("id", F.array("z1", "z2").alias("lo")), "id")
        return trustworthiness_continuity(both, 10).first()["tw"]

    scores, best = L.sweep(p, lambda q, size: L.tsne_chart(q, size, rounds=40), [15])
    assert best.count() == 240 and scores.first()["tw"] > tw(pca_chart(p)) + 0.02


def test_few_and_equal_points(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert L.tsne_chart(none).count() == 0
    assert L.tsne_chart(frame(spark, [7], np.array([[1.0, 2.0]]))).collect()[0]["id"] == 7
    same = L.tsne_chart(frame(spark, range(4), np.ones((4, 2))), rounds=3).collect()
    assert {(r["z1"], r["z2"]) for r in same} == {(0.0, 0.0)}
    two = L.tsne_chart(frame(spark, [1, 2], np.array([[0.0, 1.0], [3.0, 1.0]])), rounds=4).collect()
    assert all(np.isfinite([r["z1"], r["z2"]]).all() for r in two)
