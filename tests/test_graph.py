"""The spectral chart against a dense solve, the geodesic chart against plain shortest paths."""

import heapq

import numpy as np
import pytest

from pathloom.operators import graph as G


def plain(vec, ids, k):
    d = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    a = np.zeros(d.shape)
    for i in range(len(vec)):
        a[i, np.lexsort((ids, d[i]))[:k]] = 1
    a = (a + a.T) / 2
    root = np.sqrt(a.sum(1))
    value, vector = np.linalg.eigh(a / root[:, None] / root[None])
    return a, root, value[::-1], vector[:, ::-1]


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    t = r.uniform(0, 3, 180)
    vec = np.stack([np.cos(t), np.sin(t), r.uniform(0, 0.4, 180)], 1)
    return np.arange(180) * 3 + 1, vec


def frame(spark, ids, vec):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vec)], "id long, vec array<double>").repartition(3)


def test_graph_is_symmetric_and_weighted(spark, cloud):
    ids, vec = cloud
    a, *_ = plain(vec, ids, 9)
    at = {i: n for n, i in enumerate(ids.tolist())}
    got = np.zeros(a.shape)
    for e in G.neighbour_graph(frame(spark, ids, vec), 10).collect():
        got[at[e["src"]], at[e["dst"]]] = e["w"]
    assert np.array_equal(got, a)


def test_chart_is_that_of_a_dense_solve(spark, cloud):
    ids, vec = cloud
    _, root, value, vector = plain(vec, ids, 9)
    chart, found = G.spectral_chart(frame(spark, ids, vec), 2, 10)
    assert found.residuals.max() < 1e-6 and np.allclose(found.values, value[:3], atol=1e-10)
    rows = {r["id"]: (r["z1"], r["z2"]) for r in chart.collect()}
    got = np.array([rows[i] for i in ids.tolist()])
    want = vector[:, 1:3] / root[:, None]
    want *= np.sign(want[np.abs(want).argmax(0), [0, 1]])
    assert np.allclose(got, want, atol=1e-6)


def test_ritz_of_a_small_operator():
    r = np.random.default_rng(1)
    m = r.normal(size=(30, 30))
    m = (m + m.T) / 2
    m /= 1.01 * np.abs(np.linalg.eigvalsh(m)).max()
    blocks = [r.normal(size=(30, 3))]
    blocks.append(m @ blocks[0])
    while len(blocks) < 12:
        blocks.append(2 * m @ blocks[-1] - blocks[-2])
    b = np.concatenate(blocks, 1)
    values, found, residuals = G.ritz(b.T @ b, 3, 3)
    x = b[:, :-3] @ found
    assert np.allclose(np.linalg.norm(m @ x - x * values, axis=0), residuals, atol=1e-6) and np.allclose(x.T @ x, np.eye(3), atol=1e-6)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:3], atol=1e-5)


def test_two_points_and_equal_points(spark):
    chart, found = G.spectral_chart(frame(spark, [1, 2], np.array([[0.0, 1.0], [1.0, 1.0]])), 1, 5)
    z = {r["id"]: r["z1"] for r in chart.collect()}
    assert found.values[1] == pytest.approx(-1.0) and z[1] == pytest.approx(-z[2]) and abs(z[1]) == pytest.approx(2**-0.5)
    same, _ = G.spectral_chart(frame(spark, range(12), np.ones((12, 2))), 2, 4)
    assert same.count() == 12


def ways(vec, ids, k):
    """Shortest ways between all points of the symmetric neighbour graph, one source after the other."""
    d = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(-1))
    near = [{} for _ in vec]
    for i in range(len(vec)):
        other = np.array([j for j in range(len(vec)) if j != i])
        for j in other[np.lexsort((ids[other], d[i, other]))][:k]:
            near[i][j] = near[j][i] = d[i, j]
    out = np.full(d.shape, np.inf)
    for source in range(len(vec)):
        heap = [(0.0, source)]
        while heap:
            way, i = heapq.heappop(heap)
            if way < out[source, i]:
                out[source, i] = way
                for j, w in near[i].items():
                    heapq.heappush(heap, (way + w, j))
    return out


def test_ways_are_the_shortest(spark, cloud):
    ids, vec = cloud
    ids, vec = ids[:80], vec[:80].copy()
    vec[60:] += 50.0  # two parts without an edge between them
    want = ways(vec, ids, 6)
    sources = spark.createDataFrame([(int(i),) for i in ids[[0, 5, 70]]], "id long")
    got = np.full((3, 80), np.inf)
    at = {i: n for n, i in enumerate(ids.tolist())}
    row = {int(i): n for n, i in enumerate(ids[[0, 5, 70]])}
    for r in G.shortest_paths(G.distance_graph(frame(spark, ids, vec), 6), sources).collect():
        got[row[r["source"]], at[r["id"]]] = r["d"]
    assert np.array_equal(np.isinf(got), np.isinf(want[[0, 5, 70]])) and np.isinf(got).any()
    assert np.allclose(got[np.isfinite(got)], want[[0, 5, 70]][np.isfinite(got)])
    chart = G.geodesic_chart(frame(spark, ids, vec), 2, 6, 20).collect()
    z = {r["id"]: (r["z1"], r["z2"]) for r in chart}
    assert len(z) == 80 and np.isfinite(np.array(list(z.values()))).all()


def test_geodesic_chart_with_all_points_as_landmarks(spark, cloud):
    ids, vec = cloud
    ids, vec = ids[:60], vec[:60]
    d = ways(vec, ids, 8)
    assert np.isfinite(d).all()
    centre = np.eye(60) - 1 / 60
    value, axes = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    want = axes[:, ::-1][:, :2] * np.sqrt(value[::-1][:2])
    z = {r["id"]: (r["z1"], r["z2"]) for r in G.geodesic_chart(frame(spark, ids, vec), 2, 8, 60).collect()}
    got = np.array([z[i] for i in ids.tolist()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    some = {r["id"]: (r["z1"], r["z2"]) for r in G.geodesic_chart(frame(spark, ids, vec), 2, 8, 25).collect()}
    part = np.array([some[i] for i in ids.tolist()])
    assert abs(np.corrcoef(part[:, 0], want[:, 0])[0, 1]) > 0.98


def test_geodesic_chart_of_few_points(spark):
    assert G.geodesic_chart(frame(spark, [7], np.array([[1.0, 2.0]]))).count() == 1
    same = G.geodesic_chart(frame(spark, range(5), np.ones((5, 2)))).collect()
    assert {(r["z1"], r["z2"]) for r in same} == {(0.0, 0.0)}


def test_spectrum_in_several_blocks(spark, cloud, monkeypatch):
    """The same values from several blocks of nodes; a step of the recurrence shuffles nothing."""
    ids, vec = cloud
    *_, value, _ = plain(vec, ids, 9)
    monkeypatch.setattr(G, "NODES_PER_BLOCK", 40)
    plans = []
    kept = G.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(G, "materialize", seen)
    found = G.leading_eigenvectors(G.neighbour_graph(frame(spark, ids, vec), 10), 3)
    assert np.allclose(found.values, value[:3], atol=1e-10) and found.vectors.count() == 180
    steps = [p for p in plans if "CartesianProduct" in p]
    assert len(steps) >= G.DEGREE + 1 and not any("Exchange" in p for p in steps)
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert len(G.leading_eigenvectors(none, 3).values) == 0
