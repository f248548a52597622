"""Queries on the whole band, all feature groups and whole meshes, against plain loops."""

import os

import numpy as np
import pytest

from pathloom.operators import features as FT
from pathloom.plans import feature_queries as FQ
from pathloom.plans import learning_queries as LQ
from pathloom.plans import scene_queries as SQ
from pathloom.schema import GROUP_COLUMNS
from pathloom.sources import carriers as C


@pytest.fixture(scope="module")
def tables(sf):
    if not os.path.isdir(sf):
        pytest.skip("test tables not available")
    return sf


def test_response_of_the_whole_band(spark, tables):
    got = {}
    for r in FQ.ofdm_response(spark, tables).collect():
        got.setdefault((r["rx_id"], r["tx_id"]), {})[r["k"]] = (r["h_re"], r["h_im"])
    f = (np.arange(0, 3168, 16) - 1584) * 30e3 + 3.6e9
    h = {}
    for p in C.event_paths(spark, tables).collect():
        if p["delay_ns"] > 0 and p["amp"] > 0:
            a = p["amp"] * np.exp(-2j * np.pi * f * p["delay_ns"] * 1e-9)
            h[p["rx_id"], p["tx_id"]] = h.get((p["rx_id"], p["tx_id"]), 0) + a
    assert set(got) == set(h)
    for link, want in h.items():
        assert sorted(got[link]) == list(range(0, 3168, 16))
        mine = np.array([complex(*got[link][k]) for k in sorted(got[link])])
        np.testing.assert_allclose(mine, want, atol=2e-6)


def test_positions_from_all_groups(spark, tables):
    fp = FT.build_fingerprints(C.event_paths(spark, tables), C.event_rx(spark, tables), C.N_TX, ofdm=FQ.AXIS).orderBy("rx_id").collect()
    parts = [np.array([r[c] for r in fp]) for c in GROUP_COLUMNS.values()]
    assert [p.shape[1] for p in parts] == [5 * (2 * 198 - 1), 10, 20, 5, 5, 5, 15, 5]
    ids, xy = np.array([r["rx_id"] for r in fp]), np.array([(r["x"], r["y"]) for r in fp])
    test = ids % 10 < 3
    made = []
    for p in parts:
        sd = p[~test].std(axis=0)
        made.append((p - p[~test].mean(axis=0)) / np.where(sd > 1e-12, sd, 1) / np.sqrt(p.shape[1]))
    vec = np.concatenate(made, axis=1)
    errors = []
    for v, at in zip(vec[test], xy[test]):
        d = np.sqrt(((vec[~test] - v) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:5]
        w = 1 / (d[near] + 1e-10)
        errors.append(np.linalg.norm((w[:, None] * xy[~test][near]).sum(axis=0) / w.sum() - at))
    got = LQ.paths_to_position(spark, tables).first()
    want = {"n": len(errors), "mae": np.mean(errors), "rmse": np.sqrt(np.mean(np.square(errors))), "median": np.median(errors), "max_err": max(errors)}
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=2e-5)


def test_meshes_are_closed_and_whole(spark, tables):
    corners, faces = {}, {}
    for r in SQ.building_vertices(spark, tables).collect():
        corners.setdefault(r["id"], {})[r["vertex"]] = (r["x"], r["y"], r["z"])
    for r in SQ.building_faces(spark, tables).collect():
        faces.setdefault(r["id"], []).append((r["i"], r["j"], r["k"]))
    sizes = {r["id"]: (r["n_vertices"], r["n_faces"]) for r in SQ.building_mesh(spark, tables).collect()}
    assert sizes == {b: (len(corners[b]), len(faces[b])) for b in corners} and set(faces) == set(corners)
    for r in SQ.polygon_area(spark, tables).collect():
        p = np.array([corners[r["id"]][i] for i in range(len(corners[r["id"]]))])
        edges = [e for i, j, k in faces[r["id"]] for e in ((i, j), (j, k), (k, i))]
        assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
        p = p - p.mean(axis=0)
        volume = sum(np.dot(p[i], np.cross(p[j], p[k])) for i, j, k in faces[r["id"]]) / 6
        assert volume == pytest.approx(abs(r["area"]) * r["height"], rel=1e-4)
