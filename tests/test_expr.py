"""Scalar functions against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from pathloom import config as CFG
from pathloom.functions import expr as X
from pathloom.schema import group_widths


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_levels(spark):
    r = one(spark, X.amp_to_db(F.lit(0.1)), X.db_to_linear(F.lit(-10.0)), X.power_to_db(F.lit(0.2)), X.path_loss_db(F.lit(1e-3)))
    assert r[0] == pytest.approx(-20.0) and r[1] == pytest.approx(0.1)
    assert r[2] == pytest.approx(-6.989700, abs=1e-6) and r[3] == pytest.approx(60.0)


def test_validity(spark):
    rows = [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (float("nan"), 1.0), (float("inf"), 1.0), (1.0, 1e-21), (-1.0, 1.0)]
    d = spark.createDataFrame(rows, "t double, a double")
    got = d.select(
        X.valid_path(F.col("t"), F.col("a")).alias("s"),
        X.valid_path_export(F.col("t"), F.col("a")).alias("e"),
        X.valid_path_compare(F.col("t"), F.col("a")).alias("c"),
    ).collect()
    assert [r["s"] for r in got] == [True, False, False, False, False, True, False]
    assert [r["e"] for r in got][:3] == [True, True, False] and not got[5]["e"] and not got[6]["e"]
    assert [r["c"] for r in got] == [True, False, False, False, False, False, False]


def test_heights_and_materials(spark):
    d = spark.createDataFrame([("10 m",), ("10.5m",), ("",), ("abc",), (None,), ("7 M tall",)], "s string")
    assert [r[0] for r in d.select(X.parse_height(F.col("s"))).collect()] == [10.0, 10.5, 0.0, 0.0, 0.0, 7.0]
    b = spark.createDataFrame([("12", None), ("", "4"), (None, None)], "h string, l string")
    assert [r[0] for r in b.select(X.building_height(F.col("h"), F.col("l"))).collect()] == [12.0, 12.0, 8.0]
    m = spark.createDataFrame([("Glass wall",), ("steel",), ("Timber",), (None,)], "s string")
    assert [r[0] for r in m.select(X.material(F.col("s"))).collect()] == ["itu_glass", "itu_metal", "itu_wood", "itu_concrete"]
    s = spark.createDataFrame([(" a b/c ",), ("__x-1__",), ("//",), (None,)], "s string")
    assert [r[0] for r in s.select(X.slugify(F.col("s"))).collect()] == ["a_b_c", "x-1", "mesh", "mesh"]


def test_geometry(spark):
    x, y = X.latlon_to_xy(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    az, el = X.az_el_deg(F.lit(0.0), F.lit(2.0), F.lit(0.0))
    a2, e2 = X.aod_deg(F.lit(False), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(10.0))
    r = one(spark, x, y, az, el, a2, e2, X.checkerboard_parity(F.lit(2.5), F.lit(0.0), 0.0, 0.0, 2.5))
    assert r[0] == pytest.approx(0.0) and r[1] == pytest.approx(111194.926645, abs=1e-5)
    assert (r[2], r[3]) == (pytest.approx(90.0), pytest.approx(0.0))
    assert (r[4], r[5]) == (pytest.approx(-150.0), pytest.approx(-10.0)) and r[6] == 1
    cell = one(spark, X.grid_index(F.lit(1.25), -1.25, 2.5, 2), X.cell_centre(F.lit(1), -1.25, 2.5), X.grid_index(F.lit(-9.0), -1.25, 2.5, 2), X.grid_index(F.lit(99.0), -1.25, 2.5, 2))
    assert (cell[0], cell[1], cell[2], cell[3]) == (1, 2.5, 0, 1)
    p = one(spark, X.point_in_triangle(*map(F.lit, (0.2, 0.2, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0))), X.point_in_triangle(*map(F.lit, (0.5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0))), X.point_in_triangle(*map(F.lit, (2.0, 0.2, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0))))
    assert tuple(p) == (True, True, False)


def test_complex(spark):
    re, im = X.phasor(F.lit(2.0), F.lit(1e9), F.lit(0.25e-9))
    gr, gi = X.gain_from_path_loss(F.lit(20.0), F.lit(math.pi / 2))
    r = one(spark, re, im, gr, gi, X.c_abs(F.lit(3.0), F.lit(4.0)))
    assert r[0] == pytest.approx(0.0, abs=1e-12) and r[1] == pytest.approx(-2.0)
    assert r[2] == pytest.approx(0.0, abs=1e-12) and r[3] == pytest.approx(0.1) and r[4] == 5.0
    assert one(spark, X.decimate(F.sequence(F.lit(0), F.lit(9)), 4))[0] == [0, 4, 8]


def test_labels(spark):
    e = F.array(F.lit("rss"), F.lit("tdoa"), F.lit("cov_eigenvalues"))
    r = one(spark, X.feature_abbrev(e), X.feature_abbrev(F.array().cast("array<string>")), X.method_prefix(F.lit("WKNN (IDW)")), X.high_verdict(F.lit(0.85)), X.low_verdict(F.lit(0.3)), X.accuracy_label(F.lit(120.4)), X.latex_escape(F.lit("a_b&c")))
    assert tuple(r) == ("TDoA+RSS+CovE", "—", "WKNN_IDW", "ok", "poor", "120 m — neighbourhood level", "a\\_b\\&c")


def test_layout():
    w = group_widths(9, 3168)
    assert list(w.values()) == [3555, 36, 36, 9, 9, 9, 27, 9] and sum(w.values()) == 3690


def test_config(tmp_path, monkeypatch):
    monkeypatch.delenv("SCENE_NAME", raising=False)
    with pytest.raises(FileNotFoundError):
        CFG.load_scene(tmp_path, "s")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "scene_config.json").write_text('{"GRID_SPACING": 2.5}')
    cfg = CFG.load_scene(tmp_path, "s")
    assert cfg["fc"] == 3.6e9 and cfg["SCENE_XML_FILE_NAME"] == "s/s.xml"
    CFG.save_scene(tmp_path, cfg)
    assert "SPEED_OF_LIGHT" not in (tmp_path / "s" / "scene_config.json").read_text()
    c = CFG.FeaturesConfig().merged(
        {"fingerprint_features": {"tdoa": False, "rss": 0, "what": True}, "evaluation": {"test_fraction": True, "random_state": 7, "split_method": "block"}}
    )
    assert not c.fingerprint_features["tdoa"] and c.fingerprint_features["rss"] is True and "what" not in c.fingerprint_features
    assert c.evaluation["test_fraction"] == 0.3 and c.evaluation["random_state"] == 7 and c.evaluation["split_method"] == "block"
    with pytest.raises(ValueError):
        CFG.write_features(tmp_path, "s", ["nope"])
    CFG.write_features(tmp_path, "s", ["rss", "aoa"])
    f = CFG.load_features(tmp_path, "s")
    assert f.enabled_features() == ["aoa", "rss"] and f.localization["wknn"] and not f.channel_charting["pca"]
    assert CFG.cache_tag(["rss", "aoa"], 2.5, 9, 3168) == "gs2.5_ntx9_fft3168_feat-aoa-rss"
