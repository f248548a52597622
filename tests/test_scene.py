"""Map reading, meshes, sinks and the published comparison table."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from pathloom.operators import evaluate as EV
from pathloom.operators import links as L
from pathloom.operators import mesh as G
from pathloom.schema import PATHS, RX, TX
from pathloom.sources import ingest as I
from pathloom.sources import sinks as K

OSM = """<?xml version="1.0"?><osm><bounds minlat="60.0" minlon="24.0" maxlat="60.002" maxlon="24.002"/>
<node id="1" lat="60.0" lon="24.0"/><node id="2" lat="60.0" lon="24.001"/><node id="3" lat="60.001" lon="24.001"/><node id="4" lat="60.001" lon="24.0"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="building" v="yes"/><tag k="height" v="12 m"/><tag k="building:material" v="Glass"/></way>
<way id="11"><nd ref="1"/><nd ref="99"/><nd ref="3"/><tag k="building" v="yes"/></way>
<way id="12"><nd ref="1"/><nd ref="2"/></way><way id="13"><nd ref="3"/><nd ref="2"/></way><way id="14"><nd ref="3"/><nd ref="4"/><nd ref="1"/></way>
<way id="15"><nd ref="1"/><nd ref="3"/><tag k="highway" v="path"/></way>
<relation id="20"><member type="way" ref="12" role="outer"/><member type="way" ref="13" role="outer"/><member type="way" ref="14" role="outer"/><member type="way" ref="15" role="inner"/><tag k="type" v="multipolygon"/><tag k="building" v="yes"/><tag k="building:levels" v="2"/></relation></osm>"""


def test_osm_to_meshes(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    m = I.read_osm(spark, str(tmp_path / "a.osm"))
    assert m["nodes"].count() == 4 and m["bounds"].first()["max_lat"] == 60.002
    b = G.building_ways(m["ways"]).unionByName(G.building_relations(m["relations"], m["ways"]))
    got = {r["id"]: r for r in b.collect()}
    assert got["10"]["refs"] == ["1", "2", "3", "4"] and got["10"]["height"] == 12.0 and got["10"]["material"] == "itu_glass"
    assert got["rel_20"]["refs"][:4] == ["1", "2", "3", "4"] and got["rel_20"]["height"] == 6.0
    rings = G.resolve_rings(b, m["nodes"], F.lit(60.001), F.lit(24.001))
    assert {r["id"] for r in rings.collect()} == {"10", "rel_20"}  # way 11 misses a node
    mesh = G.extrude(rings.filter("id = '10'")).withColumn("name", F.concat(F.lit("building_"), "id"))
    r = mesh.first()
    assert len(r["vertices"]) == 8 and len(r["faces"]) == 8 + 2 + 2
    K.write_ply(mesh, str(tmp_path / "ply"))
    raw = (tmp_path / "ply" / "building_10.ply").read_bytes()
    head, body = raw.split(b"end_header\n")
    assert b"element vertex 8" in head and b"element face 12" in head and len(body) == 8 * 12 + 12 * 13
    assert struct.unpack("<Biii", body[96:109])[0] == 3
    lines = [x["line"] for x in K.scene_xml_lines(mesh).collect()]
    assert lines[0].startswith("<scene") and lines[-1] == "</scene>" and any("building_10.ply" in x for x in lines)


def test_rings():
    assert G.chain_segments([["a", "b"], ["c", "b"], ["c", "d"], ["a", "z"]]) == ["z", "a", "b", "c", "d"]
    assert G.chain_segments([["a", "b"], ["x", "y"]]) == ["a", "b", "x", "y"]
    closed = G.chain_segments([["a", "b", "c"], ["e", "d", "c"], ["e", "a"]])
    assert closed == ["a", "b", "c", "d", "e", "a"]
    many = [[str(i), str(i + 1)] if i % 3 else [str(i + 1), str(i)] for i in range(5000)]
    assert G.chain_segments(many[2500:] + many[:2500][::-1]) == [str(i) for i in range(5001)]


def test_polygons(spark):
    d = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]), (2, [(0.0, 1.0), (2.0, 1.0), (2.0, 0.0), (0.0, 0.0)]), (3, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])], "id int, ring array<struct<x:double,y:double>>")
    a = {r["id"]: r["a"] for r in d.select("id", G.signed_area(F.col("ring")).alias("a")).collect()}
    assert a == {1: 2.0, 2: -2.0, 3: 10.0}
    t = {r["id"]: r["t"] for r in d.select("id", G.ear_clip(G.ensure_ccw(F.col("ring"))).alias("t")).collect()}
    assert len(t[1]) == 2 and len(t[2]) == 2 and len(t[3]) == 3  # the last ring is concave
    assert G.triangulate([(0, 0), (1, 0)]) == [] and G.triangulate([(0, 0), (1, 0), (0, 1)]) == [(0, 1, 2)]


def test_names(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 700)).alias("nm"))
    got = {r["id"]: r["name"] for r in G.number_duplicates(d, "nm", "id").collect()}
    assert got[0] == "hot" and got[3] == "hot_002" and got[2997] == "hot_1000" and got[1] == "n1" and len(set(got.values())) == 3000


def test_cache_and_tables(spark, tmp_path):
    fp = spark.createDataFrame([(1, 0.0, 0.0, [1.0])], "rx_id bigint, x double, y double, f_rss array<double>")
    path = str(tmp_path / "cache")
    assert not K.cache_hit(spark, path, 1, 9, 64, "t")
    K.write_fingerprints(fp, path, "t", 9, 64)
    assert K.cache_hit(spark, path, 1, 9, 64, "t") and not K.cache_hit(spark, path, 1, 9, 64, "other")
    assert K.read_fingerprints(spark, path).count() == 1
    p = spark.createDataFrame([(1, 0, 1, 5.0, 0.1, 10.0, 20.0), (1, 0, 2, 7.0, 0.0, 10.0, 20.0), (1, 0, 3, 9.0, 0.01, 30.0, 5.0)], PATHS)
    assert K.write_path_csv(p, str(tmp_path / "csv")) and not K.write_path_csv(p.filter("amp = 0"), str(tmp_path / "none"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2 and not os.path.exists(tmp_path / "none")
    tx = spark.createDataFrame([(0, 0.0, 0.0, 19.0, 30.0, 0.0)], TX)
    rx = spark.createDataFrame([(1, 0, 0, 10.0, 0.0, 19.0)], RX)
    w = {r["path_index"]: r for r in K.wide_paths(p, tx, rx, "sim", 3.6e9).collect()}
    assert len(w[1]) == 17 and w[1]["az_aod_deg"] == pytest.approx(0.0) and w[3]["az_aod_deg"] == pytest.approx(-150.0)
    assert K.schema_table({"fp": fp})[0] == ("fp/f_rss", "column", "array<double>")
    charts = spark.createDataFrame([("pca", 1, 0.0, 1.0)], "method string, rx_id bigint, z1 double, z2 double")
    K.write_charts(charts, charts.select("method"), str(tmp_path / "ch"))
    assert K.read_charts(spark, str(tmp_path / "ch"))[0].count() == 1


def test_summaries(spark, tmp_path):
    for name, combo, mae in (("A", "A", 2.0), ("No B", "", 1.0)):
        (tmp_path / name).mkdir()
        doc = {"combo_name": combo, "n_features": 3, "enabled_features": ["rss"], "methods": {"WKNN (IDW)": {"mae": mae, "rmse": 1, "median": 1, "p90": 1, "p95": 1}}}
        (tmp_path / name / "localization_summary.json").write_text(json.dumps(doc, indent=1))
    s = I.read_summaries(spark, str(tmp_path))
    assert {r["combo"]: r["mae"] for r in s.collect()} == {"A": 2.0, "No B": 1.0}
    md = K.markdown_table(EV.sort_table(EV.comparison_table(s)), ["combo", "wknn_mae", "nn_mae"])
    assert md.splitlines()[2] == "| No B | 1.00 | — |"
    m = spark.createDataFrame([("w", 1.0, 2.0, 3.0, 4.0, 5.0)], "method string, mae double, rmse double, median double, p90 double, p95 double")
    K.write_summary(m, str(tmp_path / "out"), combo_name="A", n_features=3)
    assert spark.read.json(str(tmp_path / "out")).first()["methods"]["w"]["p95"] == 5.0


def test_tensor_json(spark, tmp_path):
    (tmp_path / "locs.json").write_text("[[1, 2, 1, 1], [3, 4, 2, 0]]")
    (tmp_path / "aoa.json").write_text("[[[90, 0, 0.1], [0, 0, 0]], [[0, 90, 0.01], [45, 45, 1]]]")
    (tmp_path / "timing.json").write_text("[[[5, 1, 0], [0, 0, 0]], [[7, 1, 0], [9, 1, 1]]]")
    r = lambda n, d: I.read_tensor_json(spark, str(tmp_path / f"{n}.json"), d)
    links = I.tensor_links(r("locs", 2), r("aoa", 3), r("timing", 3))
    rows = {(x["rx_id"], x["tx_id"]): x for x in links.collect()}
    assert rows[0, 0]["rss"] == pytest.approx(-20) and rows[0, 0]["sin_az"] == pytest.approx(1.0) and not rows[0, 1]["reached"]
    grid = L.link_grid(spark.createDataFrame([(0,), (1,)], "rx_id bigint"), links.filter("reached"), 2)
    g = {(x["rx_id"], x["tx_id"]): x for x in L.impute_links(grid).collect()}
    assert g[0, 1]["rss"] == pytest.approx(-10.0) and g[0, 1]["delay"] == 9.0 and rows[1, 0]["x"] == 3.0


GOLD = os.environ.get("PATHLOOM_GOLDEN_TABLE", "")  # a published comparison table


@pytest.mark.skipif(not os.path.exists(GOLD), reason="published table not available")
def test_published_table(spark):
    t = spark.read.csv(GOLD, header=True, inferSchema=True)
    s = None
    for name, prefix in EV.TABLE_METHODS:
        if f"{prefix}_mae" in t.columns:
            one = t.select("combo", F.col("n_feat").cast("int"), F.array().cast("array<string>").alias("enabled"), F.lit(name).alias("method"), *[F.col(f"{prefix}_{c}").cast("double").alias(c) for c in ("mae", "rmse", "p90")])
            s = one if s is None else s.unionByName(one)
    got = {r["combo"]: r for r in EV.comparison_table(s).collect()}
    for r in t.collect():
        assert got[r["combo"]]["best_mae"] == pytest.approx(r["best_mae"]) and got[r["combo"]]["best_method"] == r["best_method"]
    assert EV.sort_table(EV.comparison_table(s), "best_mae").first()["combo"] == "Light"


def test_frequency_rows_keep_links_without_position(spark):
    band = spark.createDataFrame([(1, 0, [3.0, 0.0], [4.0, 0.0]), (2, 0, [1.0, 0.0], [0.0, -1.0])], "rx_id long, tx_id int, h_re array<double>, h_im array<double>")
    at = "x double, y double, z double"
    tx = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], f"tx_id int, {at}")
    rx = spark.createDataFrame([(1, 7.0, 8.0, 9.0)], f"rx_id long, {at}")
    out = K.wide_frequencies(band, tx, rx, "s", fft_size=4, spacing_hz=10.0, fc=100.0, step=2)
    assert len(out.columns) == 15
    rows = sorted(out.collect(), key=lambda r: (r["ue_x"] is None, r["subcarrier_index"]))
    assert [(r["ue_x"], r["bs_z"], r["subcarrier_index"], r["subcarrier_freq_Hz"]) for r in rows] == [(7, 3, 0, 80), (7, 3, 2, 100), (None, 3, 0, 80), (None, 3, 2, 100)]
    assert [r["H_magnitude"] for r in rows] == [5, 0, 1, 1] and rows[3]["H_phase_deg"] == -90
    assert K.wide_frequencies(band.limit(0), tx, rx, "s", 4, 10.0, 100.0, 2).count() == 0
