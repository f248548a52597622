"""Registered queries over maps and building meshes (footprints derived from ``customer``, names from ``part``)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators import mesh as G
from pathloom.plans.common import publish, q, qs
from pathloom.sources import carriers as C

LAT0, LON0 = 60.18, 24.83  # fixed map origin


def _nodes(spark, d):
    """Star-shaped footprints: 4 to 8 nodes per customer around its own centre."""
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = F.pmod("k", F.lit(5)) + 4
    nd = c.select("k", n.cast("int").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a = F.lit(2.0 * math.pi) * F.col("i") / F.col("n")
    r = (F.pmod(F.col("k") * 7 + F.col("i") * 3, F.lit(6)) + 5) * 1e-5
    return nd.select(
        "k",
        "n",
        "i",
        F.concat_ws("_", "k", "i").alias("id"),
        (F.lit(LAT0) + F.pmod("k", F.lit(40)) * 1e-3 + r * F.sin(a)).alias("lat"),
        (F.lit(LON0) + F.floor(F.col("k") / 40) * 1e-3 + r * F.cos(a)).alias("lon"),
    )


def _buildings(spark, d):
    """Closed node lists; every third runs clockwise and every eleventh misses a node."""
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_mktsegment")
    idx = F.sequence(F.lit(0), (F.pmod("k", F.lit(5)) + 3).cast("int"))
    idx = F.when(F.pmod("k", F.lit(3)) == 0, F.reverse(idx)).otherwise(idx)
    refs = F.transform(idx, lambda i: F.concat_ws("_", F.col("k"), i))
    refs = F.when(F.pmod("k", F.lit(11)) == 0, F.array_append(refs, F.lit("gone"))).otherwise(refs)
    level = F.floor(F.pmod("k", F.lit(9))).cast("string")
    tags = F.create_map(
        F.lit("building"), F.lit("yes"),
        F.lit("height"), F.when(F.pmod("k", F.lit(2)) == 0, F.concat(F.pmod("k", F.lit(30)) + 3, F.lit(" m"))).otherwise(F.lit("")),
        F.lit("building:levels"), level,
        F.lit("building:material"), F.col("c_mktsegment"),
    )
    ways = c.select(F.col("k").cast("string").alias("id"), F.concat(refs, F.slice(refs, 1, 1)).alias("refs"), tags.alias("tags"))
    return G.building_ways(ways)


def _rings(spark, d):
    return G.resolve_rings(_buildings(spark, d), _nodes(spark, d).select("id", "lat", "lon"), F.lit(LAT0), F.lit(LON0))


def latlon_xy(spark, d):
    """Map coordinates to metres and back."""
    x, y = X.latlon_to_xy(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0))
    n = _nodes(spark, d).select("id", x.alias("x"), y.alias("y"))
    lat, lon = X.xy_to_latlon(F.col("x"), F.col("y"), F.lit(LAT0), F.lit(LON0))
    return publish(n.select("id", "x", "y", lat.alias("lat"), lon.alias("lon")))


def building_attributes(spark, d):
    """Height and material of every part-derived building tag."""
    p = C.table(spark, d, "part")
    text = F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.concat(F.col("p_size"), F.lit(" m"))).when(
        F.pmod("p_partkey", F.lit(4)) == 1, F.concat(F.col("p_size"), F.lit(".5m"))
    ).when(F.pmod("p_partkey", F.lit(4)) == 2, F.lit("")).otherwise(F.lit("abc"))
    levels = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.pmod("p_size", F.lit(5)).cast("string")).otherwise(F.lit(None))
    label = F.concat_ws(" ", "p_name", F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.lit("Glass")).when(F.pmod("p_partkey", F.lit(5)) == 1, F.lit("STEEL")).when(F.pmod("p_partkey", F.lit(5)) == 2, F.lit("timber")))
    return publish(p.select("p_partkey", X.parse_height(text).alias("parsed"), X.building_height(text, levels).alias("height"), X.material(label).alias("material")))


def polygon_area(spark, d):
    r = _rings(spark, d)
    return publish(r.select("id", F.size("ring").alias("n"), G.signed_area(F.col("ring")).alias("area"), "height"))


def ear_clip(spark, d):
    """Triangle count and summed triangle area of every footprint."""
    r = _rings(spark, d).withColumn("ring", G.ensure_ccw(F.col("ring"))).withColumn("tri", G.ear_clip("ring"))
    t = r.select("id", "ring", F.explode("tri").alias("t"))
    a, b, c = (F.get(F.col("ring"), F.col(f"t.{v}")) for v in "ijk")
    area = ((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) * 0.5
    return publish(t.groupBy("id").agg(F.count("*").alias("n_tri"), F.sum(area).alias("area")))


def building_mesh(spark, d):
    m = G.extrude(_rings(spark, d))
    return publish(m.select("id", "material", "height", F.size("vertices").alias("n_vertices"), F.size("faces").alias("n_faces")))


def building_vertices(spark, d):
    """The vertices of ``building_mesh``, one row each."""
    v = G.extrude(_rings(spark, d)).select("id", F.posexplode("vertices").alias("vertex", "v"))
    return publish(v.select("id", "vertex", "v.x", "v.y", "v.z"))


def building_faces(spark, d):
    """The triangles of ``building_mesh`` as vertex numbers, one row each."""
    f = G.extrude(_rings(spark, d)).select("id", F.posexplode("faces").alias("face", "f"))
    return f.select("id", "face", "f.i", "f.j", "f.k")


def ground_plane(spark, d):
    x, y = X.latlon_to_xy(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0))
    g = G.ground_plane(_nodes(spark, d).select(x.alias("x"), y.alias("y")))
    return publish(g.select("x0", "x1", "y0", "y1", F.size("vertices").alias("n_vertices"), F.size("faces").alias("n_faces")))


def mesh_names(spark, d):
    """Slugs of part names, repeated ones numbered in key order."""
    p = C.table(spark, d, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))
    return G.number_duplicates(p, "slug", "p_partkey").select("p_partkey", "name")


def inside_triangle(spark, d):
    """Footprint centre against each triangle fan piece around the first node."""
    n = _nodes(spark, d)
    x, y = X.latlon_to_xy(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0))
    p = n.select("k", "n", "i", F.struct(x.alias("x"), y.alias("y")).alias("p"))
    r = p.groupBy("k", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda e: e["p"]).alias("r"))
    cx = F.lit(LON0) + F.floor(F.col("k") / 40) * 1e-3
    cy = F.lit(LAT0) + F.pmod("k", F.lit(40)) * 1e-3
    x0, y0 = X.latlon_to_xy(cy, cx, F.lit(LAT0), F.lit(LON0))
    t = r.select("k", x0.alias("px"), (y0 + 1.0).alias("py"), "r", F.explode(F.sequence(F.lit(1), F.col("n") - 2)).alias("j"))
    a, b, c = F.get("r", F.lit(0)), F.get("r", F.col("j")), F.get("r", F.col("j") + 1)
    hit = X.point_in_triangle(F.col("px"), F.col("py"), a["x"], a["y"], b["x"], b["y"], c["x"], c["y"])
    return t.select("k", "j", hit.cast("int").alias("inside"))


_NODES = f"""nodes AS (SELECT c_custkey AS k, CAST(c_custkey % 5 + 4 AS INTEGER) AS n, i.i AS i, concat(c_custkey, '_', i.i) AS id,
    {LAT0}::DOUBLE + (c_custkey % 40) * 1e-3 + ((c_custkey*7 + i.i*3) % 6 + 5) * 1e-5 * sin({2 * math.pi!r}::DOUBLE * i.i / (c_custkey % 5 + 4)) AS lat,
    {LON0}::DOUBLE + (c_custkey // 40) * 1e-3 + ((c_custkey*7 + i.i*3) % 6 + 5) * 1e-5 * cos({2 * math.pi!r}::DOUBLE * i.i / (c_custkey % 5 + 4)) AS lon
    FROM customer CROSS JOIN range(0, 8) i(i) WHERE i.i < c_custkey % 5 + 4),
  xy AS (SELECT *, 6371000.0::DOUBLE * radians(lon - {LON0}::DOUBLE) * cos(radians({LAT0}::DOUBLE)) AS x, 6371000.0::DOUBLE * radians(lat - {LAT0}::DOUBLE) AS y FROM nodes)"""
_AREA = """ar AS (SELECT a.k, a.n, sum(a.x*b.y - b.x*a.y) * 0.5 AS area FROM xy a JOIN xy b ON a.k = b.k AND b.i = (a.i + 1) % a.n WHERE a.k % 11 <> 0 GROUP BY a.k, a.n)"""
_HT = "CASE WHEN k % 2 = 0 THEN CAST(k % 30 + 3 AS DOUBLE) WHEN k % 9 > 0 THEN (k % 9) * 3.0::DOUBLE ELSE 8.0::DOUBLE END"

QUERIES = {
    f.__name__: f
    for f in (
        latlon_xy, building_attributes, polygon_area, ear_clip, building_mesh, building_vertices, building_faces, ground_plane, mesh_names,
        inside_triangle,
    )
}

ORACLES = {
    "latlon_xy": f"""WITH {_NODES} SELECT id, {qs('x', 'y')}, {q(f'{LAT0}::DOUBLE + y / 111320.0::DOUBLE', 'lat')},
        {q(f'{LON0}::DOUBLE + x / (111320.0::DOUBLE * cos(radians({LAT0}::DOUBLE)))', 'lon')} FROM xy""",
    "building_attributes": f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS parsed,
          CASE WHEN p_partkey % 3 = 0 THEN (p_size % 5) * 3.0::DOUBLE ELSE 0 END AS lv FROM part)
        SELECT p_partkey, {qs('parsed')}, {q('CASE WHEN parsed > 0 THEN parsed WHEN lv > 0 THEN lv ELSE 8 END', 'height')},
          CASE p_partkey % 5 WHEN 0 THEN 'itu_glass' WHEN 1 THEN 'itu_metal' WHEN 2 THEN 'itu_wood' ELSE 'itu_concrete' END AS material FROM t""",
    "polygon_area": f"""WITH {_NODES}, {_AREA} SELECT CAST(k AS VARCHAR) AS id, n, {q('CASE WHEN k % 3 = 0 THEN -area ELSE area END', 'area')}, {q(_HT, 'height')} FROM ar""",
    "ear_clip": f"""WITH {_NODES}, {_AREA} SELECT CAST(k AS VARCHAR) AS id, CAST(n - 2 AS BIGINT) AS n_tri, {qs('area')} FROM ar""",
    "building_mesh": f"""WITH {_NODES}, {_AREA} SELECT CAST(k AS VARCHAR) AS id, 'itu_concrete' AS material, {q(_HT, 'height')},
        CAST(2*n AS INTEGER) AS n_vertices, CAST(2*n + 2*(n-2) AS INTEGER) AS n_faces FROM ar""",
    "ground_plane": f"""WITH {_NODES} SELECT {q('min(x)-5', 'x0')}, {q('max(x)+5', 'x1')}, {q('min(y)-5', 'y0')}, {q('max(y)+5', 'y1')}, 4 AS n_vertices, 2 AS n_faces FROM xy""",
    "mesh_names": """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)
        SELECT p_partkey, CASE WHEN r = 1 THEN slug WHEN r < 1000 THEN concat(slug, '_', lpad(CAST(r AS VARCHAR), 3, '0')) ELSE concat(slug, '_', r) END AS name FROM s""",
    "inside_triangle": f"""WITH {_NODES}, t AS (SELECT a.k, b.i AS j, 6371000.0::DOUBLE * radians({LON0}::DOUBLE + (a.k // 40) * 1e-3 - {LON0}::DOUBLE) * cos(radians({LAT0}::DOUBLE)) AS px,
          6371000.0::DOUBLE * radians({LAT0}::DOUBLE + (a.k % 40) * 1e-3 - {LAT0}::DOUBLE) + 1 AS py, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy
          FROM xy a JOIN xy b ON a.k = b.k AND a.i = 0 AND b.i BETWEEN 1 AND a.n - 2 JOIN xy c ON c.k = a.k AND c.i = b.i + 1),
        s AS (SELECT k, j, (ax-px)*(by_-py)-(ay-py)*(bx-px) AS d1, (bx-px)*(cy-py)-(by_-py)*(cx-px) AS d2, (cx-px)*(ay-py)-(cy-py)*(ax-px) AS d3 FROM t)
        SELECT k, CAST(j AS INTEGER) AS j, CAST(NOT (least(d1, d2, d3) < 0 AND greatest(d1, d2, d3) > 0) AS INTEGER) AS inside FROM s""",
}
