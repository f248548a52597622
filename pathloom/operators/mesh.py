"""Building meshes from map data: node lookup, rings, triangulation and extrusion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import expr as X
from pathloom.operators.evaluate import running_sum

FACES = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "ijk"]))


# ---------------------------------------------------------------- rings
def open_ring(refs: Column) -> Column:
    """Drop the repeated last reference of a closed way."""
    closed = (F.size(refs) > 1) & (F.element_at(refs, 1) == F.element_at(refs, -1))
    return F.when(closed, F.slice(refs, 1, F.size(refs) - 1)).otherwise(refs)


def building_attributes(tags: Column) -> list[Column]:
    h = X.building_height(F.element_at(tags, "height"), F.element_at(tags, "building:levels"))
    return [h.alias("height"), X.material(F.element_at(tags, "building:material")).alias("material")]


def building_ways(ways: DataFrame) -> DataFrame:
    return ways.filter(F.map_contains_key("tags", "building")).select(
        "id", open_ring(F.col("refs")).alias("refs"), *building_attributes(F.col("tags"))
    )


def chain_segments(segments: list[list[str]]) -> list[str]:
    """Walk the graph whose nodes are segment ends and whose edges are segments, from the first one forwards, then backwards.

    At a node the earliest unused segment is taken; a closed ring is used up on the way forwards. Segments that the walk
    does not reach are appended as they are. Linear in the number of segments.
    """
    at_node: dict[str, list[int]] = {}
    for number in range(len(segments) - 1, 0, -1):  # the earliest is on top
        for node in {segments[number][0], segments[number][-1]}:
            at_node.setdefault(node, []).append(number)
    unused = set(range(1, len(segments)))

    def walk(node: str) -> list[str]:
        passed: list[str] = []
        stack = at_node.get(node, [])
        while stack:
            number = stack.pop()
            if number in unused:
                unused.discard(number)
                way = segments[number] if segments[number][0] == node else segments[number][::-1]
                passed.extend(way[1:])
                node = way[-1]
                stack = at_node[node]
        return passed

    ahead = walk(segments[0][-1])
    behind = walk(segments[0][0])
    left = [node for number in sorted(unused) for node in segments[number]]
    return [*reversed(behind), *segments[0], *ahead, *left]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chained(segments: pd.Series) -> pd.Series:
    return segments.map(lambda s: chain_segments([list(v) for v in s]))


def building_relations(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Outer rings of multipolygon buildings. A relation's members are one polygon: a short list."""
    r = relations.filter(
        (F.element_at("tags", "type") == "multipolygon") & F.map_contains_key("tags", "building")
    )
    way = F.filter("members", lambda m: m["type"] == "way")
    r = r.withColumn("m", way).withColumn("has_outer", F.exists("m", lambda m: m["role"] == "outer"))
    members = r.select("id", "tags", "has_outer", F.posexplode("m").alias("ord", "w"))
    role = F.coalesce("w.role", F.lit(""))
    members = members.filter(F.when(F.col("has_outer"), role == "outer").otherwise(role != "inner"))
    seg = members.join(
        ways.select(F.col("id").alias("way_id"), open_ring(F.col("refs")).alias("refs")),
        F.col("w.ref") == F.col("way_id"),
    ).filter(F.size("refs") >= 2)
    rings = seg.groupBy("id").agg(
        F.first("tags").alias("tags"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "refs"))), lambda s: s["refs"]).alias("segments"),
    )
    return (
        rings.select(
            F.concat(F.lit("rel_"), "id").alias("id"), _chained("segments").alias("refs"), *building_attributes(F.col("tags"))
        )
        .filter(F.size("refs") >= 3)
    )


def resolve_rings(buildings: DataFrame, nodes: DataFrame, lat0: Column, lon0: Column) -> DataFrame:
    """Replace node references by local coordinates; a ring with a missing node or fewer than
    three points is dropped."""
    refs = buildings.select("id", F.size("refs").alias("n"), F.posexplode("refs").alias("ord", "ref"))
    x, y = X.latlon_to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    got = refs.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref").select(
        "id", "n", "ord", F.struct(x.alias("x"), y.alias("y")).alias("p")
    )
    ring = (
        got.groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "p"))).alias("s"))
        .filter((F.size("s") == F.col("n")) & (F.col("n") >= 3))
        .select("id", F.transform("s", lambda e: e["p"]).alias("ring"))
    )
    return buildings.drop("refs").join(ring, "id")


# ---------------------------------------------------------------- polygons
def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    n = F.size(ring)
    cross = F.transform(
        ring,
        lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"],
    )
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) * 0.5


def ensure_ccw(ring: Column) -> Column:
    return F.when(signed_area(ring) > 0, ring).otherwise(F.reverse(ring))


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _covers(a, b, c, p) -> bool:
    s = (_turn(a, b, p), _turn(b, c, p), _turn(c, a, p))
    return not (min(s) < 0 < max(s))


def triangulate(pts: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Clip ears of a counter-clockwise simple polygon; stops early on degenerate input."""
    left, out = list(range(len(pts))), []
    while len(left) > 3:
        m = len(left)
        ear = next(
            (
                v
                for v in range(m)
                if _turn(pts[left[v - 1]], pts[left[v]], pts[left[(v + 1) % m]]) > 0
                and not any(
                    _covers(pts[left[v - 1]], pts[left[v]], pts[left[(v + 1) % m]], pts[left[o]])
                    for o in range(m)
                    if o not in ((v - 1) % m, v, (v + 1) % m)
                )
            ),
            None,
        )
        if ear is None:
            return out
        out.append((left[ear - 1], left[ear], left[(ear + 1) % m]))
        left.pop(ear)
    return out + [tuple(left)] if len(left) == 3 else out


@F.pandas_udf(FACES)
def ear_clip(ring: pd.Series) -> pd.Series:
    """Triangles of each ring as index triples (a footprint is a short list)."""
    return ring.map(
        lambda r: [dict(zip("ijk", map(int, t))) for t in triangulate([(p["x"], p["y"]) for p in r])]
    )


def extrude(buildings: DataFrame) -> DataFrame:
    """Closed meshes: (.., vertices, faces) from (ring, height): two wall triangles per edge,
    the floor facing down and the roof facing up."""
    b = buildings.withColumn("ring", ensure_ccw(F.col("ring"))).withColumn("tri", ear_clip("ring"))
    n = F.size("ring")

    def face(i, j, k):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))

    walls = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.array(face(i, (i + 1) % n, (i + 1) % n + n), face(i, (i + 1) % n + n, i + n)),
        )
    )
    floor = F.transform("tri", lambda t: face(t["i"], t["k"], t["j"]))
    roof = F.transform("tri", lambda t: face(t["i"] + n, t["j"] + n, t["k"] + n))

    def lift(z):
        return F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z")))

    return b.withColumn("vertices", F.concat(lift(F.lit(0.0)), lift(F.col("height")))).withColumn(
        "faces", F.concat(walls, floor, roof)
    )


def ground_plane(points: DataFrame, pad: float = 5.0) -> DataFrame:
    """Padded bounding rectangle as a two-triangle mesh (one row)."""
    b = points.agg(
        (F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"), (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1")
    )
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("z"))
    tri = lambda i, j, k: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
    return b.select(
        "*",
        F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("vertices"),
        F.array(tri(0, 1, 2), tri(0, 2, 3)).alias("faces"),
    )


# ---------------------------------------------------------------- names
def number_duplicates(df: DataFrame, name: str, order: str) -> DataFrame:
    """Append _002, _003, ... to repeated names, in ``order`` (a numeric, unique column).

    A name may be very common, so it is not numbered in one window but by a running count over ranges.
    """
    out = running_sum(df.withColumn("_one", F.lit(1)), [name], order, "_one", "_pos")
    suffix = F.concat(F.lit("_"), F.lpad(F.col("_pos").cast("string"), 3, "0"))
    long = F.concat(F.lit("_"), F.col("_pos").cast("string"))
    numbered = F.when(F.col("_pos") == 1, F.col(name)).otherwise(
        F.concat(name, F.when(F.col("_pos") < 1000, suffix).otherwise(long))
    )
    return out.withColumn("name", numbered).drop("_one", "_pos")
