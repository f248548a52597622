"""Readers: every one returns DataFrames and leaves the scan to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import schema as S
from pathloom.functions import expr as X


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Path table with the derived gain in dB."""
    return spark.read.parquet(path).withColumn("gain_db", X.amp_to_db(F.col("amp")))


def read_path_csv(spark: SparkSession, path: str) -> DataFrame:
    """Narrow path CSV: delay_ns, amplitude, gain_dB with a header."""
    return spark.read.csv(path, header=True, schema=S.PATHS_CSV)


def read_cir(spark: SparkSession, path: str) -> DataFrame:
    """Impulse responses stored as (re, im) pairs, with magnitude."""
    df = spark.read.parquet(path)
    return df.withColumn("amp", X.c_abs(F.col("a_re"), F.col("a_im")))


def read_rays(spark: SparkSession, path: str) -> DataFrame:
    """Ray table of an external simulator (ray-level rows with a receiver index)."""
    return spark.read.schema(S.RAYS).parquet(path)


def rays_to_paths(rays: DataFrame, rx: DataFrame) -> DataFrame:
    """Join rays to receivers on their index and bring them to the path layout."""
    amp = X.c_abs(F.col("gain_real"), F.col("gain_imag"))
    named = rays.select(
        F.col("rx_index").alias("rx_id"),
        F.col("tx_idx").alias("tx_id"),
        F.xxhash64("tx_idx", "rx_index", "delay", "aoa_az", "aoa_el").alias("path_id"),
        X.seconds_to_ns(F.col("delay")).alias("delay_ns"),
        amp.alias("amp"),
        F.col("aoa_az").alias("az_deg"),
        F.col("aoa_el").alias("el_deg"),
    )
    return named.join(rx.select("rx_id"), "rx_id", "left_semi")


def read_tensor_json(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """Nested-array JSON documents (one per file) as (file, i0, values) rows.

    ``depth`` counts array levels; the outer level is exploded, the rest stays an array.
    """
    kind = "double"
    for _ in range(depth):
        kind = f"array<{kind}>"
    doc = spark.read.text(path, wholetext=True)
    return doc.select(
        F.input_file_name().alias("file"), F.posexplode(F.from_json("value", kind)).alias("i0", "values")
    )


def tensor_links(locs: DataFrame, aoa: DataFrame, timing: DataFrame) -> DataFrame:
    """Align locations (ue), angle/level and timing tensors (ue x bts) into one link table.

    All-zero triples mean "no link"; a link is reached when its amplitude is positive.
    """
    a = aoa.select(F.col("i0").alias("rx_id"), F.posexplode("values").alias("tx_id", "a"))
    t = timing.select(F.col("i0").alias("rx_id"), F.posexplode("values").alias("tx_id", "t"))
    pos = locs.select(F.col("i0").alias("rx_id"), F.col("values")[0].alias("x"), F.col("values")[1].alias("y"))
    amp, az, el = F.col("a")[2], F.radians(F.col("a")[0]), F.radians(F.col("a")[1])
    return a.join(t, ["rx_id", "tx_id"]).join(pos, "rx_id").select(
        F.col("rx_id").cast("bigint").alias("rx_id"),
        "tx_id",
        "x",
        "y",
        (amp > 0).alias("reached"),
        X.amp_to_db(amp).alias("rss"),
        X.path_loss_db(amp).alias("path_loss"),
        F.col("t")[0].alias("delay"),
        F.sin(az).alias("sin_az"),
        F.cos(az).alias("cos_az"),
        F.sin(el).alias("sin_el"),
        F.cos(el).alias("cos_el"),
    )


_METRICS = "struct<mae:double,rmse:double,median:double,p90:double,p95:double>"
SUMMARY = (
    "combo_name STRING, enabled_features ARRAY<STRING>, disabled_features ARRAY<STRING>, n_features INT, "
    f"n_train INT, n_test INT, methods MAP<STRING,{_METRICS}>"
)


def read_summaries(spark: SparkSession, root: str, name: str = "localization_summary.json") -> DataFrame:
    """All run summaries below ``root`` as one row per (combo, method); a missing combination
    name is taken from the parent folder."""
    docs = (
        spark.read.schema(SUMMARY)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    parent = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    combo = F.when(F.length("combo_name") > 0, F.col("combo_name")).otherwise(F.url_decode(parent))
    return docs.select(
        combo.alias("combo"),
        F.col("n_features").alias("n_feat"),
        F.col("enabled_features").alias("enabled"),
        F.explode("methods").alias("method", "m"),
    ).select("combo", "n_feat", "enabled", "method", "m.*")


# ---------------------------------------------------------------- map extracts
_TAG = "tag ARRAY<STRUCT<_k:STRING,_v:STRING>>"
_NODE = "_id STRING, _lat DOUBLE, _lon DOUBLE"
_WAY = f"_id STRING, nd ARRAY<STRUCT<_ref:STRING>>, {_TAG}"
_RELATION = f"_id STRING, member ARRAY<STRUCT<_type:STRING,_ref:STRING,_role:STRING>>, {_TAG}"
_BOUNDS = "_minlat DOUBLE, _maxlat DOUBLE, _minlon DOUBLE, _maxlon DOUBLE"


def _xml(spark: SparkSession, path: str, tag: str, ddl: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)


def _tags():
    return F.map_from_entries(F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"], t["_v"])))


def read_osm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes(id, lat, lon), ways(id, refs, tags), relations(id, members, tags), bounds."""
    nodes = _xml(spark, path, "node", _NODE).toDF("id", "lat", "lon")
    ways = _xml(spark, path, "way", _WAY).select(
        F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags().alias("tags")
    )
    relations = _xml(spark, path, "relation", _RELATION).select(
        F.col("_id").alias("id"),
        F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"),
        _tags().alias("tags"),
    )
    bounds = _xml(spark, path, "bounds", _BOUNDS).toDF("min_lat", "max_lat", "min_lon", "max_lon")
    return {"nodes": nodes, "ways": ways, "relations": relations, "bounds": bounds}
