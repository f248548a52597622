"""Writers: distributed Parquet/CSV/JSON output, and the small text documents of a run."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators.links import with_first_flag
from pathloom.operators.skew import ROWS_PER_SALT, salted_lookup
from pathloom.session import materialize


MAX_REPORT_ROWS = 10_000


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


# ---------------------------------------------------------------- fingerprint cache
def write_fingerprints(fp: DataFrame, path: str, tag: str, n_tx: int, fft_size: int) -> None:
    """Fingerprint table next to a one-row metadata table that names the build."""
    write_table(fp, f"{path}/fingerprints")
    n = fp.sparkSession.read.parquet(f"{path}/fingerprints").count()
    meta = fp.sparkSession.createDataFrame([(n, n_tx, fft_size, tag)], "n_samples bigint, n_tx int, fft_size int, tag string")
    write_table(meta.coalesce(1), f"{path}/metadata")


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/fingerprints")


def cache_hit(spark: SparkSession, path: str, n_samples: int, n_tx: int, fft_size: int, tag: str) -> bool:
    """True when a stored table was built from exactly this configuration."""
    try:
        meta = spark.read.parquet(f"{path}/metadata").first()
    except Exception as exc:  # a missing path is an ordinary miss
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise
    return bool(meta) and (meta["n_samples"], meta["n_tx"], meta["fft_size"], meta["tag"]) == (n_samples, n_tx, fft_size, tag)


# ---------------------------------------------------------------- path tables
def write_path_csv(paths: DataFrame, path: str) -> bool:
    """Exportable paths with their ids, as CSV with a header; nothing is written without paths."""
    out = paths.filter(X.valid_path_export(F.col("delay_ns"), F.col("amp"))).select(
        "rx_id", "tx_id", "path_id", "delay_ns", F.col("amp").alias("amplitude"), X.amp_to_db(F.col("amp")).alias("gain_dB")
    )
    out = materialize(out)
    if out.isEmpty():
        return False
    out.write.mode("overwrite").csv(path, header=True)
    return True


def wide_paths(paths: DataFrame, tx: DataFrame, rx: DataFrame, source: str, fc: float) -> DataFrame:
    """Wide export: source, both positions, carrier, delay, levels and arrival/departure angles.

    The first path of a link is taken as direct, all others as reversed arrivals.
    """
    # the transmitter list is a layout table: as many rows as the array has transmitters
    t = F.broadcast(tx.select("tx_id", F.col("x").alias("bs_x"), F.col("y").alias("bs_y"), F.col("z").alias("bs_z")))
    r = rx.select("rx_id", F.col("x").alias("ue_x"), F.col("y").alias("ue_y"), F.col("z").alias("ue_z"))
    # receiver positions by receiver: a receiver may hold very many paths
    per_rx = materialize(paths.groupBy("rx_id").agg(F.count("*").alias("n")).join(r, "rx_id"))
    j = salted_lookup(with_first_flag(paths).join(t, "tx_id"), per_rx, ["rx_id"], "path_id", ROWS_PER_SALT)
    az, el = X.aod_deg(
        F.col("is_first"),
        F.col("ue_x") - F.col("bs_x"),
        F.col("ue_y") - F.col("bs_y"),
        F.col("ue_z") - F.col("bs_z"),
        F.col("az_deg"),
        F.col("el_deg"),
    )
    power = F.col("amp") * F.col("amp")
    return j.select(
        F.lit(source).alias("source"), "bs_x", "bs_y", "bs_z", "ue_x", "ue_y", "ue_z",
        F.lit(float(fc)).alias("carrier_freq_Hz"), F.col("path_id").alias("path_index"), "delay_ns",
        F.col("amp").alias("amplitude_abs"), power.alias("channel_gain_linear"), X.power_to_db(power).alias("channel_gain_dB"),
        F.col("az_deg").alias("az_aoa_deg"), F.col("el_deg").alias("el_aoa_deg"), az.alias("az_aod_deg"), el.alias("el_aod_deg"),
    )


def wide_frequencies(band: DataFrame, tx: DataFrame, rx: DataFrame, source: str, fft_size: int, spacing_hz: float, fc: float, step: int = 1) -> DataFrame:
    """Frequency export: source, both positions, carrier, subcarrier and the response there, one row a link and kept subcarrier.

    ``band`` has one row of arrays a link; positions are joined before it is unfolded. A link without a position stays, with nulls.
    """
    # the transmitter list is a layout table: as many rows as the array has transmitters
    t = F.broadcast(tx.select("tx_id", F.col("x").alias("bs_x"), F.col("y").alias("bs_y"), F.col("z").alias("bs_z")))
    r = rx.select("rx_id", F.col("x").alias("ue_x"), F.col("y").alias("ue_y"), F.col("z").alias("ue_z"))
    places = ("bs_x", "bs_y", "bs_z", "ue_x", "ue_y", "ue_z")
    one = F.posexplode(F.arrays_zip("h_re", "h_im")).alias("_p", "_e")
    j = band.join(t, "tx_id", "left").join(r, "rx_id", "left").select(*places, one)
    k, re, im = F.col("_p") * step, F.col("_e.h_re"), F.col("_e.h_im")
    mag = X.c_abs(re, im)
    return j.select(
        F.lit(source).alias("source"), *places, F.lit(float(fc)).alias("carrier_freq_Hz"), k.cast("int").alias("subcarrier_index"),
        ((k - fft_size / 2.0) * spacing_hz + fc).alias("subcarrier_freq_Hz"), re.alias("H_real"), im.alias("H_imag"),
        mag.alias("H_magnitude"), F.degrees(X.c_angle(re, im)).alias("H_phase_deg"), X.amp_to_db(mag, X.POWER_EPS).alias("H_gain_dB"),
    )


def schema_table(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table/column, kind, type) of a set of tables, sorted by name."""
    return sorted((f"{t}/{f.name}", "column", f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields)


# ---------------------------------------------------------------- results
def write_charts(charts: DataFrame, scores: DataFrame, path: str) -> None:
    """Chart coordinates partitioned by method, and their scores."""
    write_table(charts, f"{path}/charts", ["method"])
    write_table(scores, f"{path}/scores")


def read_charts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/charts"), spark.read.parquet(f"{path}/scores")


def write_summary(metrics: DataFrame, path: str, **run_info) -> None:
    """One JSON document per run: run attributes and a method -> metrics map."""
    m = F.map_from_entries(F.collect_list(F.struct("method", F.struct("mae", "rmse", "median", "p90", "p95"))))
    doc = metrics.agg(m.alias("methods"))  # one entry per method
    for k, v in run_info.items():
        doc = doc.withColumn(k, F.lit(v))
    doc.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def markdown_table(df: DataFrame, columns: list[str] | None = None) -> str:
    """A report table of at most MAX_REPORT_ROWS rows; a longer frame is refused, not cut."""
    cols = columns or df.columns
    rows = df.select(*cols).limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"more than {MAX_REPORT_ROWS} rows: write the frame as a table")

    def cell(v) -> str:
        if v is None:
            return "—"
        return f"{v:.2f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows]) + "\n"


# ---------------------------------------------------------------- meshes
def ply_bytes(vertices: list, faces: list) -> bytes:
    """Binary little-endian PLY of one mesh."""
    head = [
        "ply", "format binary_little_endian 1.0", f"element vertex {len(vertices)}",
        "property float x", "property float y", "property float z",
        f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header", "",
    ]
    body = b"".join(struct.pack("<fff", *v) for v in vertices)
    return "\n".join(head).encode("ascii") + body + b"".join(struct.pack("<Biii", 3, *f) for f in faces)


def write_ply(meshes: DataFrame, folder: str) -> None:
    """One PLY file per mesh row (name, vertices, faces), written by the tasks that hold the rows."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def save(rows):
        for r in rows:
            (Path(folder) / f"{r['name']}.ply").write_bytes(ply_bytes(r["vertices"], r["faces"]))

    meshes.select("name", "vertices", "faces").foreachPartition(save)


# fixed reflectances of the scene materials
MATERIAL_RGB = {
    "itu_concrete": "0.92, 0.88, 0.80",
    "itu_glass": "0.75, 0.90, 0.95",
    "itu_metal": "0.35, 0.38, 0.42",
    "itu_wood": "0.72, 0.50, 0.20",
    "itu_medium_dry_ground": "0.60, 0.55, 0.40",
}


def scene_xml_lines(meshes: DataFrame) -> DataFrame:
    """Scene document as ordered text lines (ord, line): materials, then one shape per mesh."""
    spark = meshes.sparkSession
    head = ['<scene version="2.1.0">'] + [
        f'  <bsdf type="diffuse" id="{m}"><rgb name="reflectance" value="{rgb}"/></bsdf>' for m, rgb in MATERIAL_RGB.items()
    ]
    top = spark.createDataFrame([(0, f"{i:04d}", s) for i, s in enumerate(head)], "part int, ord string, line string")
    shape = F.format_string(
        '  <shape type="ply" id="%s" name="%s"><string name="filename" value="ply/%s.ply"/>'
        '<boolean name="face_normals" value="true"/><ref id="%s" name="bsdf"/></shape>',
        "name", "name", "name", "material",
    )
    body = meshes.select(F.lit(1).alias("part"), F.col("name").alias("ord"), shape.alias("line"))
    end = spark.createDataFrame([(2, "", "</scene>")], "part int, ord string, line string")
    return top.unionByName(body).unionByName(end).orderBy("part", "ord")
