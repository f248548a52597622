"""Scalar functions: every one maps Columns to a Column and stays in JVM codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed physical and numeric values
SPEED_OF_LIGHT = 299_792_458.0
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
AMP_EPS = 1e-20
OFDM_EPS = 1e-6
POWER_EPS = 1e-30
REACHED_AMP = 1e-15
IDW_EPS = 1e-10
WEIGHT_EPS = 1e-20
LEVEL_HEIGHT = 3.0
DEFAULT_HEIGHT = 8.0


def q6(c: Column, scale: float = 1e6) -> Column:
    """Half-up quantisation used for published numbers (engine-independent, unlike ROUND)."""
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


# ---------------------------------------------------------------- levels and units
def amp_to_db(a: Column, eps: float = AMP_EPS) -> Column:
    return F.lit(20.0) * F.log10(a + F.lit(eps))


def power_to_db(p: Column, eps: float = POWER_EPS) -> Column:
    return F.lit(10.0) * F.log10(p + F.lit(eps))


def db_to_linear(g: Column) -> Column:
    return F.pow(F.lit(10.0), g / F.lit(10.0))


def path_loss_db(a: Column) -> Column:
    return F.lit(-20.0) * F.log10(a + F.lit(AMP_EPS))


def rss_db(sum_sq: Column) -> Column:
    return F.lit(10.0) * F.log10(sum_sq + F.lit(AMP_EPS))


def rss_dbm(sum_sq: Column) -> Column:
    return rss_db(sum_sq) + F.lit(30.0)


def seconds_to_ns(s: Column) -> Column:
    return s / F.lit(1e-9)


def distance_to_delay_ns(d: Column) -> Column:
    return d / F.lit(SPEED_OF_LIGHT) / F.lit(1e-9)


def los_amplitude(d: Column) -> Column:
    return F.lit(1.0) / d


def bounce_amplitude(cos_in: Column, cos_out: Column, d_tx: Column, d_rx: Column) -> Column:
    return cos_in * cos_out / (d_tx * d_rx)


# ---------------------------------------------------------------- path predicates
def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid_path(delay: Column, amp: Column) -> Column:
    """Strict validity: finite and positive delay and amplitude."""
    return is_finite(delay) & (delay > 0) & is_finite(amp) & (amp > 0)


def valid_path_export(delay: Column, amp: Column) -> Column:
    return (delay >= 0) & (amp > F.lit(AMP_EPS))


def valid_path_compare(delay: Column, amp: Column) -> Column:
    return is_finite(delay) & (delay > 0) & is_finite(amp) & (amp > F.lit(AMP_EPS))


def valid_path_covariance(az: Column, el: Column, amp: Column) -> Column:
    return is_finite(az) & is_finite(el) & (amp > 0)


# ---------------------------------------------------------------- angles and vectors
def az_el_deg(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column]:
    n = F.sqrt(dx * dx + dy * dy + dz * dz)
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dz / n))
    return F.degrees(F.atan2(dy, dx)), F.degrees(F.asin(z))


def unit_vector(az_deg: Column, el_deg: Column) -> tuple[Column, Column, Column]:
    az, el = F.radians(az_deg), F.radians(el_deg)
    return F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el)


def aod_deg(is_los: Column, dx: Column, dy: Column, dz: Column, az_aoa: Column, el_aoa: Column):
    """Departure angles: the tx->rx bearing on the direct path, else the reversed arrival."""
    az_los, el_los = az_el_deg(dx, dy, dz)
    ux, uy, uz = unit_vector(az_aoa, el_aoa)
    az_rev, el_rev = az_el_deg(-ux, -uy, -uz)
    return F.when(is_los, az_los).otherwise(az_rev), F.when(is_los, el_los).otherwise(el_rev)


def yaw_toward(cx: Column, cy: Column, x: Column, y: Column) -> Column:
    """Heading from (x, y) to the centre; level with it and not to its left, the negated offset is -0.0 and the heading
    -pi, as in SQL (atan2 here drops the sign of a zero)."""
    return F.when((y == cy) & (x >= cx), F.lit(-math.pi)).otherwise(F.atan2(cy - y, cx - x))


def heading_offset(az_deg: Column, rotation_deg: Column) -> Column:
    return az_deg - rotation_deg


# ---------------------------------------------------------------- complex numbers as (re, im)
def phasor(a: Column, f_hz: Column, tau_s: Column) -> tuple[Column, Column]:
    ph = F.lit(2.0 * math.pi) * f_hz * tau_s
    return a * F.cos(ph), -a * F.sin(ph)


def c_abs(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def c_angle(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def gain_from_path_loss(pl_db: Column, phase_rad: Column) -> tuple[Column, Column]:
    mag = F.pow(F.lit(10.0), -pl_db / F.lit(20.0))
    return mag * F.cos(phase_rad), mag * F.sin(phase_rad)


def ula_frequency(az_deg: Column, el_deg: Column, spacing: float = 0.5) -> Column:
    """Spatial frequency of a uniform linear array along y."""
    return F.lit(spacing) * F.sin(F.radians(el_deg)) * F.sin(F.radians(az_deg))


def decimate(arr: Column, step: int) -> Column:
    return F.filter(arr, lambda _, i: i % F.lit(step) == 0)


# ---------------------------------------------------------------- grids
def grid_index(x: Column, x0: float, step: float, n: int) -> Column:
    """Left-closed cell number, clipped into 0..n-1."""
    i = F.floor((x - F.lit(x0)) / F.lit(step))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("int")


def cell_centre(i: Column, x0: float, step: float) -> Column:
    return F.lit(x0) + i * F.lit(step) + F.lit(step / 2.0)


def checkerboard_parity(x: Column, y: Column, x0: float, y0: float, step: float) -> Column:
    xi = F.rint((x - F.lit(x0)) / F.lit(step))
    yi = F.rint((y - F.lit(y0)) / F.lit(step))
    return F.pmod(xi + yi, F.lit(2.0)).cast("int")


def sorted_position(v: Column, bounds: Column, levels: int) -> Column:
    """How many of the 2**levels - 1 ascending ``bounds`` lie below v, by halving."""
    steps = F.lit([1 << i for i in reversed(range(levels))])
    return F.aggregate(
        steps, F.lit(0), lambda pos, step: pos + F.when(F.element_at(bounds, pos + step) < v, step).otherwise(F.lit(0))
    )


def euclid2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def idw_weight(d: Column, p: Column) -> Column:
    return F.lit(1.0) / (F.pow(d, p) + F.lit(IDW_EPS))


# ---------------------------------------------------------------- maps and buildings
def latlon_to_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres around (lat0, lon0)."""
    r = F.lit(EARTH_RADIUS_M)
    return r * F.radians(lon - lon0) * F.cos(F.radians(lat0)), r * F.radians(lat - lat0)


def xy_to_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    m = F.lit(METRES_PER_DEGREE)
    return lat0 + y / m, lon0 + x / (m * F.cos(F.radians(lat0)))


def parse_height(text: Column) -> Column:
    """'10 m' and '10.5m' read as numbers (first word, unit stripped); anything else as 0."""
    word = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\S+?)[mM]*(\s|$)", 1)
    return F.coalesce(word.try_cast("double"), F.lit(0.0))


def building_height(height: Column, levels: Column) -> Column:
    h, lv = parse_height(height), parse_height(levels) * F.lit(LEVEL_HEIGHT)
    return F.when(h > 0, h).when(lv > 0, lv).otherwise(F.lit(DEFAULT_HEIGHT))


# fixed material names, in matching order
MATERIAL_RULES = [
    ("glass", "itu_glass"),
    ("metal", "itu_metal"),
    ("steel", "itu_metal"),
    ("wood", "itu_wood"),
    ("timber", "itu_wood"),
]
DEFAULT_MATERIAL = "itu_concrete"


def material(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for needle, name in MATERIAL_RULES:
        cond = t.contains(needle)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(DEFAULT_MATERIAL))


def slugify(text: Column, fallback: str = "mesh") -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^0-9A-Za-z_-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit(fallback))


def point_in_triangle(px, py, ax, ay, bx, by, cx, cy) -> Column:
    """Sign test; points on an edge count as inside."""
    d1 = (ax - px) * (by - py) - (ay - py) * (bx - px)
    d2 = (bx - px) * (cy - py) - (by - py) * (cx - px)
    d3 = (cx - px) * (ay - py) - (cy - py) * (ax - px)
    neg = (d1 < 0) | (d2 < 0) | (d3 < 0)
    pos = (d1 > 0) | (d2 > 0) | (d3 > 0)
    return ~(neg & pos)


# ---------------------------------------------------------------- labels
# fixed display order and names of the feature groups
FEATURE_LABELS = [
    ("ofdm_mag_gd", "OFDM"),
    ("tdoa", "TDoA"),
    ("aoa", "AoA"),
    ("rss", "RSS"),
    ("path_loss", "PL"),
    ("delay", "Dly"),
    ("cov_eigenvalues", "CovE"),
    ("reached_flags", "Rch"),
]


def feature_abbrev(enabled: Column) -> Column:
    """Ordered 'OFDM+TDoA+...' label from an array of enabled group names."""
    parts = F.array(*[F.when(F.array_contains(enabled, k), F.lit(v)) for k, v in FEATURE_LABELS])
    kept = F.array_compact(parts)
    return F.when(F.size(kept) > 0, F.array_join(kept, "+")).otherwise(F.lit("—"))


def method_prefix(name: Column) -> Column:
    return F.translate(name, " ()", "_")


def high_verdict(v: Column) -> Column:
    return F.when(v > 0.9, "good").when(v > 0.8, "ok").otherwise("poor")


def low_verdict(v: Column) -> Column:
    return F.when(v < 0.1, "good").when(v < 0.2, "ok").otherwise("poor")


# fixed accuracy bands (upper bound in metres, text)
ACCURACY_BANDS = [
    (1.0, "sub-metre — indoor room level"),
    (3.0, "1–3 m — within a small room"),
    (8.0, "3–8 m — room / corridor level"),
    (20.0, "8–20 m — floor level in a building"),
    (50.0, "20–50 m — building / block level"),
]
VERDICT_BANDS = [
    (2.0, "excellent — suitable for indoor navigation and AR overlay"),
    (5.0, "good — adequate for outdoor pedestrian guidance"),
    (15.0, "moderate — useful for zone-level dispatch and network management"),
]
COARSE_VERDICT = "coarse — sufficient for large-area coverage analytics only"


def _banded(v: Column, bands, last: Column) -> Column:
    out = F.when(v < bands[0][0], F.lit(bands[0][1]))
    for bound, text in bands[1:]:
        out = out.when(v < bound, F.lit(text))
    return out.otherwise(last)


def accuracy_label(mae: Column) -> Column:
    far = F.concat(F.rint(mae).cast("bigint").cast("string"), F.lit(" m — neighbourhood level"))
    return _banded(mae, ACCURACY_BANDS, far)


def accuracy_verdict(mae: Column) -> Column:
    return _banded(mae, VERDICT_BANDS, F.lit(COARSE_VERDICT))


def latex_escape(text: Column) -> Column:
    out = text
    for ch in "&%$#_{}":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return out
