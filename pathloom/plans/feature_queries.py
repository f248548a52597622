"""Registered queries over channel responses, covariance and assembled fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators import covariance as CV
from pathloom.operators import features as FT
from pathloom.operators import links as L
from pathloom.operators import ofdm as O
from pathloom.plans.common import publish, q, qs
from pathloom.plans.path_queries import _GRID, _LINKS, P, ROTATION, RX, wide_positions
from pathloom.schema import GROUP_COLUMNS, group_widths
from pathloom.sources import carriers as C
from pathloom.sources import sinks as SK

FFT, STEP = 3168, 16  # 198 kept subcarriers over 95 MHz
AXIS = dict(fft_size=FFT, spacing_hz=30e3, fc=3.6e9, step=STEP)


def _band(spark, d):
    return O.band_response(C.event_paths(spark, d), **AXIS)


def ofdm_response(spark, d):
    return publish(O.frequency_table(O.long_form(_band(spark, d), STEP, "h_re", "h_im")).select("rx_id", "tx_id", "k", "h_re", "h_im", "magnitude", "phase_deg", "gain_db"))


def wide_frequencies(spark, d):
    """The frequency export rows: both positions and the response of every link and kept subcarrier."""
    tx, rx = wide_positions(spark, d)
    return publish(SK.wide_frequencies(_band(spark, d), tx, rx, "events", **AXIS))


def ofdm_mag_db(spark, d):
    return publish(O.long_form(O.band_features(_band(spark, d)), STEP, "mag_db"))


def group_delay(spark, d):
    steps = O.long_form(O.band_features(_band(spark, d)), STEP, "slope")
    return publish(steps.withColumn("k", F.col("k") + STEP))  # a step is named by its upper subcarrier


def unwrapped_phase(spark, d):
    return publish(O.long_form(O.band_features(_band(spark, d)), STEP, "unwrapped"))


def band_power(spark, d):
    """Mean channel power per subcarrier and transmitter."""
    p = O.mean_power(_band(spark, d), F.col("tx_id")).select("tx_id", F.posexplode("power").alias("i", "p"))
    return publish(p.select("tx_id", (F.col("i") * STEP).cast("int").alias("k"), X.power_to_db(F.col("p")).alias("power_db")))


def cov_trace_norm(spark, d):
    return publish(CV.covariance_entries(CV.covariance_lags(C.event_paths(spark, d), 8), 8))


def cov_eig(spark, d):
    """Top eigenvalues per link."""
    e = CV.covariance_eigenvalues(CV.covariance_lags(C.event_paths(spark, d), 16), 3)
    return publish(e.select("rx_id", "tx_id", *[F.col("eig")[i].alias(f"eig{i + 1}") for i in range(3)]))


def _power_sums(eig):
    """Sum and sum of squares of eigenvalues: the traces of the matrix and of its square."""
    total = F.aggregate(eig, F.lit(0.0), lambda a, v: a + v)
    return [total.alias("eig_sum"), F.aggregate(eig, F.lit(0.0), lambda a, v: a + v * v).alias("eig_sum_sq")]


def cov_eig_power_sums(spark, d):
    """All 16 eigenvalues of every link."""
    e = CV.covariance_eigenvalues(CV.covariance_lags(C.event_paths(spark, d), 16), 16)
    return publish(e.select("rx_id", "tx_id", F.size("eig").alias("n_eig"), *_power_sums("eig")))


def array_response(spark, d):
    r = CV.array_response(C.event_paths(spark, d), ROTATION, 4)
    return publish(
        r.select("rx_id", "tx_id", F.posexplode(F.arrays_zip("re", "im")).alias("el", "v")).select(
            "rx_id", "tx_id", "el", F.col("v.re").alias("re"), F.col("v.im").alias("im")
        )
    )


def capon_doa(spark, d):
    r = CV.array_response(C.event_paths(spark, d), ROTATION, 4)
    return publish(CV.capon_doa(r, 3))


def fingerprint_scalars(spark, d):
    """Scalar feature groups of every receiver, long form."""
    groups = ["tdoa", "aoa", "rss", "path_loss", "delay", "reached_flags"]
    fp = FT.build_fingerprints(C.event_paths(spark, d), C.event_rx(spark, d), C.N_TX, groups)

    def labelled(g: str):
        return F.transform(
            F.col(GROUP_COLUMNS[g]), lambda v, i: F.struct(F.lit(g).alias("grp"), i.cast("int").alias("idx"), v.alias("v"))
        )

    parts = [labelled(g) for g in groups]
    return publish(fp.select("rx_id", F.explode(F.concat(*parts)).alias("e")).select("rx_id", "e.grp", "e.idx", "e.v"))


def fingerprints(spark, d):
    """All eight groups; sizes and sums per group."""
    fp = FT.build_fingerprints(C.event_paths(spark, d), C.event_rx(spark, d), C.N_TX, ofdm=AXIS)
    cols = []
    for g, c in GROUP_COLUMNS.items():
        cols.append(F.size(c).alias(f"n_{g}"))
        cols.append(F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(f"s_{g}"))
    return publish(fp.select("rx_id", "x", "y", *cols))


def feature_layout(spark, d):
    """Group widths measured on the built fingerprints next to the declared layout."""
    fp = FT.build_fingerprints(C.event_paths(spark, d), C.event_rx(spark, d), C.N_TX, ofdm=AXIS)
    w = group_widths(C.N_TX, FFT, STEP)
    row = F.array(
        *[
            F.struct(F.lit(g).alias("grp"), F.lit(i).alias("pos"), F.size(c).alias("width"), F.lit(w[g]).alias("declared"))
            for i, (g, c) in enumerate(GROUP_COLUMNS.items())
        ]
    )
    return (
        fp.select(F.explode(row).alias("e")).select("e.*").groupBy("grp", "pos", "declared")
        .agg(F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.count("*").alias("n_rx"))
    )


def best_path_database(spark, d):
    """The database of strongest paths with all eigenvalues, these as their power sums."""
    db = FT.best_path_database(C.event_paths(spark, d), C.event_rx(spark, d), C.N_TX, n_eig=16)
    return publish(db.select("*", *_power_sums("eig")).drop("eig").withColumn("reached", F.col("reached").cast("int")))


def cosine_gram(spark, d):
    by = O.band_features(_band(spark, d)).select("rx_id", "tx_id", F.col("mag_db").alias("ofdm"))
    return publish(FT.cosine_gram(by, C.N_TX))


def strongest_gain(spark, d):
    """Complex gain rebuilt from path loss and phase for the strongest path of each link."""
    s = L.strongest_path(C.event_paths(spark, d))
    re, im = X.gain_from_path_loss(X.path_loss_db(F.col("amp")), F.radians("az_deg"))
    return publish(s.select("rx_id", "tx_id", (re * 1000.0).alias("re"), (im * 1000.0).alias("im")))


_H = f"""sc AS (SELECT CAST(k * {STEP} AS INTEGER) AS k, (k * {STEP} - {FFT / 2}::DOUBLE) * 30000.0::DOUBLE + 3600000000.0::DOUBLE AS f
    FROM range(0, {FFT // STEP}) r(k)),
  h AS (SELECT rx_id, tx_id, k, sum(amp * cos({2 * 3.141592653589793!r}::DOUBLE * f * (delay_ns * 1e-9))) AS h_re,
    sum(-amp * sin({2 * 3.141592653589793!r}::DOUBLE * f * (delay_ns * 1e-9))) AS h_im FROM paths CROSS JOIN sc GROUP BY rx_id, tx_id, k)"""
_MAG = "20.0::DOUBLE*log10(sqrt(h_re*h_re+h_im*h_im)+1e-6)"
_PI = "pi()"
_SLOPE = f"""ph AS (SELECT rx_id, tx_id, k, atan2(h_im, h_re) AS phase, sqrt(h_re*h_re+h_im*h_im) AS mag FROM h),
  dd AS (SELECT *, phase - lag(phase) OVER w AS d, lag(mag) OVER w AS pm, first_value(phase) OVER w AS p0 FROM ph
    WINDOW w AS (PARTITION BY rx_id, tx_id ORDER BY k)),
  st AS (SELECT *, CASE WHEN abs(d) < {_PI} THEN d WHEN d >= {_PI} THEN d - 2*{_PI} ELSE d + 2*{_PI} END AS s FROM dd)"""
_ULA = "2*pi()*0.5*sin(radians(el_deg))*sin(radians(az_deg))"


def _cov(n: int) -> str:
    return f"""lg AS (SELECT rx_id, tx_id, CAST(l AS INTEGER) AS l, sum(amp*amp*cos({_ULA}*l))/({n}*sum(amp*amp)) AS re,
    sum(amp*amp*sin({_ULA}*l))/({n}*sum(amp*amp)) AS im FROM paths CROSS JOIN range(0, {n}) r(l) GROUP BY rx_id, tx_id, l)"""


_POWER = """pw AS (SELECT rx_id, tx_id, 16 * sum(re) FILTER (l = 0) AS eig_sum,
    sum(CASE WHEN l = 0 THEN 16 ELSE 2 * (16 - l) END * (re*re + im*im)) AS eig_sum_sq FROM lg GROUP BY rx_id, tx_id)"""
_TX_ROT = "CASE tx_id WHEN 0 THEN -75 WHEN 1 THEN 25 WHEN 2 THEN 125 WHEN 3 THEN 100 WHEN 4 THEN 125 END"

QUERIES = {
    f.__name__: f
    for f in (
        ofdm_response, ofdm_mag_db, group_delay, unwrapped_phase, band_power, cov_trace_norm, cov_eig,
        cov_eig_power_sums, array_response, capon_doa, fingerprint_scalars, fingerprints, feature_layout,
        best_path_database, cosine_gram, strongest_gain, wide_frequencies,
    )
}

ORACLES = {
    "ofdm_response": f"""WITH {P}, {_H} SELECT rx_id, tx_id, k, {qs('h_re', 'h_im')}, {q('sqrt(h_re*h_re+h_im*h_im)', 'magnitude')},
        {q('degrees(atan2(h_im, h_re))', 'phase_deg')}, {q('20.0::DOUBLE*log10(sqrt(h_re*h_re+h_im*h_im)+1e-30)', 'gain_db')} FROM h""",
    "wide_frequencies": f"""WITH {P}, {_H} SELECT 'events' AS source, tx_id*20.0::DOUBLE - 40 AS bs_x, tx_id * -15.0::DOUBLE + 30 AS bs_y, 19.0::DOUBLE AS bs_z,
        (rx_id % 25)*2.5::DOUBLE - 47.5 AS ue_x, (rx_id // 25)*2.5::DOUBLE - 60.0 AS ue_y, 1.25::DOUBLE AS ue_z, 3.6e9::DOUBLE AS "carrier_freq_Hz",
        k AS subcarrier_index, f AS "subcarrier_freq_Hz", {q('h_re', '"H_real"')}, {q('h_im', '"H_imag"')}, {q('sqrt(h_re*h_re+h_im*h_im)', '"H_magnitude"')},
        {q('degrees(atan2(h_im, h_re))', '"H_phase_deg"')}, {q('20.0::DOUBLE*log10(sqrt(h_re*h_re+h_im*h_im)+1e-30)', '"H_gain_dB"')} FROM h JOIN sc USING (k)""",
    "ofdm_mag_db": f"WITH {P}, {_H} SELECT rx_id, tx_id, k, {q(_MAG, 'mag_db')} FROM h",
    "group_delay": f"""WITH {P}, {_H}, {_SLOPE} SELECT rx_id, tx_id, k, {q('CASE WHEN mag > 1e-5 AND pm > 1e-5 THEN greatest(-500, least(500, s)) ELSE 0 END', 'slope')}
        FROM st WHERE d IS NOT NULL""",
    "unwrapped_phase": f"""WITH {P}, {_H}, {_SLOPE} SELECT rx_id, tx_id, k,
        {q('p0 + coalesce(sum(s) OVER (PARTITION BY rx_id, tx_id ORDER BY k), 0)', 'unwrapped')} FROM st""",
    "band_power": f"""WITH {P}, {_H} SELECT tx_id, k, {q('10.0::DOUBLE*log10(avg(h_re*h_re+h_im*h_im)+1e-30)', 'power_db')} FROM h GROUP BY tx_id, k""",
    "cov_trace_norm": f"""WITH {P}, {_cov(8)} SELECT rx_id, tx_id, CAST(m.m AS INTEGER) AS m, CAST(n.n AS INTEGER) AS n, {q('re', 're')},
        {q('CASE WHEN m.m > n.n THEN im WHEN m.m < n.n THEN -im ELSE 0 END', 'im')}
        FROM range(0, 8) m(m) CROSS JOIN range(0, 8) n(n) JOIN lg ON l = abs(m.m - n.n)""",
    "cov_eig_power_sums": f"""WITH {P}, {_cov(16)}, {_POWER} SELECT rx_id, tx_id, 16 AS n_eig, {qs('eig_sum', 'eig_sum_sq')} FROM pw""",
    "array_response": f"""WITH {P}, g AS (SELECT rx_id, tx_id, amp, pi()*sin(radians(az_deg - {_TX_ROT}))*cos(radians(el_deg)) AS px,
          pi()*sin(radians(az_deg - {_TX_ROT}))*sin(radians(el_deg)) AS py FROM paths)
        SELECT rx_id, tx_id, CAST(e.e AS INTEGER) AS el, {q('sum(amp*cos(px*(e.e//4) + py*(e.e%4)))', 're')}, {q('sum(amp*sin(px*(e.e//4) + py*(e.e%4)))', 'im')}
        FROM g CROSS JOIN range(0, 16) e(e) GROUP BY rx_id, tx_id, e.e""",
    "fingerprint_scalars": f"""WITH {P}, {RX}, {_LINKS}, {_GRID},
        s AS (SELECT tx_id, min(rss) AS r, max(path_loss) AS p, avg(delay) AS d FROM grid WHERE reached GROUP BY tx_id),
        im AS (SELECT g.rx_id, g.tx_id, reached, CASE WHEN reached THEN rss ELSE coalesce(s.r - 10, -200) END AS rss,
          CASE WHEN reached THEN path_loss ELSE coalesce(s.p + 10, 300) END AS path_loss,
          CASE WHEN reached THEN delay ELSE coalesce(s.d, 0) END AS delay, coalesce(sin_az, 0) AS sin_az, coalesce(cos_az, 0) AS cos_az,
          coalesce(sin_el, 0) AS sin_el, coalesce(cos_el, 0) AS cos_el FROM grid g LEFT JOIN s USING (tx_id)),
        pr AS (SELECT a.rx_id, a.tx_id AS i, b.tx_id AS j, CASE WHEN a.reached AND b.reached THEN a.delay - b.delay END AS t
          FROM grid a JOIN grid b ON a.rx_id = b.rx_id AND a.tx_id < b.tx_id),
        pm AS (SELECT i, j, avg(t) AS mu, row_number() OVER (ORDER BY i, j) - 1 AS idx FROM pr GROUP BY i, j),
        v AS (SELECT rx_id, 'tdoa' AS grp, idx, coalesce(t, mu, 0) AS v FROM pr JOIN pm USING (i, j)
          UNION ALL SELECT rx_id, 'aoa', tx_id, sin_az FROM im UNION ALL SELECT rx_id, 'aoa', tx_id + 5, cos_az FROM im
          UNION ALL SELECT rx_id, 'aoa', tx_id + 10, sin_el FROM im UNION ALL SELECT rx_id, 'aoa', tx_id + 15, cos_el FROM im
          UNION ALL SELECT rx_id, 'rss', tx_id, rss FROM im UNION ALL SELECT rx_id, 'path_loss', tx_id, path_loss FROM im
          UNION ALL SELECT rx_id, 'delay', tx_id, delay FROM im
          UNION ALL SELECT rx_id, 'reached_flags', tx_id, CASE WHEN reached THEN 1.0 ELSE 0.0 END FROM im)
        SELECT rx_id, grp, CAST(idx AS INTEGER) AS idx, {q('CAST(v AS DOUBLE)', 'v')} FROM v""",
    "feature_layout": f"""WITH {RX}, w(grp, pos, width) AS (VALUES ('ofdm_mag_gd', 0, 5*(2*{FFT // STEP}-1)), ('tdoa', 1, 10), ('aoa', 2, 20), ('rss', 3, 5),
          ('path_loss', 4, 5), ('delay', 5, 5), ('cov_eigenvalues', 6, 15), ('reached_flags', 7, 5))
        SELECT grp, pos, width AS declared, width AS min_width, width AS max_width, (SELECT count(*) FROM rx) AS n_rx FROM w""",
    "best_path_database": f"""WITH {P}, {RX}, {_cov(16)}, {_POWER}, lv AS (SELECT rx_id, tx_id, 10.0::DOUBLE*log10(sum(amp*amp)+1e-20)+30 AS rss FROM paths GROUP BY 1, 2),
        b AS (SELECT rx_id, tx_id, rss, -20.0::DOUBLE*log10(amp+1e-20) AS path_loss, delay_ns AS delay, az_deg AS az, el_deg AS el FROM paths JOIN lv USING (rx_id, tx_id)
          QUALIFY row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY amp DESC, path_id) = 1),
        s AS (SELECT tx_id, min(rss) - 10 AS rss, max(path_loss) + 10 AS path_loss, avg(delay) AS delay, avg(az) AS az, avg(el) AS el FROM b GROUP BY tx_id)
        SELECT rx.rx_id, s.tx_id, CASE WHEN b.rss IS NULL THEN 0 ELSE 1 END AS reached,
          {', '.join(q(f'coalesce(b.{c}, s.{c})', c) for c in ('rss', 'path_loss', 'delay', 'az', 'el'))},
          {', '.join(q(f'coalesce(pw.{c}, 0)', c) for c in ('eig_sum', 'eig_sum_sq'))}
        FROM rx CROSS JOIN s LEFT JOIN b ON b.rx_id = rx.rx_id AND b.tx_id = s.tx_id LEFT JOIN pw ON pw.rx_id = rx.rx_id AND pw.tx_id = s.tx_id""",
    "cosine_gram": f"""WITH {P}, {_H}, m AS (SELECT rx_id, tx_id, k, {_MAG} AS v FROM h),
        nn AS (SELECT rx_id, tx_id, sqrt(sum(v*v)) + 1e-9 AS nrm FROM m GROUP BY 1, 2)
        SELECT a.rx_id, a.tx_id AS tx_i, b.tx_id AS tx_j, {q('sum(a.v*b.v) / (any_value(na.nrm)*any_value(nb.nrm))', 'cos')}
        FROM m a JOIN m b ON a.rx_id = b.rx_id AND a.k = b.k AND a.tx_id <= b.tx_id
        JOIN nn na ON na.rx_id = a.rx_id AND na.tx_id = a.tx_id JOIN nn nb ON nb.rx_id = b.rx_id AND nb.tx_id = b.tx_id GROUP BY 1, 2, 3""",
    "strongest_gain": f"""WITH {P}, b AS (SELECT rx_id, tx_id, pow(10.0::DOUBLE, 20.0::DOUBLE*log10(amp+1e-20)/20.0::DOUBLE) AS m, radians(az_deg) AS ph FROM paths
          QUALIFY row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY amp DESC, path_id) = 1)
        SELECT rx_id, tx_id, {q('m*cos(ph)*1000', 're')}, {q('m*sin(ph)*1000', 'im')} FROM b""",
}
