"""Registered queries over propagation paths and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import expr as X
from pathloom.operators import links as L
from pathloom.operators import match as M
from pathloom.operators import stats as S
from pathloom.plans.common import publish, q, qs
from pathloom.session import materialize
from pathloom.sources import carriers as C
from pathloom.sources import ingest as SI
from pathloom.sources import sinks as SK

P, RX = C.PATHS_SQL, C.RX_SQL
ROTATION = [-75.0, 25.0, 125.0, 100.0, 125.0]  # antenna headings of the five transmitters


def _tools(spark, d):
    return C.event_paths(spark, d).withColumn("tool", F.when(F.pmod("path_id", F.lit(2)) == 0, "A").otherwise("B"))


def _grid(spark, d):
    return L.link_grid(C.event_rx(spark, d), L.link_features(C.event_paths(spark, d)), C.N_TX)


def path_stats(spark, d):
    """Path statistics with delay spread per transmitter."""
    return publish(S.path_summary(C.event_paths(spark, d), "tx_id"))


def rms_delay_spread(spark, d):
    return publish(S.rms_delay_spread(C.event_paths(spark, d), "rx_id", "tx_id"))


def angular_spread(spark, d):
    return publish(S.angular_spread(C.event_paths(spark, d), "tx_id"))


def delay_spread_profile(spark, d):
    return publish(S.delay_spread_profile(C.event_paths(spark, d), "rx_id", "tx_id"))


def tool_comparison(spark, d):
    """Two sources side by side under a tool label, from one scan."""
    return publish(S.path_stats(_tools(spark, d), "tool"))


def valid_paths(spark, d):
    """Slots passing each of the path predicates, per transmitter."""
    t, a = F.col("delay_ns"), F.col("amp")
    p = C.event_slots(spark, d)
    one = lambda c: F.sum(c.cast("bigint"))
    return p.groupBy("tx_id").agg(
        F.count("*").alias("n"),
        one(X.valid_path(t, a)).alias("n_strict"),
        one(X.valid_path_export(t, a)).alias("n_export"),
        one(X.valid_path_compare(t, a)).alias("n_compare"),
        one(X.valid_path_covariance(F.col("az_deg"), F.col("el_deg"), a)).alias("n_cov"),
    )


def paths_per_rx_hist(spark, d):
    return publish(S.paths_per_rx(C.event_paths(spark, d)))


def data_quality(spark, d):
    return publish(S.data_quality(C.event_slots(spark, d), "tx_id"))


def delay_histogram(spark, d):
    return S.width_histogram(C.event_paths(spark, d), "delay_ns", 0.0, 10.0, "tx_id")


def azimuth_histogram(spark, d):
    return S.histogram(C.event_paths(spark, d), "az_deg", -180.0, 180.0, 72)


def spread_histogram(spark, d):
    """Histogram of per-link delay spreads between their extremes, ten bins."""
    p = S.rms_delay_spread(C.event_paths(spark, d), "rx_id", "tx_id").filter("n >= 2")
    return S.auto_histogram(materialize(p.select(X.q6(F.col("rms_spread")).alias("v"))), "v", 10)


def link_gain(spark, d):
    return publish(L.link_gain(C.lineitem_paths(spark, d)).select("rx_id", "tx_id", "gain_db", "rss_dbm"))


def big_link_features(spark, d):
    """All per-link features on the larger path table, summarised per transmitter."""
    f = L.link_features(C.lineitem_paths(spark, d))
    return publish(
        f.groupBy("tx_id").agg(
            F.count("*").alias("links"),
            F.avg("rss").alias("rss"),
            F.avg("delay").alias("delay"),
            F.avg("path_loss").alias("path_loss"),
            F.avg("sin_az").alias("sin_az"),
            F.avg("cos_el").alias("cos_el"),
        )
    )


def best_link(spark, d):
    return publish(L.best_link(C.event_paths(spark, d)))


def best_tx_paths(spark, d):
    return publish(L.best_tx_paths(C.event_paths(spark, d)))


def rss(spark, d):
    return publish(L.link_features(C.event_paths(spark, d)).select("rx_id", "tx_id", "n_paths", "rss"))


def first_arrival(spark, d):
    return publish(L.link_features(C.event_paths(spark, d)).select("rx_id", "tx_id", "delay", "path_loss"))


def dominant_path(spark, d):
    return publish(L.dominant_path(C.event_paths(spark, d)))


def strongest_path(spark, d):
    return publish(L.strongest_path(C.event_paths(spark, d)))


def strongest_n_paths(spark, d):
    return publish(L.strongest_n(C.event_paths(spark, d), 5).select("rx_id", "tx_id", "rank", "path_id", "amp"))


def aoa_features(spark, d):
    return publish(
        L.link_features(C.event_paths(spark, d)).select("rx_id", "tx_id", "sin_az", "cos_az", "sin_el", "cos_el")
    )


def reached_flags(spark, d):
    return _grid(spark, d).select("rx_id", "tx_id", F.col("reached").cast("int").alias("reached"))


def imputed_links(spark, d):
    return publish(L.impute_links(materialize(_grid(spark, d))).withColumn("reached", F.col("reached").cast("int")))


def tdoa_pairs(spark, d):
    return publish(L.tdoa_pairs(_grid(spark, d), C.N_TX).filter("tdoa is not null"))


def tdoa_imputed(spark, d):
    return publish(L.tdoa_imputed(L.tdoa_pairs(materialize(_grid(spark, d)), C.N_TX)))


def all_reached_rx(spark, d):
    """Receivers reached by all transmitters but the one that is always missing."""
    return L.all_reached_rx(L.link_features(C.event_paths(spark, d)), C.N_TX)


def path_match(spark, d):
    p = _tools(spark, d)
    return publish(M.match_paths(p.filter("tool = 'A'"), p.filter("tool = 'B'"), 2.0))


def match_stats(spark, d):
    p = _tools(spark, d)
    return publish(M.match_stats(M.match_paths(p.filter("tool = 'A'"), p.filter("tool = 'B'"), 2.0)))


def departure_angles(spark, d):
    """Departure angles: bearing on the first path of a link, reversed arrival otherwise."""
    j = L.with_first_flag(C.event_paths(spark, d))
    x, y = F.pmod("rx_id", F.lit(25)) * 2.5 - 47.5, F.floor(F.col("rx_id") / 25) * 2.5 - 60.0
    tx, ty = F.col("tx_id") * 20.0 - 40.0, F.col("tx_id") * -15.0 + 30.0
    az, el = X.aod_deg(
        F.col("is_first"), x - tx, y - ty, F.lit(1.25 - 19.0), F.col("az_deg"), F.col("el_deg") - 90.0
    )
    # straight up or down there is no azimuth, so it is 0, and -180 is given as 180
    out = publish(j.select("rx_id", "tx_id", "path_id", az.alias("az_aod"), el.alias("el_aod")))
    one = F.when(F.abs("el_aod") >= 90, 0.0).when(F.col("az_aod") <= -180, 180.0).otherwise(F.col("az_aod"))
    return out.withColumn("az_aod", one)


def wide_positions(spark, d):
    """Transmitters and receivers with their places in space."""
    tx = spark.range(C.N_TX).select(
        F.col("id").cast("int").alias("tx_id"),
        (F.col("id") * 20.0 - 40.0).alias("x"),
        (F.col("id") * -15.0 + 30.0).alias("y"),
        F.lit(19.0).alias("z"),
    )
    return tx, C.event_rx(spark, d).withColumn("z", F.lit(1.25))


def wide_paths(spark, d):
    """The wide export rows: positions, levels and angles of every path."""
    tx, rx = wide_positions(spark, d)
    paths = C.event_paths(spark, d).withColumn("el_deg", F.col("el_deg") - 90.0)
    out = publish(SK.wide_paths(paths, tx, rx, "events", 3.5e9))
    az = F.when(F.abs("el_aod_deg") >= 90, 0.0).when(F.col("az_aod_deg") <= -180, 180.0).otherwise(F.col("az_aod_deg"))
    return out.withColumn("az_aod_deg", az)


def ray_join(spark, d):
    """Rays of an external table (line items) brought to the path layout, for the receivers that exist."""
    l = C.table(spark, d, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    rays = l.select(
        F.col("l_orderkey").alias("rx_index"),
        F.pmod(F.col("l_suppkey"), F.lit(9)).cast("int").alias("tx_idx"),
        (F.col("l_quantity").cast("double") * 1e-9).alias("delay"),
        (1.0 / price).alias("gain_real"),
        (F.col("l_discount").cast("double") / price).alias("gain_imag"),
        F.pmod(F.col("l_partkey"), F.lit(360)).cast("double").alias("aoa_az"),
        F.pmod(F.col("l_linenumber"), F.lit(181)).cast("double").alias("aoa_el"),
    )
    rx = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("rx_id"))
    return publish(SI.rays_to_paths(rays, rx).drop("path_id").withColumn("amp", F.col("amp") * 1e6))


def geometry_delay(spark, d):
    """Line-of-sight delay, amplitude and level for every receiver and transmitter position."""
    rx = C.event_rx(spark, d).select("rx_id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(C.N_TX - 1))).alias("tx_id"))
    dx = F.col("x") - (F.col("tx_id") * 20.0 - 40.0)
    dy = F.col("y") - (F.col("tx_id") * -15.0 + 30.0)
    dist = F.sqrt(dx * dx + dy * dy + F.lit(17.75 * 17.75))
    return publish(
        rx.select(
            "rx_id",
            "tx_id",
            X.distance_to_delay_ns(dist).alias("delay_ns"),
            X.amp_to_db(X.los_amplitude(dist)).alias("gain_db"),
            X.yaw_toward(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y")).alias("yaw"),
        )
    )


_W = "pow(10.0::DOUBLE, (20.0::DOUBLE * log10(amp + 1e-20)) / 10.0::DOUBLE)"
_STATS = f"""count(*) AS n, {q('min(delay_ns)', 'min_delay')}, {q('max(delay_ns)', 'max_delay')},
  {q('avg(delay_ns)', 'mean_delay')}, {q('stddev_pop(delay_ns)', 'std_delay')},
  {q('min(amp)', 'min_amp')}, {q('max(amp)', 'max_amp')}, {q('avg(amp)', 'mean_amp')},
  {q('min(20.0::DOUBLE*log10(amp+1e-20))', 'min_gain')}, {q('max(20.0::DOUBLE*log10(amp+1e-20))', 'max_gain')},
  {q('avg(20.0::DOUBLE*log10(amp+1e-20))', 'mean_gain')},
  {q(f'10.0::DOUBLE*log10(sum({_W})+1e-30)', 'total_gain')}"""
_LINKS = """links AS (
  SELECT rx_id, tx_id, count(*) AS n_paths, max(amp) > 1e-15 AS reached,
    10.0::DOUBLE*log10(sum(amp*amp)+1e-20) AS rss, min(delay_ns) AS delay,
    -20.0::DOUBLE*log10(max(CASE WHEN rn = 1 THEN amp END)+1e-20) AS path_loss,
    sum(sin(radians(az_deg))*amp)/(sum(amp)+1e-20) AS sin_az, sum(cos(radians(az_deg))*amp)/(sum(amp)+1e-20) AS cos_az,
    sum(sin(radians(el_deg))*amp)/(sum(amp)+1e-20) AS sin_el, sum(cos(radians(el_deg))*amp)/(sum(amp)+1e-20) AS cos_el
  FROM (SELECT *, row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY delay_ns, path_id) AS rn FROM paths)
  GROUP BY rx_id, tx_id)"""
_GRID = f"""grid AS (SELECT rx.rx_id, CAST(t.tx_id AS INTEGER) AS tx_id, coalesce(l.reached, false) AS reached,
    l.rss, l.delay, l.path_loss, l.sin_az, l.cos_az, l.sin_el, l.cos_el
  FROM rx CROSS JOIN range(0, 5) t(tx_id) LEFT JOIN links l ON l.rx_id = rx.rx_id AND l.tx_id = t.tx_id)"""
_PAIRS = """pairs AS (SELECT a.rx_id, a.tx_id AS tx_i, b.tx_id AS tx_j,
    CASE WHEN a.reached AND b.reached THEN a.delay - b.delay END AS tdoa
  FROM grid a JOIN grid b ON a.rx_id = b.rx_id AND a.tx_id < b.tx_id)"""
_MATCH = """m AS (SELECT rx_id, i, j, abs(da-db) AS delay_err, abs(ga-gb) AS gain_err, da, db, ga, gb FROM (
    SELECT a.rx_id, a.path_id AS i, b.path_id AS j, a.delay_ns AS da, b.delay_ns AS db,
      20.0::DOUBLE*log10(a.amp+1e-20) AS ga, 20.0::DOUBLE*log10(b.amp+1e-20) AS gb,
      row_number() OVER (PARTITION BY a.path_id ORDER BY b.path_id) AS rn
    FROM paths a JOIN paths b ON a.rx_id = b.rx_id AND abs(b.delay_ns - a.delay_ns) < 2.0
    WHERE a.path_id % 2 = 0 AND b.path_id % 2 = 1) WHERE rn = 1)"""


def _spread(keys: str, using: str) -> str:
    return f"""mom AS (SELECT {keys}, sum(delay_ns*w)/sum(w) AS mu, count(*) AS n FROM pw GROUP BY {keys}),
  spr AS (SELECT {keys}, any_value(n) AS n, any_value(mu) AS mean_delay,
    sqrt(sum((delay_ns-mu)*(delay_ns-mu)*w)/sum(w)) AS rms_spread FROM pw JOIN mom USING ({using}) GROUP BY {keys})"""


_PW = f"pw AS (SELECT *, {_W} AS w FROM paths)"
_PICK = f"path_id, {qs('delay_ns', 'amp', 'az_deg', 'el_deg')}"

QUERIES = {
    f.__name__: f
    for f in (
        path_stats, rms_delay_spread, angular_spread, delay_spread_profile, tool_comparison, valid_paths,
        paths_per_rx_hist, data_quality, delay_histogram, azimuth_histogram, spread_histogram, link_gain,
        big_link_features, best_link, best_tx_paths, rss, first_arrival, dominant_path, strongest_path,
        strongest_n_paths, aoa_features, reached_flags, imputed_links, tdoa_pairs, tdoa_imputed, all_reached_rx,
        path_match, match_stats, departure_angles, wide_paths, ray_join, geometry_delay,
    )
}

ORACLES = {
    "path_stats": f"""WITH {P}, {_PW}, {_spread('tx_id', 'tx_id')}, st AS (SELECT tx_id, {_STATS} FROM paths GROUP BY tx_id)
        SELECT st.*, {q('rms_spread', 'rms_spread')} FROM st JOIN spr USING (tx_id)""",
    "rms_delay_spread": f"""WITH {P}, {_PW}, {_spread('rx_id, tx_id', 'rx_id, tx_id')}
        SELECT rx_id, tx_id, n, {qs('mean_delay', 'rms_spread')} FROM spr""",
    "angular_spread": f"""WITH {P}, {_PW}, mu AS (SELECT tx_id, count(*) AS n, sum(w) AS sw,
          degrees(atan2(sum(w*sin(radians(az_deg))), sum(w*cos(radians(az_deg))))) AS ma, sum(w*el_deg)/sum(w) AS me
          FROM pw GROUP BY tx_id)
        SELECT tx_id, any_value(n) AS n, {q('any_value(ma)', 'mean_az')}, {q('any_value(me)', 'mean_el')},
          {q('sqrt(sum(w*(az_deg-ma)*(az_deg-ma))/any_value(sw))', 'std_az')},
          {q('sqrt(sum(w*(el_deg-me)*(el_deg-me))/any_value(sw))', 'std_el')}
        FROM pw JOIN mu USING (tx_id) GROUP BY tx_id""",
    "delay_spread_profile": f"""WITH {P}, pw AS (SELECT *, amp*amp AS w,
            row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY delay_ns, path_id) - 1 AS idx,
            row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY amp*amp DESC, delay_ns, path_id) AS prank FROM paths),
          mom AS (SELECT rx_id, tx_id, sum(delay_ns*w)/sum(w) AS mu, min(delay_ns) AS d0, count(*) AS n,
            max(CASE WHEN prank = 1 THEN idx END) AS si FROM pw GROUP BY rx_id, tx_id)
        SELECT rx_id, tx_id, any_value(n) AS n, {q('any_value(mu)-any_value(d0)', 'mean_spread')},
          {q('sqrt(sum((delay_ns-mu)*(delay_ns-mu)*w)/sum(w))', 'spread_std')}, CAST(any_value(si) AS BIGINT) AS strong_idx
        FROM pw JOIN mom USING (rx_id, tx_id) GROUP BY rx_id, tx_id""",
    "tool_comparison": f"""WITH {P} SELECT CASE WHEN path_id % 2 = 0 THEN 'A' ELSE 'B' END AS tool, {_STATS} FROM paths GROUP BY 1""",
    "valid_paths": f"""WITH {P} SELECT tx_id, count(*) AS n, CAST(sum(CASE WHEN delay_ns > 0 AND amp > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_strict,
          CAST(sum(CASE WHEN delay_ns >= 0 AND amp > 1e-20 THEN 1 ELSE 0 END) AS BIGINT) AS n_export,
          CAST(sum(CASE WHEN delay_ns > 0 AND amp > 1e-20 THEN 1 ELSE 0 END) AS BIGINT) AS n_compare,
          CAST(sum(CASE WHEN amp > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_cov FROM slots GROUP BY tx_id""",
    "paths_per_rx_hist": f"""WITH {P}, per AS (SELECT rx_id, count(*) AS n_paths FROM paths GROUP BY rx_id)
        SELECT n_paths, count(*) AS n_rx, {q('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM per)', 'pct')} FROM per GROUP BY n_paths""",
    "data_quality": f"""WITH {P}, per AS (SELECT tx_id, rx_id, count(*) AS np, sum(CASE WHEN amp = 0 THEN 1 ELSE 0 END) AS nz
          FROM slots GROUP BY 1, 2)
        SELECT tx_id, count(*) AS reached_rx, {q('avg(np)', 'mean_paths')}, max(np) AS max_paths, min(np) AS min_paths,
          CAST(0 AS BIGINT) AS nan_values, CAST(sum(nz) AS BIGINT) AS zero_amps FROM per GROUP BY tx_id""",
    "delay_histogram": f"""WITH {P} SELECT tx_id, CAST(floor(delay_ns / 10.0::DOUBLE) AS INTEGER) AS bin, count(*) AS n
        FROM paths WHERE delay_ns >= 0 GROUP BY 1, 2""",
    "azimuth_histogram": f"""WITH {P} SELECT CAST(least(floor((az_deg + 180) / 5.0::DOUBLE), 71) AS INTEGER) AS bin, count(*) AS n
        FROM paths GROUP BY 1""",
    "spread_histogram": f"""WITH {P}, {_PW}, {_spread('rx_id, tx_id', 'rx_id, tx_id')},
        v AS (SELECT {q('rms_spread', 'v')} FROM spr WHERE n >= 2), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
        SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM v, b GROUP BY 1""",
    "link_gain": f"""WITH {C.LINEITEM_SQL} SELECT rx_id, tx_id, {q('10.0::DOUBLE*log10(sum(amp*amp)+1e-30)', 'gain_db')},
          {q('10.0::DOUBLE*log10(sum(amp*amp)+1e-20)+30', 'rss_dbm')} FROM paths GROUP BY rx_id, tx_id""",
    "big_link_features": f"""WITH {C.LINEITEM_SQL}, {_LINKS} SELECT tx_id, count(*) AS links,
          {q('avg(rss)', 'rss')}, {q('avg(delay)', 'delay')}, {q('avg(path_loss)', 'path_loss')}, {q('avg(sin_az)', 'sin_az')},
          {q('avg(cos_el)', 'cos_el')} FROM links GROUP BY tx_id""",
    "best_link": f"""WITH {P} SELECT rx_id, tx_id, {q('max(amp)', 'max_amp')}, {q('sum(amp*amp)', 'power')} FROM paths
        GROUP BY rx_id, tx_id ORDER BY max(amp) DESC, rx_id, tx_id LIMIT 1""",
    "best_tx_paths": f"""WITH {P}, b AS (SELECT tx_id FROM paths GROUP BY tx_id ORDER BY sum(amp*amp) DESC, tx_id LIMIT 1)
        SELECT rx_id, tx_id, path_id, {qs('delay_ns', 'amp')}, {q('20.0::DOUBLE*log10(amp+1e-20)', 'gain_db')},
          row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY paths.delay_ns, path_id) AS delay_rank
        FROM paths WHERE tx_id = (SELECT tx_id FROM b) AND delay_ns > 0 AND amp > 1e-20""",
    "rss": f"WITH {P}, {_LINKS} SELECT rx_id, tx_id, n_paths, {qs('rss')} FROM links",
    "first_arrival": f"WITH {P}, {_LINKS} SELECT rx_id, tx_id, {qs('delay', 'path_loss')} FROM links",
    "dominant_path": f"""WITH {P} SELECT rx_id, tx_id, {_PICK} FROM paths
        QUALIFY row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY delay_ns, path_id) = 1""",
    "strongest_path": f"""WITH {P} SELECT rx_id, tx_id, {_PICK} FROM paths
        QUALIFY row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY amp DESC, path_id) = 1""",
    "strongest_n_paths": f"""WITH {P}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY amp DESC, path_id) AS INTEGER)
          AS rank FROM paths) SELECT rx_id, tx_id, rank, path_id, {qs('amp')} FROM r WHERE rank <= 5""",
    "aoa_features": f"WITH {P}, {_LINKS} SELECT rx_id, tx_id, {qs('sin_az', 'cos_az', 'sin_el', 'cos_el')} FROM links",
    "reached_flags": f"WITH {P}, {RX}, {_LINKS}, {_GRID} SELECT rx_id, tx_id, CAST(reached AS INTEGER) AS reached FROM grid",
    "imputed_links": f"""WITH {P}, {RX}, {_LINKS}, {_GRID}, s AS (SELECT tx_id, min(rss) AS r, max(path_loss) AS p, avg(delay) AS d
          FROM grid WHERE reached GROUP BY tx_id)
        SELECT g.rx_id, g.tx_id, CAST(reached AS INTEGER) AS reached,
          {q('CASE WHEN reached THEN rss ELSE coalesce(s.r - 10, -200) END', 'rss')},
          {q('CASE WHEN reached THEN path_loss ELSE coalesce(s.p + 10, 300) END', 'path_loss')},
          {q('CASE WHEN reached THEN delay ELSE coalesce(s.d, 0) END', 'delay')},
          {', '.join(q(f'CASE WHEN reached THEN {c} ELSE 0 END', c) for c in ('sin_az', 'cos_az', 'sin_el', 'cos_el'))}
        FROM grid g LEFT JOIN s USING (tx_id)""",
    "tdoa_pairs": f"""WITH {P}, {RX}, {_LINKS}, {_GRID}, {_PAIRS} SELECT rx_id, tx_i, tx_j, {qs('tdoa')} FROM pairs WHERE tdoa IS NOT NULL""",
    "tdoa_imputed": f"""WITH {P}, {RX}, {_LINKS}, {_GRID}, {_PAIRS}, m AS (SELECT tx_i, tx_j, avg(tdoa) AS mu FROM pairs GROUP BY 1, 2)
        SELECT rx_id, tx_i, tx_j, {q('coalesce(tdoa, mu, 0)', 'tdoa')} FROM pairs JOIN m USING (tx_i, tx_j)""",
    "all_reached_rx": f"""WITH {P}, {_LINKS} SELECT rx_id, count(*) AS n_reached FROM links WHERE reached GROUP BY rx_id HAVING count(*) = 5""",
    "path_match": f"""WITH {P}, {_MATCH} SELECT rx_id, i, j, {q('da', 'delay_a')}, {q('db', 'delay_b')}, {q('ga', 'gain_a')}, {q('gb', 'gain_b')},
          {qs('delay_err', 'gain_err')} FROM m""",
    "match_stats": f"""WITH {P}, {_MATCH} SELECT count(*) AS n_matched, {q('avg(delay_err)', 'mean_delay_err')},
          {q('sqrt(avg(gain_err*gain_err))', 'rms_gain_err')} FROM m""",
    "departure_angles": f"""WITH {P}, g AS (SELECT *, row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY delay_ns, path_id) = 1 AS los,
            (rx_id % 25)*2.5::DOUBLE - 47.5 - (tx_id*20.0::DOUBLE - 40) AS dx, (rx_id // 25)*2.5::DOUBLE - 60.0 - (tx_id * -15.0::DOUBLE + 30) AS dy,
            -17.75::DOUBLE AS dz, radians(az_deg) AS a, radians(el_deg - 90) AS e FROM paths)
        , o AS (SELECT rx_id, tx_id, path_id,
          {q('degrees(CASE WHEN los THEN atan2(dy, dx) ELSE atan2(-cos(e)*sin(a), -cos(e)*cos(a)) END)', 'az_aod')},
          {q('degrees(CASE WHEN los THEN asin(dz / sqrt(dx*dx+dy*dy+dz*dz)) ELSE asin(greatest(-1, least(1, -sin(e)))) END)', 'el_aod')}
        FROM g) SELECT rx_id, tx_id, path_id, CASE WHEN abs(el_aod) >= 90 THEN 0 WHEN az_aod <= -180 THEN 180 ELSE az_aod END AS az_aod, el_aod FROM o""",
    "wide_paths": f"""WITH {P}, g AS (SELECT *, row_number() OVER (PARTITION BY rx_id, tx_id ORDER BY delay_ns, path_id) = 1 AS los,
            (rx_id % 25)*2.5::DOUBLE - 47.5 AS ux, (rx_id // 25)*2.5::DOUBLE - 60.0 AS uy, tx_id*20.0::DOUBLE - 40 AS bx, tx_id * -15.0::DOUBLE + 30 AS bs,
            radians(az_deg) AS a, radians(el_deg - 90) AS e FROM paths),
          o AS (SELECT *, {q('degrees(CASE WHEN los THEN atan2(uy-bs, ux-bx) ELSE atan2(-cos(e)*sin(a), -cos(e)*cos(a)) END)', 'az')},
            {q('degrees(CASE WHEN los THEN asin(-17.75::DOUBLE / sqrt((ux-bx)*(ux-bx)+(uy-bs)*(uy-bs)+17.75::DOUBLE*17.75::DOUBLE)) ELSE asin(greatest(-1, least(1, -sin(e)))) END)', 'el')} FROM g)
        SELECT 'events' AS source, bx AS bs_x, bs AS bs_y, 19.0::DOUBLE AS bs_z, ux AS ue_x, uy AS ue_y, 1.25::DOUBLE AS ue_z, 3.5e9::DOUBLE AS "carrier_freq_Hz",
          path_id AS path_index, {qs('delay_ns')}, {q('amp', 'amplitude_abs')}, {q('amp*amp', 'channel_gain_linear')}, {q('10.0::DOUBLE*log10(amp*amp+1e-30)', '"channel_gain_dB"')},
          az_deg AS az_aoa_deg, el_deg - 90 AS el_aoa_deg, CASE WHEN abs(el) >= 90 THEN 0 WHEN az <= -180 THEN 180 ELSE az END AS az_aod_deg, el AS el_aod_deg FROM o""",
    "ray_join": f"""SELECT l_orderkey AS rx_id, CAST(l_suppkey % 9 AS INTEGER) AS tx_id, {q('l_quantity::DOUBLE * 1e-9 / 1e-9', 'delay_ns')},
          {q('sqrt(pow(1.0::DOUBLE/l_extendedprice, 2) + pow(l_discount::DOUBLE/l_extendedprice, 2)) * 1e6', 'amp')},
          (l_partkey % 360)::DOUBLE AS az_deg, (l_linenumber % 181)::DOUBLE AS el_deg
        FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "geometry_delay": f"""WITH {RX}, g AS (SELECT rx_id, CAST(t.tx_id AS INTEGER) AS tx_id, x, y, sqrt(pow(x - (t.tx_id*20.0::DOUBLE-40), 2) +
            pow(y - (t.tx_id * -15.0::DOUBLE + 30), 2) + 17.75::DOUBLE*17.75::DOUBLE) AS dist FROM rx CROSS JOIN range(0,5) t(tx_id))
        SELECT rx_id, tx_id, {q('dist / 299792458.0::DOUBLE / 1e-9', 'delay_ns')}, {q('20.0::DOUBLE*log10(1.0::DOUBLE/dist + 1e-20)', 'gain_db')},
          {q('atan2(-y, -x)', 'yaw')} FROM g""",
}
