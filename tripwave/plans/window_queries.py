"""Queries over windows around events, their features, and clusters of peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwave.operators import features, fusion, peaks, timeseries, windows
from tripwave.operators.ordered import Axis, row_index
from tripwave.params import Clustering, EventWindow, Tensor
from tripwave.plans.candidates import labelled_feature_rows, scored_candidates, tensor_set
from tripwave.plans.registry import query, r6, rounded
from tripwave.plans.sample_queries import BIN, GRID_SQL, NUM_SQL, REGION_SQL, SEG_SQL, SIG_DETECTION, sig_peaks
from tripwave.plans.views import (DAY_US, HOUR_US, MARKED_SQL, SENSOR_SQL, SIG_SQL, VEC_SQL, marked, sensor, sig,
                                  sig_axis, vec)

HALF = 2 * DAY_US
SIG_WINDOW = EventWindow(half=HALF, context_from=10 * DAY_US, context_to=2 * DAY_US, narrow=DAY_US,
                         per_second=float(HOUR_US))
SIG_CLUSTER = Clustering(max_dt=DAY_US, max_dist_m=700.0)

def cluster_sql(vertical: str = "v", kept: str = "true") -> str:
    return f"""{REGION_SQL},
pl AS (SELECT trip_id, ts_us, event_id AS peak_id, lat, lon, {vertical} AS peak_vertical, abs(v) AS peak_mag, g::DOUBLE AS peak_gyro_mag,
         speed AS peak_speed, lag(ts_us) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
       FROM pk WHERE {kept} WINDOW w AS (PARTITION BY trip_id ORDER BY ts_us, event_id)),
hav AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2)
          + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS h FROM pl),
nw AS (SELECT *, CASE WHEN ts_us - pts <= {DAY_US} AND 6371000 * 2 * atan2(sqrt(h), sqrt(1 - h)) <= 700 THEN 0 ELSE 1 END AS fresh FROM hav),
cl AS (SELECT *, sum(fresh) OVER (PARTITION BY trip_id ORDER BY ts_us, peak_id) AS c FROM nw)"""


@query("cluster_peaks", f"""WITH RECURSIVE {SIG_SQL}, {cluster_sql()}
SELECT trip_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_peaks FROM cl GROUP BY trip_id, c""")
def cluster_peaks(spark, folder):
    found, ax = sig_peaks(spark, folder)
    out = peaks.cluster_peaks(found, ax, p=SIG_CLUSTER)
    return out.groupBy("trip_id", "cluster").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n_peaks")).drop("cluster")


def events_sql(vertical: str = "v") -> str:
    return f"""{cluster_sql(vertical)},
evs AS (SELECT trip_id, c, arg_max(struct_pack(t := ts_us, lat := lat, lon := lon, v := peak_vertical),
                 struct_pack(a := abs(peak_vertical), b := -ts_us)) AS top,
          max(peak_mag) AS peak_mag, max(peak_gyro_mag) AS peak_gyro_mag, avg(peak_speed) AS speed_mean, count(*) AS n_peaks
        FROM cl GROUP BY trip_id, c),
ev AS (SELECT trip_id, top.t AS at, top.lat AS lat, top.lon AS lon, top.v AS peak_vertical, peak_mag, peak_gyro_mag, speed_mean,
         n_peaks, top.v / 9.80665 AS peak_vertical_g,
         CASE WHEN abs(top.v / 9.80665) >= 1.8 OR peak_gyro_mag >= 6 THEN 'high_conf'
              WHEN abs(top.v / 9.80665) >= 1.4 OR peak_gyro_mag >= 4 THEN 'candidate' ELSE 'normal' END AS level,
         row_number() OVER (ORDER BY trip_id, top.t) + 99 AS candidate_id
       FROM evs)"""


@query("cluster_events", f"""WITH RECURSIVE {SIG_SQL}, {events_sql()}
SELECT trip_id, "at", lat, lon, peak_vertical, peak_mag, peak_gyro_mag, r6(speed_mean) AS speed_mean, n_peaks,
       r6(peak_vertical_g) AS peak_vertical_g, level FROM ev""")
def cluster_events(spark, folder):
    found, ax = sig_peaks(spark, folder)
    ev = peaks.cluster_events(peaks.cluster_peaks(found, ax, p=SIG_CLUSTER), ax)
    return rounded(ev.select("trip_id", F.col("ts_us").alias("at"), "lat", "lon", "peak_vertical", "peak_mag",
                             "peak_gyro_mag", "speed_mean", "n_peaks", "peak_vertical_g", "level"),
                   "speed_mean", "peak_vertical_g")


@query("global_event_ids", f"""WITH RECURSIVE {SIG_SQL}, {events_sql()}
SELECT candidate_id, trip_id, "at" FROM ev""")
def global_event_ids(spark, folder):
    found, ax = sig_peaks(spark, folder)
    ev = peaks.cluster_events(peaks.cluster_peaks(found, ax, p=SIG_CLUSTER), ax)
    out = peaks.number_events(ev, F.floor(F.col("trip_id") / 32), Axis(("trip_id",), ("ts_us",), ax.chunk_len),
                              100, "candidate_id")
    return out.select("candidate_id", "trip_id", F.col("ts_us").alias("at"))


def window_sql(events: str, ident: str) -> str:
    """Rows of each event window with lags, peak, smoothed EMA threshold and runs."""
    return f"""
win AS (SELECT e.{ident} AS ev, e.at, s.* FROM {events} e JOIN sensor s ON s.trip_id = e.trip_id AND s.ts_us BETWEEN e.at - {HALF} AND e.at + {HALF}),
wi AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY ev) AS n,
  lag(ts_us) OVER o AS pt, lag(a_vertical) OVER o AS pv, lag(a_vertical, 2) OVER o AS pv2,
  lag(lin_ax) OVER o AS px, lag(lin_ay) OVER o AS py, lag(lin_az) OVER o AS pz,
  avg(abs(a_vertical)) OVER (PARTITION BY ev ORDER BY ts_us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sm
  FROM win WINDOW o AS (PARTITION BY ev ORDER BY ts_us, event_id)),
pk0 AS (SELECT ev, i AS pk, ts_us AS tp FROM (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY abs(a_vertical) DESC, i) AS rk FROM wi) WHERE rk = 1),
fs0 AS (SELECT ev, coalesce(1 / median((ts_us - pt) / {HOUR_US}), 100) AS fs FROM wi GROUP BY ev),
em AS (
  SELECT ev, i, sm AS b, 0.0::DOUBLE AS d FROM wi WHERE i = 0
  UNION ALL
  SELECT w.ev, w.i, 0.05::DOUBLE * w.sm + 0.95::DOUBLE * em.b,
         0.05::DOUBLE * abs(w.sm - (0.05::DOUBLE * w.sm + 0.95::DOUBLE * em.b)) + 0.95::DOUBLE * em.d
  FROM em JOIN wi w ON w.ev = em.ev AND w.i = em.i + 1),
ab AS (SELECT w.ev, w.i, w.sm > em.b + 3 * em.d AS up FROM wi w JOIN em ON em.ev = w.ev AND em.i = w.i),
rn AS (SELECT ev, min(i) AS s, max(i) + 1 AS e FROM (SELECT ev, i, i - row_number() OVER (PARTITION BY ev ORDER BY i) AS k FROM ab WHERE up) GROUP BY ev, k),
du AS (SELECT r.ev, coalesce(max(CASE WHEN (s <= pk AND pk <= e) OR abs(s - pk) < greatest(1, floor(0.15 * fs))
           OR abs(e - pk) < greatest(1, floor(0.15 * fs)) THEN e - s END), max(e - s)) / any_value(fs) AS dur
       FROM rn r JOIN pk0 USING (ev) JOIN fs0 USING (ev) GROUP BY r.ev),
jk AS (SELECT w.ev, max(abs(a_vertical - pv)) * any_value(fs) AS jerk FROM wi w JOIN fs0 USING (ev) GROUP BY w.ev)"""


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


@query("candidates_scored", f"""WITH RECURSIVE {SENSOR_SQL}, {events_sql('v - 50')}, {window_sql('ev', 'candidate_id')},
sc AS (SELECT ev.*, coalesce(du.dur, 0) AS event_duration, coalesce(jk.jerk, 0) AS vert_jrk,
  CASE WHEN speed_mean * 3.6 < 30 THEN 1 + 0.5 * exp(-speed_mean * 3.6 / 10) ELSE 1.0 END AS speed_factor
  FROM ev LEFT JOIN du ON du.ev = ev.candidate_id LEFT JOIN jk ON jk.ev = ev.candidate_id),
fin AS (SELECT *, {clip_sql(f'''(0.45 * ({clip_sql('abs(peak_vertical_g)', 1.0, 1.8)} - 1.0) / (1.8 - 1.0)
  + 0.2 * {clip_sql('peak_gyro_mag', 0.0, 6.0)} / 6.0 + 0.2 * {clip_sql('vert_jrk', 0.0, 400.0)} / 400.0
  + 0.15 * {clip_sql('event_duration', 0.0, 0.15)} / 0.15) * speed_factor''', 0.0, 1.0)} AS score FROM sc)
SELECT candidate_id, trip_id, "at", lat, lon, level, r6(peak_vertical_g) AS peak_vertical_g, peak_gyro_mag,
  r6(speed_mean) AS speed_mean, r6(event_duration) AS event_duration, r6(vert_jrk) AS vert_jrk,
  r6(speed_factor) AS speed_factor, r6(score) AS score,
  CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN peak_mag >= 45 THEN 'R10' WHEN abs(peak_vertical_g) < 6 THEN 'R6' ELSE 'other' END AS rule FROM fin""")
def candidates_scored(spark, folder):
    """Samples -> regions -> peaks -> clusters -> numbered events -> features -> suggestions -> scores."""
    s = sensor(spark, folder)
    rows = scored_candidates(s, sig_axis(s), "v", "g", SIG_DETECTION, SIG_CLUSTER, SIG_WINDOW,
                             F.floor(F.col("trip_id") / 32))
    rule = F.when(F.col("suggestion_rule").isin("R10", "R6"), F.col("suggestion_rule")).otherwise("other")
    out = rows.select((F.col("candidate_id") + 100).alias("candidate_id"), "trip_id", "at", "lat", "lon", "level",
                      "peak_vertical_g", "peak_gyro_mag", "speed_mean", "event_duration", "vert_jrk", "speed_factor",
                      "score", "priority", rule.alias("rule"))
    return rounded(out, "peak_vertical_g", "speed_mean", "event_duration", "vert_jrk", "speed_factor", "score")


@query("event_windows", f"""WITH {SENSOR_SQL}, {MARKED_SQL}
SELECT m.ev, m.trip_id, count(*) AS n, r6(sum(s.v)) AS v_sum FROM marked m JOIN sensor s
  ON s.trip_id = m.trip_id AND s.ts_us BETWEEN m.at - {HALF} AND m.at + {HALF} GROUP BY ALL""")
def event_windows(spark, folder):
    pairs = windows.range_join(sig(spark, folder).select("trip_id", "ts_us", "v"), marked(spark, folder),
                               "trip_id", "ts_us", "at", HALF, HALF)
    return rounded(pairs.groupBy("ev", "trip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v_sum")), "v_sum")


def _features(spark, folder, *cols):
    s = sensor(spark, folder)
    out = features.event_features(s, marked(spark, folder), sig_axis(s), "ev", "at", SIG_WINDOW)
    return rounded(out.select("ev", *cols), *cols)


BASE_SQL = f"WITH RECURSIVE {SENSOR_SQL}, {MARKED_SQL}, {window_sql('marked', 'ev')}"


@query("event_features_basic", f"""{BASE_SQL}, x AS (SELECT wi.*, fs, pk, tp FROM wi JOIN fs0 USING (ev) JOIN pk0 USING (ev))
SELECT ev, r6(sum(a_vertical * a_vertical)) AS vertical_energy, r6(sum(gx*gx + gy*gy + gz*gz)) AS gyro_energy,
  r6(sum(a_vertical * a_vertical) / (sum(gx*gx + gy*gy + gz*gz) + 1e-6)) AS accel_to_gyro_ratio,
  r6((max(ts_us) - min(ts_us)) / {HOUR_US}) AS local_duration,
  r6(coalesce(max(abs(a_vertical - pv)) * any_value(fs), 0)) AS max_jerk,
  r6(max(a_vertical) - min(a_vertical)) AS peak_to_peak,
  r6(count(*) FILTER (sign(a_vertical) <> sign(pv)) / count(*)) AS zcr,
  r6(sum(gx*gx)) AS gyro_pitch_energy, r6(sum(gz*gz)) AS gyro_roll_energy, r6(sum(gy*gy)) AS gyro_yaw_energy,
  r6(sum(gx*gx) / (sum(gz*gz) + 1e-6)) AS gyro_pitch_roll_ratio,
  r6(sum(a_vertical * a_vertical) * avg(speed)) AS speed_vert_interaction,
  r6((max(a_vertical) - min(a_vertical)) / (avg(speed) + 1)) AS speed_normalized_p2p,
  r6(sum(a_horizontal * a_horizontal) / (sum(a_vertical * a_vertical) + 1e-6)) AS horizontal_to_vertical_ratio,
  r6(stddev_samp(grav_y)) AS grav_y_std, r6(stddev_samp(grav_z)) AS grav_z_std,
  r6(coalesce(max(sqrt(pow(lin_ax - px, 2) + pow(lin_ay - py, 2) + pow(lin_az - pz, 2))) * any_value(fs), 0)) AS linear_jerk_3d_max,
  r6(CASE WHEN sum(a_vertical * a_vertical) > 0 THEN {clip_sql('sum(lin_az * lin_az) / (sum(a_vertical * a_vertical) + 1e-6)', 0, 100)} ELSE 0 END) AS brake_to_bump_ratio
FROM x GROUP BY ev""")
def event_features_basic(spark, folder):
    return _features(spark, folder, "vertical_energy", "gyro_energy", "accel_to_gyro_ratio", "local_duration", "max_jerk",
                     "peak_to_peak", "zcr", "gyro_pitch_energy", "gyro_roll_energy", "gyro_yaw_energy",
                     "gyro_pitch_roll_ratio", "speed_vert_interaction", "speed_normalized_p2p",
                     "horizontal_to_vertical_ratio", "grav_y_std", "grav_z_std", "linear_jerk_3d_max", "brake_to_bump_ratio")


SHAPE_SQL = f"""{BASE_SQL}, x AS (SELECT wi.*, pk, tp, a_vertical AS v0, a_vertical * a_vertical AS q, a_vertical - pv AS d1,
     a_vertical - 2 * pv + pv2 AS d2, ts_us - tp AS rel FROM wi JOIN pk0 USING (ev)),
a AS (SELECT ev, count(*) AS n, any_value(pk) AS pk, sum(q) AS ve, avg(abs(v0)) AS ma, avg(sqrt(abs(v0))) AS mr, max(abs(v0)) AS vm,
  max(v0) AS hi, min(v0) AS lo, sqrt(avg(q)) AS rms,
  coalesce(sum(q) FILTER (rel >= -{DAY_US} AND rel < 0), 0) AS el, coalesce(sum(q) FILTER (rel >= 0 AND rel <= {DAY_US}), 0) AS er,
  coalesce(sum(q) FILTER (i < pk), 0) AS eb, coalesce(sum(q) FILTER (i > pk), 0) AS ea,
  coalesce(sum(q) FILTER (v0 < 0), 0) AS ed, coalesce(sum(q) FILTER (v0 > 0), 0) AS eu,
  kurtosis_pop(v0) AS ku, count(*) FILTER (abs(rel) <= {DAY_US}) AS nn,
  avg(v0) FILTER (abs(rel) <= {DAY_US}) AS nm,
  sum(rel / {HOUR_US} * abs(v0)) / sum(abs(v0)) AS com, arg_min(i, struct_pack(a := v0, b := i)) AS imin,
  arg_max(i, struct_pack(a := v0, b := -i)) AS imax, var_pop(v0) AS v00, var_pop(d1) AS v11, var_pop(d2) AS v22,
  covar_pop(lin_ax, lin_ay) / nullif(stddev_pop(lin_ax) * stddev_pop(lin_ay), 0) AS cxy,
  covar_pop(lin_ax, lin_az) / nullif(stddev_pop(lin_ax) * stddev_pop(lin_az), 0) AS cxz,
  covar_pop(lin_ay, lin_az) / nullif(stddev_pop(lin_ay) * stddev_pop(lin_az), 0) AS cyz,
  arg_min(v0, i) AS vf, arg_max(v0, i) AS vl, sum(abs(d1)) AS ds FROM x GROUP BY ev),
m AS (SELECT x.ev, avg(pow(v0 - nm, 2)) AS m2, avg(pow(v0 - nm, 3)) AS m3 FROM x JOIN a USING (ev) WHERE abs(rel) <= {DAY_US} GROUP BY x.ev)"""


@query("event_features_shape", f"""{SHAPE_SQL}
SELECT ev, r6(abs(el - er) / (el + er + 1e-6)) AS asymmetry_score, r6(CASE WHEN n >= 4 THEN ku ELSE 0 END) AS kurtosis,
  r6(CASE WHEN nn >= 4 THEN m3 / pow(m2, 1.5) ELSE 0 END) AS skewness,
  r6(vm / (rms + 1e-6)) AS crest_factor, r6(vm / (ma + 1e-6)) AS impulse_factor, r6(vm / (mr * mr + 1e-6)) AS clearance_factor,
  r6(rms / (ma + 1e-6)) AS shape_factor, r6(com) AS time_center_of_mass,
  r6(CASE WHEN hi > 0 THEN {clip_sql('lo / (hi + 1e-6)', -10, 10)} ELSE 0 END) AS min_z_to_max_z_ratio,
  r6(CASE WHEN imin < imax THEN 1.0 ELSE -1.0 END::DOUBLE) AS first_peak_polarity,
  r6(CASE WHEN n > 2 THEN v00 ELSE 0 END) AS hjorth_activity,
  r6(CASE WHEN n > 2 AND v00 > 0 THEN sqrt(v11 / v00) ELSE 0 END) AS hjorth_mobility,
  r6(CASE WHEN n > 2 AND v00 > 0 AND v11 > 0 THEN sqrt(v22 / v11) / sqrt(v11 / v00) ELSE 0 END) AS hjorth_complexity,
  r6(CASE WHEN n > 5 THEN coalesce(cxy, 0) ELSE 0 END) AS corr_xy, r6(CASE WHEN n > 5 THEN coalesce(cxz, 0) ELSE 0 END) AS corr_xz,
  r6(CASE WHEN n > 5 THEN coalesce(cyz, 0) ELSE 0 END) AS corr_yz,
  r6(CASE WHEN n > 5 THEN {clip_sql('pk / (n - 1 - pk + 1e-6)', 0, 50)} ELSE 0 END) AS rise_time_ratio,
  r6(CASE WHEN n > 5 THEN (ea - eb) / (ea + eb + 1e-6) ELSE 0 END) AS peak_asymmetry,
  r6(CASE WHEN n > 2 THEN {clip_sql('ds / (abs(vl - vf) + 1e-6)', 0, 100)} ELSE 0 END) AS waveform_complexity,
  r6({clip_sql('ed / (eu + 1e-6)', 0, 100)}) AS down_up_asymmetry
FROM a LEFT JOIN m USING (ev)""")
def event_features_shape(spark, folder):
    return _features(spark, folder, "asymmetry_score", "kurtosis", "skewness", "crest_factor", "impulse_factor",
                     "clearance_factor", "shape_factor", "time_center_of_mass", "min_z_to_max_z_ratio",
                     "first_peak_polarity", "hjorth_activity", "hjorth_mobility", "hjorth_complexity", "corr_xy",
                     "corr_xz", "corr_yz", "rise_time_ratio", "peak_asymmetry", "waveform_complexity", "down_up_asymmetry")


@query("event_snr", f"""WITH {SENSOR_SQL}, {MARKED_SQL},
w AS (SELECT m.ev, count(*) AS n, avg(a_vertical * a_vertical) AS e FROM marked m JOIN sensor s
  ON s.trip_id = m.trip_id AND s.ts_us BETWEEN m.at - {HALF} AND m.at + {HALF} GROUP BY m.ev),
b AS (SELECT m.ev, count(*) AS n, avg(a_vertical * a_vertical) AS e FROM marked m JOIN sensor s
  ON s.trip_id = m.trip_id AND s.ts_us >= m.at - {10 * DAY_US} AND s.ts_us < m.at - {2 * DAY_US} GROUP BY m.ev)
SELECT w.ev, r6(CASE WHEN b.n > 10 AND w.n > 5 THEN w.e / (b.e + 1e-6) ELSE 1 END::DOUBLE) AS snr_vertical
FROM w LEFT JOIN b ON b.ev = w.ev""")
def event_snr(spark, folder):
    return _features(spark, folder, "snr_vertical")


@query("event_run_duration", f"""{BASE_SQL}
SELECT m.ev, r6(coalesce(du.dur, 0)) AS duration_above_threshold FROM marked m LEFT JOIN du USING (ev)""")
def event_run_duration(spark, folder):
    return _features(spark, folder, "duration_above_threshold")


@query("event_features_constant", f"""WITH {SIG_SQL}, {MARKED_SQL}
SELECT ev, 0.0::DOUBLE AS num_peaks_accel, 0.0::DOUBLE AS num_peaks_gyro, 0.0::DOUBLE AS peak_interval_mean,
  0.0::DOUBLE AS peak_interval_std, 0.0::DOUBLE AS top2_peak_ratio, 0.0::DOUBLE AS fft_high_low_ratio, 0.0::DOUBLE AS energy_psd_2_10
FROM marked""")
def event_features_constant(spark, folder):
    s = sensor(spark, folder)
    out = features.event_features(s, marked(spark, folder), sig_axis(s), "ev", "at", SIG_WINDOW)
    return out.select("ev", *features.CONSTANT_FEATURES)


SLIDE, HOP = 4 * DAY_US, 2 * DAY_US


@query("sliding_features", f"""WITH {SENSOR_SQL},
span AS (SELECT trip_id, min(ts_us) AS t0, max(ts_us) AS t1 FROM sensor GROUP BY trip_id),
win AS (SELECT trip_id, unnest(generate_series(t0, t1 - {SLIDE}, {HOP})) AS ws FROM span WHERE t1 - t0 >= {SLIDE}),
r AS (SELECT w.ws, s.*, sqrt(gx*gx + gy*gy + gz*gz) AS gm FROM win w JOIN sensor s
      ON s.trip_id = w.trip_id AND s.ts_us >= w.ws AND s.ts_us < w.ws + {SLIDE}),
d AS (SELECT *, magnitude - lag(magnitude) OVER o AS dm, gm - lag(gm) OVER o AS dg FROM r
      WINDOW o AS (PARTITION BY trip_id, ws ORDER BY ts_us, event_id))
SELECT trip_id, ws AS window_start, ws + {SLIDE} AS window_end, r6(avg(magnitude)) AS mag_mean, r6(stddev_pop(magnitude)) AS mag_std,
  max(magnitude) AS mag_max, r6(sqrt(avg(magnitude * magnitude))) AS mag_rms, r6(avg(abs(dm))) AS mag_jrk,
  r6(avg(a_vertical)) AS vert_mean, r6(stddev_pop(a_vertical)) AS vert_std, r6(max(a_vertical)) AS vert_max,
  r6(min(a_vertical)) AS vert_min, r6(sqrt(avg(a_vertical * a_vertical))) AS vert_rms,
  r6(avg(lat)) AS lat_mean, r6(avg(lon)) AS lon_mean, r6(avg(speed)) AS speed_mean,
  r6(avg(gm)) AS gyro_mag_mean, r6(max(gm)) AS gyro_mag_max, r6(avg(abs(dg))) AS gyro_mag_jrk,
  r6(stddev_pop(gx)) AS gyro_x_std, r6(stddev_pop(gy)) AS gyro_y_std, r6(stddev_pop(gz)) AS gyro_z_std
FROM d GROUP BY trip_id, ws HAVING count(*) >= 3""")
def sliding_features(spark, folder):
    s = sensor(spark, folder)
    out = windows.window_features(s, sig_axis(s), SLIDE, HOP)
    return rounded(out, *[c for c in out.columns if c not in ("trip_id", "window_start", "window_end", "mag_max")])


SIG_TENSOR = Tensor(rows=8, crop=6, half=HALF, gap_guard=0, channels=("speed", "v", "gx"))


@query("event_tensor", f"""WITH {SENSOR_SQL}, {MARKED_SQL},
r AS (SELECT m.ev, m.trip_id, s.speed, CASE WHEN s.event_type <> 'error' THEN s.v END AS v, s.gx,
        row_number() OVER (PARTITION BY m.ev ORDER BY s.ts_us) AS i
  FROM marked m JOIN sensor s ON s.trip_id = m.trip_id AND s.ts_us >= m.at - {HALF} AND s.ts_us < m.at + {HALF}),
f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER up AS p, last_value(v IGNORE NULLS) OVER up AS b,
        first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS q, first_value(v IGNORE NULLS) OVER dn AS a
  FROM r WINDOW up AS (PARTITION BY ev ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                dn AS (PARTITION BY ev ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT ev, trip_id, i, speed, gx, coalesce(v, CASE WHEN i - p <= 10 THEN b + coalesce((a - b) / (q - p), 0) * least(i - p, 5) END,
        CASE WHEN q - i <= 5 THEN a END) AS v FROM f),
k AS (SELECT ev, trip_id, count(*) AS n, list(speed ORDER BY i) AS s, list(v::FLOAT ORDER BY i) AS vv, list(gx ORDER BY i) AS gg
  FROM g GROUP BY ev, trip_id HAVING count(*) / 8 >= 0.7 AND count(*) FILTER (v IS NULL) = 0),
c AS (SELECT ev, trip_id, n, CASE WHEN n > 8 THEN list_slice(s, (n - 8) // 2 + 1, (n - 8) // 2 + 8) ELSE s END AS s,
  CASE WHEN n > 8 THEN list_slice(vv, (n - 8) // 2 + 1, (n - 8) // 2 + 8) ELSE vv END AS vv,
  CASE WHEN n > 8 THEN list_slice(gg, (n - 8) // 2 + 1, (n - 8) // 2 + 8) ELSE gg END AS gg FROM k),
z AS (SELECT *, (8 - len(s)) // 2 AS l, 8 - len(s) - (8 - len(s)) // 2 AS e FROM c)
SELECT ev, trip_id, j - 1 AS pos, CASE WHEN j <= l OR j > 8 - e THEN 0.0 ELSE round(s[j - l]::DOUBLE, 3) END::DOUBLE AS speed,
  CASE WHEN j <= l OR j > 8 - e THEN 0.0 ELSE round(vv[j - l]::DOUBLE + 1e-5, 3) END::DOUBLE AS v,
  CASE WHEN j <= l OR j > 8 - e THEN 0.0 ELSE round(gg[j - l]::DOUBLE, 3) END::DOUBLE AS gx
FROM (SELECT *, unnest(generate_series(1, 8)) AS j FROM z)""")
def event_tensor(spark, folder):
    s = sensor(spark, folder).withColumn("v", F.when(F.col("event_type") != "error", F.col("v")))
    out = windows.event_tensors(s, marked(spark, folder), "trip_id", "ts_us", "ev", "at", SIG_TENSOR, sig_axis(s).chunk_len)
    cells = out.select("ev", "trip_id", F.posexplode(F.arrays_zip("speed", "v", "gx")).alias("pos", "_c"))
    return cells.select("ev", "trip_id", F.col("pos").cast("bigint").alias("pos"), *[
        F.round(F.col(f"_c.{c}").cast("double") + d, 3).alias(c) for c, d in (("speed", 0.0), ("v", 1e-5), ("gx", 0.0))])


@query("center_crop", f"""WITH {VEC_SQL}
SELECT vec_id, unnest(generate_series(0, 49)) AS pos, r6(unnest(list_slice(x, 8, 57))) AS crop FROM vec""")
def center_crop(spark, folder):
    cut = vec(spark, folder).select("vec_id", F.posexplode(windows.center_crop(F.col("x"), 50)).alias("pos", "crop"))
    return rounded(cut.withColumn("pos", F.col("pos").cast("bigint")), "crop")


@query("channel_rms", f"""WITH {VEC_SQL}
SELECT vec_id, r6(sqrt(list_sum(list_transform(x, lambda e: e * e)) / len(x))) AS rms FROM vec""")
def channel_rms(spark, folder):
    return vec(spark, folder).select("vec_id", r6(windows.channel_rms(F.col("x"))).alias("rms"))


@query("representative", f"""WITH {VEC_SQL}, m AS (
SELECT cls, vec_id, list_max(list_transform(x, lambda e: abs(e))) AS top FROM vec)
SELECT cls, vec_id, r6(top) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY top DESC, vec_id) AS rk FROM m) WHERE rk = 3""")
def representative(spark, folder):
    v = vec(spark, folder).select("cls", "vec_id", F.array_max(F.transform("x", F.abs)).alias("top"))
    return rounded(windows.representative(v, ["cls"], F.col("top"), "vec_id", 3), "top")


@query("event_number", f"""WITH {SIG_SQL}, {MARKED_SQL}
SELECT ev, trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY ev) AS event_no FROM marked""")
def event_number(spark, folder):
    m = marked(spark, folder)
    out = row_index(m, Axis(("trip_id",), ("ev",), 10_000), "_i")
    return out.select("ev", "trip_id", (F.col("_i") + 1).alias("event_no"))


@query("rank_in_trip", f"""WITH {SIG_SQL}, {MARKED_SQL},
m AS (SELECT ev, trip_id, CASE WHEN ev % 9 > 0 THEN "at" END AS "at" FROM marked)
SELECT ev, trip_id, "at", row_number() OVER (PARTITION BY trip_id ORDER BY "at" ASC NULLS LAST, ev) AS event_no FROM m""")
def rank_in_trip(spark, folder):
    m = marked(spark, folder).drop("label").withColumn("at", F.when(F.col("ev") % 9 > 0, F.col("at")))
    return windows.event_numbers(m, Axis(("trip_id",), ("at", "ev"), 5 * DAY_US))


@query("jerk_diff", f"""WITH {SENSOR_SQL},
d AS (SELECT event_id, (lin_ax - lag(lin_ax) OVER w) * 2 AS jx, (lin_ay - lag(lin_ay) OVER w) * 2 AS jy, (lin_az - lag(lin_az) OVER w) * 2 AS jz
  FROM sensor WINDOW w AS (PARTITION BY trip_id ORDER BY ts_us, event_id))
SELECT event_id, r6(jx) AS jerk_lin_ax, r6(jy) AS jerk_lin_ay, r6(jz) AS jerk_lin_az, r6(sqrt(jx*jx + jy*jy + jz*jz)) AS jerk_3d FROM d""")
def jerk_diff(spark, folder):
    s = sensor(spark, folder)
    out = timeseries.jerk(s, sig_axis(s), ["lin_ax", "lin_ay", "lin_az"], 2.0)
    return rounded(out.select("event_id", "jerk_lin_ax", "jerk_lin_ay", "jerk_lin_az", "jerk_3d"),
                   "jerk_lin_ax", "jerk_lin_ay", "jerk_lin_az", "jerk_3d")


@query("interval_diagnostics", f"""WITH {SIG_SQL}, {MARKED_SQL},
st AS (SELECT trip_id, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS step FROM sig)
SELECT m.ev, count(*) AS n, max(step) AS max_step, r6(avg(step) / 1e6) AS mean_step_s,
  count(*) FILTER (step > {6 * HOUR_US}) AS over_grid, count(*) FILTER (step > {30 * HOUR_US}) AS over_fill
FROM marked m JOIN st ON st.trip_id = m.trip_id AND st.ts_us BETWEEN m.at - {HALF} AND m.at + {HALF} GROUP BY m.ev""")
def interval_diagnostics(spark, folder):
    s = sig(spark, folder)
    out = windows.interval_diagnostics(s, marked(spark, folder), sig_axis(s), "ev", "at", HALF, 6 * HOUR_US, 30 * HOUR_US, 1e6)
    return rounded(out, "mean_step_s")


@query("resample_compare", f"""WITH {SIG_SQL}, {MARKED_SQL}, {GRID_SQL},
a AS (SELECT m.ev, count(*) AS raw_n, avg(v) AS raw_mean, max(v) AS raw_max FROM marked m JOIN sig s
  ON s.trip_id = m.trip_id AND s.ts_us >= m.at - {HALF} AND s.ts_us < m.at + {HALF} GROUP BY m.ev),
b AS (SELECT m.ev, count(*) AS grid_n, avg(v) AS grid_mean, max(v) AS grid_max FROM marked m JOIN filled s
  ON s.trip_id = m.trip_id AND s.v IS NOT NULL AND s.bin * {6 * HOUR_US} >= m.at - {HALF} AND s.bin * {6 * HOUR_US} < m.at + {HALF} GROUP BY m.ev)
SELECT ev, raw_n, grid_n, r6(raw_mean) AS raw_mean, r6(grid_mean) AS grid_mean, r6(raw_max) AS raw_max, r6(grid_max) AS grid_max
FROM a JOIN b USING (ev)""")
def resample_compare(spark, folder):
    s = sig(spark, folder)
    grid = timeseries.resample(s, ["trip_id"], "ts_us", ["v"], ["v"], sig_axis(s).chunk_len, p=BIN)
    out = windows.compare_windows({"raw": s, "grid": grid}, marked(spark, folder), "trip_id", "ts_us", "ev", "at", "v", HALF)
    return rounded(out, "raw_mean", "raw_max", "grid_mean", "grid_max")


@query("cooldown_triggers", f"""WITH RECURSIVE {SIG_SQL},
hot AS (SELECT trip_id, event_id, ts_us, v / 100 AS prob FROM sig WHERE v / 100 >= 0.35),
nx AS (SELECT trip_id, min(ts_us) AS ts_us FROM hot GROUP BY trip_id
  UNION ALL
  SELECT h.trip_id, min(h.ts_us) FROM nx JOIN hot h ON h.trip_id = nx.trip_id AND h.ts_us > nx.ts_us + {DAY_US} GROUP BY h.trip_id, nx.ts_us)
SELECT h.trip_id, h.event_id, h.ts_us, r6(h.prob) AS prob FROM nx JOIN hot h USING (trip_id, ts_us)""")
def cooldown_triggers(spark, folder):
    s = sig(spark, folder).withColumn("prob", F.col("v") / 100)
    out = fusion.cooldown_triggers(s, sig_axis(s), "prob", 0.35, DAY_US)
    return rounded(out.select("trip_id", "event_id", "ts_us", "prob"), "prob")


def welch_sql(value: str) -> str:
    """Density per trip, 16-row Hann segment and frequency bin of ``value`` at 100 Hz."""
    return f"""len AS (SELECT trip_id, count(*) AS n FROM num GROUP BY trip_id),
sg AS (SELECT trip_id, unnest(generate_series(0, (n - 16) // 8)) AS s FROM len WHERE n >= 16),
w AS (SELECT sg.trip_id, s, idx - s * 8 AS j, {value} AS x, avg({value}) OVER (PARTITION BY sg.trip_id, s) AS m,
       0.5 - 0.5 * cos(2 * pi() * (idx - s * 8) / 16) AS h
  FROM sg JOIN num ON num.trip_id = sg.trip_id AND idx BETWEEN s * 8 AND s * 8 + 15),
f AS (SELECT unnest(generate_series(0, 8)) AS k),
p AS (SELECT trip_id, s, k, (pow(sum((x - m) * h * cos(2 * pi() * j * k / 16)), 2) + pow(sum((x - m) * h * sin(2 * pi() * j * k / 16)), 2))
        / (100 * sum(h * h)) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS d FROM w JOIN f ON true GROUP BY trip_id, s, k)"""


@query("welch_band_power", f"""WITH {SIG_SQL}, {NUM_SQL}, {welch_sql('v')},
q AS (SELECT trip_id, k, avg(d) AS d FROM p GROUP BY trip_id, k)
SELECT trip_id, r6(avg(d) FILTER (k * 6.25 >= 2 AND k * 6.25 <= 15)) AS power_low,
       r6(avg(d) FILTER (k * 6.25 > 15 AND k * 6.25 <= 45)) AS power_high FROM q GROUP BY trip_id""")
def welch_band_power(spark, folder):
    s = sig(spark, folder)
    out = fusion.welch_bands(s, sig_axis(s), "v", {"power_low": (2, 15, True), "power_high": (15, 45, False)}, 100.0, 16)
    return rounded(out, "power_low", "power_high")


@query("sensor_fusion", f"""WITH RECURSIVE {SENSOR_SQL},
bins AS (SELECT trip_id, ts_us // {6 * HOUR_US} AS bin, avg(lin_ax) AS lx, avg(lin_ay) AS ly, avg(lin_az) AS lz, avg(grav_x) AS gx, avg(grav_y) AS gy, avg(grav_z) AS gz FROM sensor GROUP BY ALL),
nxt AS (SELECT *, lead(bin) OVER w AS nb, {', '.join(f'lead({c}) OVER w AS n{c}' for c in ('lx', 'ly', 'lz', 'gx', 'gy', 'gz'))} FROM bins WINDOW w AS (PARTITION BY trip_id ORDER BY bin)),
grid AS (SELECT *, unnest(generate_series(0, least(coalesce(nb - bin - 1, 0), 10))) AS k FROM nxt),
fl AS (SELECT trip_id, bin + k AS bin, {', '.join(f'{c} + coalesce((n{c} - {c}) / (nb - bin), 0) * least(k, 5) AS {c}' for c in ('lx', 'ly', 'lz', 'gx', 'gy', 'gz'))} FROM grid),
nm AS (SELECT *, CASE WHEN gx*gx + gy*gy + gz*gz = 0 THEN 1 ELSE sqrt(gx*gx + gy*gy + gz*gz) END AS m FROM fl),
pr AS (SELECT trip_id, bin, (lx*gx + ly*gy + lz*gz) / m AS v, lx*lx + ly*ly + lz*lz AS en FROM nm),
ph AS (SELECT trip_id, bin, v, sqrt(greatest(0, en - v * v)) AS h, row_number() OVER (PARTITION BY trip_id ORDER BY bin) - 1 AS i FROM pr),
lg AS (SELECT *, coalesce(lag(v, 2) OVER w, 0) AS v2, coalesce(lag(v, 4) OVER w, 0) AS v4, coalesce(lag(h, 1) OVER w, h) AS h1,
   coalesce(lag(h, 2) OVER w, lag(h, 1) OVER w, h) AS h2 FROM ph WINDOW w AS (PARTITION BY trip_id ORDER BY i)),
kk AS (SELECT tan(pi() * 0.2) AS k),
cf AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b0, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1, (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM kk),
dr AS (SELECT trip_id, bin, i, h, 0.19061660009749753 * v - 0.38123320019499507 * v2 + 0.19061660009749753 * v4 AS f, b0 * h + 2 * b0 * h1 + b0 * h2 AS g, a1, a2 FROM lg JOIN cf ON true),
y AS (SELECT trip_id, bin, i, f AS y0, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS y3, h AS z0, h AS z1 FROM dr WHERE i = 0
  UNION ALL
  SELECT d.trip_id, d.bin, d.i, d.f + 2.3350824020765124::DOUBLE * y.y0 - 1.9509646897792021::DOUBLE * y.y1 + 0.8192636853124013::DOUBLE * y.y2
    - 0.2066719851665643::DOUBLE * y.y3, y.y0, y.y1, y.y2, d.g - d.a1 * y.z0 - d.a2 * y.z1, y.z0
  FROM y JOIN dr d ON d.trip_id = y.trip_id AND d.i = y.i + 1)
SELECT trip_id, bin, r6(y0) AS a_vertical, r6(z0) AS a_horizontal, r6(sqrt(y0 * y0 + z0 * z0)) AS a_linear_mag FROM y""")
def sensor_fusion(spark, folder):
    """Resampling, gravity projection, both causal filters and the linear magnitude, end to end."""
    s = sensor(spark, folder).withColumns({f"a{a}": F.col(f"lin_a{a}") + F.col(f"grav_{a}") for a in "xyz"})
    ax = Axis(("trip_id",), ("ts_us",), sig_axis(s).chunk_len)
    numeric = ["ax", "ay", "az", "lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z"]
    out = fusion.native_fusion(s.select("trip_id", "ts_us", *numeric), ax, numeric, p=BIN)
    return rounded(out.select("trip_id", "bin", "a_vertical", "a_horizontal", "a_linear_mag"), "a_vertical", "a_horizontal", "a_linear_mag")


REASON_SQL = f"""pr AS (SELECT trip_id, event_id AS event_id, ts_us + 9 * {HOUR_US} AS at FROM sig),
bd AS (SELECT trip_id, segment, max(ts_us) AS e FROM seg GROUP BY trip_id, segment),
bn AS (SELECT DISTINCT trip_id, segment, ts_us // {6 * HOUR_US} AS bin FROM seg),
bl AS (SELECT *, lead(bin) OVER (PARTITION BY trip_id, segment ORDER BY bin) AS nb FROM bn),
gr AS (SELECT trip_id, segment, (bin + unnest(generate_series(0, least(coalesce(nb - bin - 1, 0), 10)))) * {6 * HOUR_US} AS t FROM bl),
sz AS (SELECT trip_id, segment, count(*) AS n FROM gr GROUP BY ALL),
gp AS (SELECT * FROM (SELECT trip_id, ts_us AS ge, lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS gs FROM sig) WHERE ge - gs > {DAY_US}),
pl AS (SELECT p.event_id, p.trip_id, p.at, b.segment, sz.n FROM pr p LEFT JOIN bd b ON b.trip_id = p.trip_id AND p.at BETWEEN b.segment AND b.e
   LEFT JOIN sz ON sz.trip_id = b.trip_id AND sz.segment = b.segment),
nr AS (SELECT pl.*, EXISTS (SELECT 1 FROM gp WHERE gp.trip_id = pl.trip_id AND pl.at <= ge + {26 * HOUR_US} AND pl.at >= gs - {26 * HOUR_US}) AS near FROM pl),
cv AS (SELECT nr.event_id, count(gr.t) AS rows_in FROM nr LEFT JOIN gr ON gr.trip_id = nr.trip_id AND gr.segment = nr.segment
   AND gr.t >= nr.at - {24 * HOUR_US} AND gr.t < nr.at + {24 * HOUR_US} GROUP BY nr.event_id)"""


@query("tensor_reasons", f"""WITH {SIG_SQL}, {SEG_SQL}, {REASON_SQL}
SELECT event_id, CASE WHEN segment IS NULL THEN 'in_gap' WHEN n < 8 THEN 'short_segment' WHEN near THEN 'gap_buffer'
  WHEN rows_in / 8 < 0.7 THEN 'extract_failed' ELSE 'tensor' END AS reason FROM nr JOIN cv USING (event_id)""")
def tensor_reasons(spark, folder):
    """Tensors cut from resampled segments, and the reason for every event that got none."""
    s = sensor(spark, folder).withColumns({f"a{a}": F.col(f"lin_a{a}") + F.col(f"grav_{a}") for a in "xyz"})
    probe = s.select("trip_id", F.col("event_id"), (F.col("ts_us") + 9 * HOUR_US).alias("at"))
    t = Tensor(rows=8, crop=6, half=24 * HOUR_US, gap_guard=2 * HOUR_US)
    cols = ["trip_id", "ts_us", *t.channels]
    done, skipped = tensor_set(s.select(*cols), probe, Axis(("trip_id",), ("ts_us",), sig_axis(s).chunk_len), BIN, t)
    return done.select("event_id", F.lit("tensor").alias("reason")).unionByName(skipped.select("event_id", "reason"))


@query("training_features", f"""WITH {SIG_SQL}, {SEG_SQL}, b AS (SELECT trip_id, segment, max(ts_us) AS e FROM seg GROUP BY trip_id, segment),
p AS (SELECT trip_id, event_id, ts_us + 2 * {HOUR_US} AS at FROM sig)
SELECT p.event_id::VARCHAR AS event_id, p.trip_id FROM p JOIN b ON b.trip_id = p.trip_id AND p.at BETWEEN b.segment AND b.e""")
def training_features(spark, folder):
    """Labelled events inside a recording, with features re-extracted from fused segments (ids compared)."""
    s = sensor(spark, folder).withColumns({f"a{a}": F.col(f"lin_a{a}") + F.col(f"grav_{a}") for a in "xyz"})
    events = s.select("event_id", "trip_id", (F.col("ts_us") + 2 * HOUR_US).alias("at"))
    truth = s.select("event_id", F.col("cls").alias("label"))
    numeric = ["ax", "ay", "az", "lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z", "gx", "gy", "gz", "speed"]
    out = labelled_feature_rows(s.select("trip_id", "ts_us", *numeric), events, truth, None,
                                Axis(("trip_id",), ("ts_us",), sig_axis(s).chunk_len), numeric, BIN, window=SIG_WINDOW)
    kept = out.where(F.col("vertical_energy") >= 0)
    return kept.select(F.col("event_id").cast("string").alias("event_id"), "trip_id")
