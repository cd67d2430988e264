"""Queries over sample streams: cleaning, gaps, resampling, rolling and recursive signals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tripwave.operators import fusion, peaks, timeseries as ts_ops
from tripwave.operators.ordered import Axis, row_index
from tripwave.params import Detection, Resampling
from tripwave.plans.registry import query, r6, rounded
from tripwave.plans.views import DAY_US, HOUR_US, SIG_SQL, sig, sig_axis

BIN = Resampling(bin_len=6 * HOUR_US, max_gap=DAY_US)
SIG_DETECTION = Detection(window_rows=5, alpha=0.05, min_dist_rows=2, gyro_trigger=75.0)


@query("dedupe_samples", f"""WITH {SIG_SQL}
SELECT trip_id, slot, event_id, v FROM (
  SELECT *, ts_us // {6 * HOUR_US} AS slot,
         row_number() OVER (PARTITION BY trip_id, ts_us // {6 * HOUR_US} ORDER BY event_id) AS rn FROM sig)
WHERE rn = 1""")
def dedupe_samples(spark, folder):
    s = sig(spark, folder).withColumn("slot", F.expr(f"ts_us div {6 * HOUR_US}"))
    return ts_ops.dedupe_samples(s.select("trip_id", "slot", "event_id", "v"), "trip_id", "slot", "event_id")


@query("large_gaps", f"""WITH {SIG_SQL}
SELECT trip_id, gap_start, gap_end, gap_end - gap_start AS gap_len FROM (
  SELECT trip_id, ts_us AS gap_end, lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS gap_start FROM sig)
WHERE gap_end - gap_start > {DAY_US}""")
def large_gaps(spark, folder):
    s = sig(spark, folder)
    return ts_ops.large_gaps(s, sig_axis(s), DAY_US)


SEG_SQL = f"""steps AS (
  SELECT *, lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS before FROM sig),
numbered AS (
  SELECT *, sum(CASE WHEN ts_us - before > {DAY_US} THEN 1 ELSE 0 END)
              OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS k FROM steps),
seg AS (SELECT *, min(ts_us) OVER (PARTITION BY trip_id, k) AS segment FROM numbered)"""


@query("segments", f"""WITH {SIG_SQL}, {SEG_SQL}
SELECT trip_id, segment, max(ts_us) AS segment_end, count(*) AS segment_rows FROM seg GROUP BY trip_id, segment""")
def segments(spark, folder):
    s = sig(spark, folder)
    cut = ts_ops.segments(s.select("trip_id", "ts_us", "event_id"), sig_axis(s), DAY_US)
    return ts_ops.segment_bounds(cut, "trip_id", "ts_us")


@query("gap_quarantine", f"""WITH {SIG_SQL},
steps AS (SELECT trip_id, ts_us - lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS step FROM sig)
SELECT trip_id, max(step) AS max_gap, coalesce(max(step) > {2 * DAY_US}, false) AS rejected FROM steps GROUP BY trip_id""")
def gap_quarantine(spark, folder):
    s = sig(spark, folder)
    return ts_ops.gap_quarantine(s, sig_axis(s), 2 * DAY_US)


@query("resample_mean", f"""WITH {SIG_SQL}
SELECT trip_id, ts_us // {6 * HOUR_US} AS bin, r6(avg(v)) AS v, r6(avg(speed)) AS speed
FROM sig GROUP BY ALL""")
def resample_mean(spark, folder):
    binned = ts_ops.bin_mean(sig(spark, folder), ["trip_id"], "ts_us", ["v", "speed"], p=BIN)
    return rounded(binned, "v", "speed")


GRID_SQL = f"""base AS (SELECT *, ts_us // {6 * HOUR_US} AS bin,
    CASE WHEN event_type <> 'error' THEN v END AS e,
    CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM sig),
bins AS (SELECT trip_id, bin, avg(v) AS v, avg(e) AS e,
    arg_min(kind, ts_us) FILTER (kind IS NOT NULL) AS kind FROM base GROUP BY ALL),
span AS (SELECT trip_id, unnest(generate_series(min(bin), max(bin))) AS bin FROM bins GROUP BY trip_id),
grid AS (SELECT s.trip_id, s.bin, b.bin IS NOT NULL AS observed, b.v, b.e, b.kind
         FROM span s LEFT JOIN bins b ON s.trip_id = b.trip_id AND s.bin = b.bin),
marks AS (SELECT *,
  last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER up AS vp,
  last_value(v IGNORE NULLS) OVER up AS vb,
  first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER down AS vn,
  first_value(v IGNORE NULLS) OVER down AS va,
  last_value(CASE WHEN e IS NOT NULL THEN bin END IGNORE NULLS) OVER up AS ep,
  last_value(e IGNORE NULLS) OVER up AS eb,
  first_value(CASE WHEN e IS NOT NULL THEN bin END IGNORE NULLS) OVER down AS en,
  first_value(e IGNORE NULLS) OVER down AS ea,
  last_value(CASE WHEN kind IS NOT NULL THEN bin END IGNORE NULLS) OVER up AS kp,
  last_value(kind IGNORE NULLS) OVER up AS kb
  FROM grid
  WINDOW up AS (PARTITION BY trip_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY trip_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
filled AS (SELECT trip_id, bin, observed,
  CASE WHEN bin - vp <= 10 THEN vb + coalesce((va - vb) / (vn - vp), 0) * least(bin - vp, 5) END AS v,
  CASE WHEN bin - ep <= 10 THEN eb + coalesce((ea - eb) / (en - ep), 0) * least(bin - ep, 5) END AS e,
  CASE WHEN bin - kp <= 5 THEN kb END AS kind FROM marks)"""


def _grid(spark, folder, **kw):
    s = sig(spark, folder)
    s = s.withColumn("e", F.when(F.col("event_type") != "error", F.col("v")))
    s = s.withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    return ts_ops.resample(s, ["trip_id"], "ts_us", ["v", "e"], ["v"], sig_axis(s).chunk_len, ["kind"], BIN, **kw)


@query("interpolate_limit", f"""WITH {SIG_SQL}, {GRID_SQL}
SELECT trip_id, bin, observed, r6(v) AS v, r6(e) AS e FROM filled WHERE v IS NOT NULL""")
def interpolate_limit(spark, folder):
    return rounded(_grid(spark, folder).select("trip_id", "bin", "observed", "v", "e"), "v", "e")


@query("ffill_limit", f"""WITH {SIG_SQL}, {GRID_SQL}
SELECT trip_id, bin, kind FROM filled WHERE v IS NOT NULL""")
def ffill_limit(spark, folder):
    return _grid(spark, folder).select("trip_id", "bin", "kind")


@query("drop_unfilled", f"""WITH {SIG_SQL}, {GRID_SQL}
SELECT trip_id, count(*) AS n_rows, count(*) FILTER (NOT observed) AS n_filled,
       r6(sum(e)) AS e_sum, min(bin) * {6 * HOUR_US} AS first_us
FROM filled WHERE v IS NOT NULL AND e IS NOT NULL GROUP BY trip_id""")
def drop_unfilled(spark, folder):
    kept = _grid(spark, folder).na.drop(subset=["v", "e"])
    out = kept.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("observed")).alias("n_filled"),
        F.sum("e").alias("e_sum"), F.min("ts_us").alias("first_us"))
    return rounded(out, "e_sum")


@query("fill_rows", f"""WITH {SIG_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) - 1 AS idx,
      CASE WHEN event_type = 'click' THEN v END AS c FROM sig),
m AS (SELECT *,
  last_value(CASE WHEN c IS NOT NULL THEN idx END IGNORE NULLS) OVER up AS p,
  last_value(c IGNORE NULLS) OVER up AS b,
  first_value(CASE WHEN c IS NOT NULL THEN idx END IGNORE NULLS) OVER down AS q,
  first_value(c IGNORE NULLS) OVER down AS a
  FROM n WINDOW up AS (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                down AS (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT trip_id, idx, r6(CASE WHEN c IS NOT NULL THEN c
  WHEN idx - p <= 4 THEN b + coalesce((a - b) / (q - p), 0) * least(idx - p, 2)
  WHEN q - idx <= 2 THEN a END) AS c FROM m""")
def fill_rows(spark, folder):
    s = sig(spark, folder)
    ax = sig_axis(s)
    s = row_index(s.withColumn("c", F.when(F.col("event_type") == "click", F.col("v"))), ax)
    return rounded(ts_ops.fill_rows(s, ax, "idx", ["c"], 2, 2, 2).select("trip_id", "idx", "c"), "c")


@query("null_ratio_guard", f"""WITH {SIG_SQL}
SELECT trip_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS missing_e,
       count(*) FILTER (event_type = 'error') > count(*) * 0.2 AS rejected FROM sig GROUP BY trip_id""")
def null_ratio_guard(spark, folder):
    s = sig(spark, folder).withColumn("e", F.when(F.col("event_type") != "error", F.col("v")))
    return ts_ops.null_ratio_guard(s, "trip_id", ["e"], 0.2)


@query("min_length_guard", f"""WITH {SIG_SQL}
SELECT trip_id, count(*) AS n, count(*) < 65 AS too_short FROM sig GROUP BY trip_id""")
def min_length_guard(spark, folder):
    return ts_ops.min_length_guard(sig(spark, folder), "trip_id", 65)


@query("sample_rate", f"""WITH {SIG_SQL},
steps AS (SELECT trip_id, ts_us - lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS step FROM sig)
SELECT trip_id, round(median(step), 3) AS median_step, r6(1e9 / median(step)) AS hz,
       CAST(greatest(1, floor(5 * (1e9 / median(step)))) AS BIGINT) AS min_dist
FROM steps WHERE step IS NOT NULL GROUP BY trip_id""")
def sample_rate(spark, folder):
    s = sig(spark, folder)
    out = ts_ops.sample_rate(s, sig_axis(s), 1e9, min_dist_s=5)
    return out.withColumn("median_step", F.round("median_step", 3)).withColumn("hz", r6("hz"))


@query("rolling_stats", f"""WITH {SIG_SQL}
SELECT trip_id, event_id, r6(coalesce(stddev_samp(v) OVER w, 0)) AS roll_std, r6(avg(v) OVER w) AS roll_mean
FROM sig WINDOW w AS (PARTITION BY trip_id ORDER BY ts_us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, folder):
    s = sig(spark, folder).select("trip_id", "ts_us", "event_id", "v")
    out = ts_ops.trailing(s, sig_axis(s), 20, {
        "roll_std": F.stddev_samp("v"), "roll_mean": F.avg("v")}, block_rows=40)
    out = out.withColumn("roll_std", F.coalesce("roll_std", F.lit(0.0)))
    return rounded(out.select("trip_id", "event_id", "roll_std", "roll_mean"), "roll_std", "roll_mean")


NUM_SQL = """num AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) - 1 AS idx FROM sig)"""


@query("ema_baseline", f"""WITH RECURSIVE {SIG_SQL}, {NUM_SQL},
e AS (SELECT trip_id, idx, event_id, v AS slow, v AS fast FROM num WHERE idx = 0
  UNION ALL
  SELECT n.trip_id, n.idx, n.event_id, 0.01 * n.v + 0.99 * e.slow, 0.05 * n.v + 0.95 * e.fast
  FROM e JOIN num n ON n.trip_id = e.trip_id AND n.idx = e.idx + 1)
SELECT trip_id, event_id, r6(slow) AS slow, r6(fast) AS fast FROM e""")
def ema_baseline(spark, folder):
    s = sig(spark, folder).select("trip_id", "ts_us", "event_id", "v")
    ax = sig_axis(s)
    slow = ts_ops.ema_stream(s, ax, "v", 0.01, "slow").drop("idx")
    both = ts_ops.ema_stream(slow, ax, "v", 0.05, "fast")
    return rounded(both.select("trip_id", "event_id", "slow", "fast"), "slow", "fast")


ENERGY_SQL = f"""{NUM_SQL},
en AS (SELECT *, coalesce(stddev_samp(v) OVER w, 0) AS energy, avg(g) OVER w AS genergy FROM num
  WINDOW w AS (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
thr AS (
  SELECT trip_id, idx, CAST(energy AS DOUBLE) AS b, 0.0::DOUBLE AS d, CAST(genergy AS DOUBLE) AS gb, 0.0::DOUBLE AS gd FROM en WHERE idx = 0
  UNION ALL
  SELECT en.trip_id, en.idx,
    0.05::DOUBLE * en.energy + 0.95::DOUBLE * thr.b,
    0.05 * abs(en.energy - (0.05 * en.energy + 0.95 * thr.b)) + 0.95 * thr.d,
    0.05::DOUBLE * en.genergy + 0.95::DOUBLE * thr.gb,
    0.05 * abs(en.genergy - (0.05 * en.genergy + 0.95 * thr.gb)) + 0.95 * thr.gd
  FROM thr JOIN en ON en.trip_id = thr.trip_id AND en.idx = thr.idx + 1),
act AS (
  SELECT en.*, thr.b AS baseline, thr.b + 3 * thr.d AS threshold, thr.gb + 3 * thr.gd AS gyro_threshold,
    (en.energy > thr.b + 3 * thr.d) OR (en.genergy > thr.gb + 3 * thr.gd) OR (en.genergy > 75) AS active
  FROM en JOIN thr ON en.trip_id = thr.trip_id AND en.idx = thr.idx)"""


@query("adaptive_threshold", f"""WITH RECURSIVE {SIG_SQL}, {ENERGY_SQL}
SELECT trip_id, event_id, r6(energy) AS energy, r6(threshold) AS threshold,
       r6(gyro_threshold) AS gyro_threshold, active FROM act""")
def adaptive_threshold(spark, folder):
    s = sig(spark, folder)
    out = peaks.adaptive_energy(s, sig_axis(s), "v", "g", SIG_DETECTION)
    return rounded(out.select("trip_id", "event_id", "energy", "threshold", "gyro_threshold", "active"),
                   "energy", "threshold", "gyro_threshold")


@query("bandpass_iir", f"""WITH RECURSIVE {SIG_SQL}, {NUM_SQL},
lagged AS (SELECT trip_id, event_id, idx, v, coalesce(lag(v, 1) OVER w, 0) AS x1, coalesce(lag(v, 2) OVER w, 0) AS x2,
    coalesce(lag(v, 3) OVER w, 0) AS x3, coalesce(lag(v, 4) OVER w, 0) AS x4 FROM num
    WINDOW w AS (PARTITION BY trip_id ORDER BY idx)),
drive AS (SELECT *, 0.19061660009749753 * v - 0.38123320019499507 * x2 + 0.19061660009749753 * x4 AS f FROM lagged),
y AS (SELECT trip_id, event_id, idx, f AS y0, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS y3 FROM drive WHERE idx = 0
  UNION ALL
  SELECT d.trip_id, d.event_id, d.idx,
    d.f + 2.3350824020765124::DOUBLE * y.y0 - 1.9509646897792021::DOUBLE * y.y1
        + 0.8192636853124013::DOUBLE * y.y2 - 0.2066719851665643::DOUBLE * y.y3, y.y0, y.y1, y.y2
  FROM y JOIN drive d ON d.trip_id = y.trip_id AND d.idx = y.idx + 1)
SELECT trip_id, event_id, r6(y0) AS y FROM y""")
def bandpass_iir(spark, folder):
    s = sig(spark, folder).select("trip_id", "ts_us", "event_id", "v")
    out = fusion.causal_filters(s, sig_axis(s), {"y": "v"}, {})
    return rounded(out.select("trip_id", "event_id", "y"), "y")


@query("lowpass_iir", f"""WITH RECURSIVE {SIG_SQL}, {NUM_SQL},
k AS (SELECT tan(pi() * 0.2) AS k),
c AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b0, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1,
             (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM k),
x AS (SELECT trip_id, event_id, idx, v, coalesce(lag(v, 1) OVER w, v) AS x1,
             coalesce(lag(v, 2) OVER w, lag(v, 1) OVER w, v) AS x2 FROM num WINDOW w AS (PARTITION BY trip_id ORDER BY idx)),
y AS (SELECT trip_id, event_id, idx, v AS y0, v AS y1 FROM x WHERE idx = 0
  UNION ALL
  SELECT x.trip_id, x.event_id, x.idx,
    c.b0 * x.v + 2 * c.b0 * x.x1 + c.b0 * x.x2 - c.a1 * y.y0 - c.a2 * y.y1, y.y0
  FROM y JOIN x ON x.trip_id = y.trip_id AND x.idx = y.idx + 1 JOIN c ON true)
SELECT trip_id, event_id, r6(y0) AS y FROM y""")
def lowpass_iir(spark, folder):
    s = sig(spark, folder).select("trip_id", "ts_us", "event_id", "v")
    out = fusion.causal_filters(s, sig_axis(s), {}, {"y": "v"})
    return rounded(out.select("trip_id", "event_id", "y"), "y")


REGION_SQL = f"""{ENERGY_SQL},
on_rows AS (SELECT trip_id, idx, idx - lag(idx) OVER (PARTITION BY trip_id ORDER BY idx) AS step FROM act WHERE active),
runs AS (SELECT trip_id, idx, sum(CASE WHEN step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY idx) AS k FROM on_rows),
reg AS (SELECT trip_id, min(idx) AS region, max(idx) AS region_end FROM runs GROUP BY trip_id, k),
found AS (
  SELECT r.trip_id, r.region, r.region_end, a.*, row_number() OVER (PARTITION BY r.trip_id, r.region ORDER BY abs(a.v) DESC, a.idx) AS rk
  FROM reg r JOIN act a ON a.trip_id = r.trip_id AND a.idx BETWEEN r.region AND r.region_end),
pk AS (SELECT f.* EXCLUDE (trip_id_1) FROM found f WHERE rk = 1
       AND trip_id IN (SELECT trip_id FROM sig GROUP BY trip_id HAVING count(*) >= 3))"""


@query("active_regions", f"""WITH RECURSIVE {SIG_SQL}, {REGION_SQL}
SELECT trip_id, region, region_end FROM reg""")
def active_regions(spark, folder):
    s = sig(spark, folder)
    ax = sig_axis(s)
    rows = peaks.regions(peaks.adaptive_energy(s, ax, "v", "g", SIG_DETECTION), ax)
    return rows.groupBy("trip_id", "region").agg(F.max("idx").alias("region_end"))


@query("region_peaks", f"""WITH RECURSIVE {SIG_SQL}, {REGION_SQL}
SELECT trip_id, region, region_end, idx, event_id, v FROM pk""")
def region_peaks(spark, folder):
    s = sig(spark, folder)
    ax = sig_axis(s)
    rows = peaks.regions(peaks.adaptive_energy(s, ax, "v", "g", SIG_DETECTION), ax)
    return peaks.region_peaks(rows, ax, "v", ["event_id", "v"])


def sig_peaks(spark, folder):
    s = sig(spark, folder)
    ax = sig_axis(s)
    found = peaks.detect_peaks(s, ax, "v", "g", ["ts_us", "event_id", "lat", "lon", "v", "g", "speed"], SIG_DETECTION)
    found = found.withColumnRenamed("event_id", "peak_id").select(
        "trip_id", "ts_us", "peak_id", "lat", "lon", F.col("v").alias("peak_vertical"), F.abs("v").alias("peak_mag"),
        F.col("g").cast("double").alias("peak_gyro_mag"), F.col("speed").alias("peak_speed"), "energy", "threshold")
    return found, Axis(("trip_id",), ("ts_us", "peak_id"), ax.chunk_len)


@query("detect_peaks", f"""WITH RECURSIVE {SIG_SQL}, {REGION_SQL}
SELECT trip_id, ts_us, event_id AS peak_id, lat, lon, v AS peak_vertical, abs(v) AS peak_mag,
       CAST(g AS DOUBLE) AS peak_gyro_mag, speed AS peak_speed,
       r6(energy) AS energy, r6(threshold) AS threshold FROM pk""")
def detect_peaks(spark, folder):
    return rounded(sig_peaks(spark, folder)[0], "energy", "threshold")


RATED_SQL = REGION_SQL.replace("on_rows AS (", f"""rate AS (SELECT trip_id, greatest(1, floor({2.5 * DAY_US / 1e6} * coalesce(1e6 / nullif(quantile_cont(step, 0.5), 0), 50)))::BIGINT AS apart
  FROM (SELECT trip_id, ts_us - lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS step FROM sig) GROUP BY trip_id),
on_rows AS (""").replace("step > 2 THEN", "step > apart THEN").replace("k FROM on_rows)", "k FROM on_rows JOIN rate USING (trip_id))")


@query("detect_peaks_by_rate", f"""WITH RECURSIVE {SIG_SQL}, {RATED_SQL}, mean AS (SELECT trip_id, avg(threshold) AS mt, avg(gyro_threshold) AS mgt FROM act GROUP BY trip_id)
SELECT pk.trip_id, ts_us, event_id AS peak_id, v, region, region_end, apart AS min_dist, r6(mt) AS mean_threshold, r6(mgt) AS mean_gyro_threshold
FROM pk JOIN rate USING (trip_id) JOIN mean USING (trip_id)""")
def detect_peaks_by_rate(spark, folder):
    """Peaks two and a half days apart, in rows of each trip's own rate, with the trip's mean thresholds."""
    s = sig(spark, folder)
    p = replace(SIG_DETECTION, min_dist_s=2.5 * DAY_US / 1e6)
    found = peaks.detect_peaks_by_rate(s, sig_axis(s), "v", "g", ["ts_us", "event_id", "v"], 1e6, p)
    return rounded(found.select("trip_id", "ts_us", F.col("event_id").alias("peak_id"), "v", "region", "region_end", "min_dist",
                                "mean_threshold", "mean_gyro_threshold"), "mean_threshold", "mean_gyro_threshold")


@query("threshold_summary", f"""WITH RECURSIVE {SIG_SQL}, {ENERGY_SQL}
SELECT trip_id, r6(avg(threshold)) AS mean_threshold, r6(avg(gyro_threshold)) AS mean_gyro_threshold
FROM act GROUP BY trip_id""")
def threshold_summary(spark, folder):
    s = sig(spark, folder)
    ax = sig_axis(s)
    out = peaks.thresholds_per_trip(peaks.adaptive_energy(s, ax, "v", "g", SIG_DETECTION), ax)
    return rounded(out, "mean_threshold", "mean_gyro_threshold")
