"""Queries that replay the event table as a stream and read back what the stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwave.functions.exprs import best_class
from tripwave.operators import evaluation, models
from tripwave.plans.model_queries import DIMS, SMALL, _table, _task
from tripwave.plans.registry import SQL, query, r6, rounded
from tripwave.plans.sample_queries import SIG_DETECTION
from tripwave.plans.views import DAY_US, HOUR_US, SENSOR_SQL, SIG_SQL, sensor_columns, sig_columns
from tripwave.plans.window_queries import SIG_CLUSTER, cluster_sql
from tripwave.sources import stage
from tripwave.sources.tables import read_table
from tripwave.streaming import streams


FILES_AT_ONCE = 256


def replay(spark, folder):
    """Event files as a stream of samples with an event-time column ``at``, a few files in each micro-batch."""
    raw = streams.ingest(spark, f"{folder}/events*.parquet", read_table(spark, folder, "events").schema, FILES_AT_ONCE)
    return sensor_columns(sig_columns(raw)).withColumn("at", F.timestamp_micros("ts_us"))


@query("stream_dedupe", f"""WITH {SIG_SQL} SELECT event_id, trip_id, ts_us FROM sig""")
def stream_dedupe(spark, folder):
    """Every event sent twice; one of each is kept."""
    s = replay(spark, folder).select("event_id", "trip_id", "ts_us", "at")
    twice = s.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return streams.drain(streams.unique_samples(twice, "trip_id", "at", "1 hour").drop("at"), "dedupe")


@query("stream_features", f"""WITH {SENSOR_SQL}, mx AS (SELECT max(ts_us) // 1000 * 1000 - {HOUR_US} AS wm FROM sensor),
e AS (SELECT *, unnest([ts_us // {2 * DAY_US} * {2 * DAY_US} - {2 * DAY_US}, ts_us // {2 * DAY_US} * {2 * DAY_US}]) AS ws, sqrt(gx*gx + gy*gy + gz*gz) AS gm FROM sensor),
d AS (SELECT *, magnitude - lag(magnitude) OVER o AS dm, gm - lag(gm) OVER o AS dg FROM e WINDOW o AS (PARTITION BY trip_id, ws ORDER BY ts_us))
SELECT trip_id, ws AS window_start, ws + {4 * DAY_US} AS window_end, r6(avg(magnitude)) AS mag_mean, r6(stddev_pop(magnitude)) AS mag_std, max(magnitude) AS mag_max,
  r6(sqrt(avg(magnitude * magnitude))) AS mag_rms, r6(avg(abs(dm))) AS mag_jrk, r6(avg(a_vertical)) AS vert_mean, r6(stddev_pop(a_vertical)) AS vert_std,
  r6(max(a_vertical)) AS vert_max, r6(min(a_vertical)) AS vert_min, r6(sqrt(avg(a_vertical * a_vertical))) AS vert_rms, r6(avg(lat)) AS lat_mean,
  r6(avg(lon)) AS lon_mean, r6(avg(speed)) AS speed_mean, r6(avg(gm)) AS gyro_mag_mean, r6(max(gm)) AS gyro_mag_max, r6(avg(abs(dg))) AS gyro_mag_jrk,
  r6(stddev_pop(gx)) AS gyro_x_std, r6(stddev_pop(gy)) AS gyro_y_std, r6(stddev_pop(gz)) AS gyro_z_std
FROM d, mx GROUP BY trip_id, ws, wm HAVING count(*) >= 3 AND ws + {4 * DAY_US} <= wm""")
def stream_features(spark, folder):
    """Closed epoch-aligned windows of four days every two days."""
    out = streams.drain(streams.sliding_features(replay(spark, folder), "trip_id", "at", "1 hour", "4 days", "2 days"), "windows")
    return rounded(out, *[c for c in out.columns if c not in ("trip_id", "window_start", "window_end", "mag_max")])


@query("stream_sessions", f"""WITH {SIG_SQL}, mx AS (SELECT max(ts_us) // 1000 * 1000 - {HOUR_US} AS wm FROM sig),
st AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us) >= {DAY_US} THEN 1 ELSE 0 END AS f FROM sig),
k AS (SELECT *, sum(f) OVER (PARTITION BY trip_id ORDER BY ts_us) AS s FROM st)
SELECT trip_id, min(ts_us) AS segment, max(ts_us) AS segment_end, count(*) AS segment_rows FROM k, mx GROUP BY trip_id, s, wm HAVING max(ts_us) + {DAY_US} <= wm""")
def stream_sessions(spark, folder):
    """Closed sessions with gaps under a day."""
    return streams.drain(streams.sessions(replay(spark, folder), "trip_id", "at", "1 hour", "1 day"), "sessions")


@query("stream_cooldown", SQL["cooldown_triggers"])
def stream_cooldown(spark, folder):
    s = replay(spark, folder).withColumn("prob", F.col("v") / 100)
    out = streams.drain(streams.cooldown(s, "trip_id", ["ts_us", "event_id"], "prob", 0.35, DAY_US, "at", "1 hour", 1_000), "cooldown")
    return rounded(out.select("trip_id", "event_id", "ts_us", "prob"), "prob")


@query("stream_bandpass", SQL["bandpass_iir"])
def stream_bandpass(spark, folder):
    out = streams.drain(streams.causal_filters(replay(spark, folder), "trip_id", ["ts_us", "event_id"], "v"), "filters")
    return out.select("trip_id", "event_id", r6("bandpass").alias("y"))


FUSED_SQL = f"""{SENSOR_SQL},
flat AS (SELECT *, sqrt(grav_x * grav_x + grav_y * grav_y + grav_z * grav_z) AS gn FROM sensor),
raw AS (SELECT *, CASE WHEN gn = 0 THEN 0 ELSE (lin_ax * grav_x + lin_ay * grav_y + lin_az * grav_z) / gn END AS vert,
  row_number() OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) - 1 AS idx FROM flat),
lagged AS (SELECT *, coalesce(lag(vert, 2) OVER w, 0) AS x2, coalesce(lag(vert, 4) OVER w, 0) AS x4 FROM raw WINDOW w AS (PARTITION BY trip_id ORDER BY idx)),
drive AS (SELECT trip_id, event_id, idx, g, 0.19061660009749753 * vert - 0.38123320019499507 * x2 + 0.19061660009749753 * x4 AS f FROM lagged),
y AS (SELECT trip_id, event_id, idx, g, f AS y0, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS y3 FROM drive WHERE idx = 0
  UNION ALL
  SELECT d.trip_id, d.event_id, d.idx, d.g, d.f + 2.3350824020765124::DOUBLE * y.y0 - 1.9509646897792021::DOUBLE * y.y1
    + 0.8192636853124013::DOUBLE * y.y2 - 0.2066719851665643::DOUBLE * y.y3, y.y0, y.y1, y.y2
  FROM y JOIN drive d ON d.trip_id = y.trip_id AND d.idx = y.idx + 1),
en AS (SELECT *, coalesce(stddev_samp(y0) OVER w, 0) AS energy, avg(g) OVER w AS genergy FROM y
  WINDOW w AS (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
thr AS (
  SELECT trip_id, idx, energy AS b, 0.0::DOUBLE AS d, genergy AS gb, 0.0::DOUBLE AS gd FROM en WHERE idx = 0
  UNION ALL
  SELECT en.trip_id, en.idx, 0.05::DOUBLE * en.energy + 0.95::DOUBLE * thr.b, 0.05 * abs(en.energy - (0.05 * en.energy + 0.95 * thr.b)) + 0.95 * thr.d,
    0.05::DOUBLE * en.genergy + 0.95::DOUBLE * thr.gb, 0.05 * abs(en.genergy - (0.05 * en.genergy + 0.95 * thr.gb)) + 0.95 * thr.gd
  FROM thr JOIN en ON en.trip_id = thr.trip_id AND en.idx = thr.idx + 1)"""


@query("stream_fusion", f"""WITH RECURSIVE {FUSED_SQL}
SELECT en.trip_id, en.event_id, r6(y0) AS a_vertical, r6(energy) AS energy, r6(b + 3 * d) AS threshold, r6(gb + 3 * gd) AS gyro_threshold
FROM en JOIN thr ON en.trip_id = thr.trip_id AND en.idx = thr.idx""")
def stream_fusion(spark, folder):
    """Raw samples to filtered vertical acceleration, energy and thresholds in one stateful stage."""
    out = streams.fused_thresholds(replay(spark, folder), "trip_id", ["ts_us", "event_id"], "g", SIG_DETECTION)
    with streams.rocks_db(spark):
        done = streams.drain(out, "fusion")
    return rounded(done.select("trip_id", "event_id", "a_vertical", "energy", "threshold", "gyro_threshold"),
                   "a_vertical", "energy", "threshold", "gyro_threshold")


IDLE = f"+ {2 * DAY_US // 1000} < (SELECT max(ts_us) // 1000 - 3600000 FROM sig)"
CLOSED = f"""region_end + 2 < (SELECT max(n.idx) FROM num n WHERE n.trip_id = pk.trip_id)
  OR (SELECT max(n.ts_us) // 1000 FROM num n WHERE n.trip_id = pk.trip_id) {IDLE}"""


@query("stream_candidates", f"""WITH RECURSIVE {SIG_SQL}, {cluster_sql('v', CLOSED)},
lst AS (SELECT trip_id, max(ts_us) // 1000 AS newest FROM sig GROUP BY trip_id),
g AS (SELECT trip_id, c, min(ts_us) AS first, max(ts_us) AS last, arg_max(struct_pack(t := ts_us, lat := lat, lon := lon, v := peak_vertical),
   struct_pack(a := abs(peak_vertical), b := -ts_us)) AS top, max(peak_gyro_mag) AS peak_gyro_mag, sum(peak_speed) AS speed_sum, count(*) AS n_peaks,
   max(c) OVER (PARTITION BY trip_id) AS newest_c FROM cl GROUP BY trip_id, c)
SELECT trip_id, first, last, top.t AS time, top.lat AS lat, top.lon AS lon, top.v AS peak_vertical, peak_gyro_mag, r6(speed_sum) AS speed_sum, n_peaks
FROM g JOIN lst USING (trip_id) WHERE c < newest_c OR newest {IDLE}""")
def stream_candidates(spark, folder):
    """Clusters that closed before the end of the stream."""
    out = streams.candidates(replay(spark, folder), "trip_id", "at", ["ts_us", "event_id"], "v", "g", "1 hour",
                             SIG_DETECTION, SIG_CLUSTER, idle_ms=2 * DAY_US // 1000)
    return rounded(streams.drain(out, "candidates"), "speed_sum")


@query("stream_scoring")
def stream_scoring(spark, folder, path=None):
    """Saved pipeline (or the one at ``path``) applied to vectors arriving as a stream, decided with thresholds, written per batch."""
    path = path or models.save_pipeline(_table(spark, folder), _task(**SMALL), stage.new_folder(spark, "model"))
    raw = streams.ingest(spark, f"{folder}/embeddings*.parquet", read_table(spark, folder, "embeddings").schema, FILES_AT_ONCE)
    live = raw.select(F.col("vec_id").alias("event_id"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(DIMS)])

    def score(batch):
        out = models.batch_score(batch, path)
        return out.select("event_id", best_class(F.col("proba")).alias("pred"),
                          evaluation.threshold_decision(F.col("proba"), 0.4, 0.4).alias("decided"))

    return streams.drain_batches(live, "scores", score)
