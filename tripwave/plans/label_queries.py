"""Queries for labels, suggestions, scalar functions and joins between events, labels and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwave.functions import exprs
from tripwave.operators import labels, reconcile, sampling, windows
from tripwave.operators.ordered import join_per_key, previous
from tripwave.operators.timeseries import large_gaps as find_gaps, segment_bounds, segments
from tripwave.plans.registry import query, r6, rounded
from tripwave.plans.sample_queries import SEG_SQL
from tripwave.plans.views import (DAY_US, HOUR_US, LAB_SQL, MARKED_SQL, SENSOR_SQL, SIG_SQL, lab, marked, sensor, sig,
                                  sig_axis)
from tripwave.sources.tables import read_table
from tripwave.sources.trips import with_accelerometer


@query("magnitude", f"""WITH {SENSOR_SQL}
SELECT event_id, r6(sqrt(lin_ax*lin_ax + lin_ay*lin_ay + lin_az*lin_az)) AS accel, r6(sqrt(gx*gx + gy*gy + gz*gz)) AS gyro FROM sensor""")
def magnitude(spark, folder):
    c = F.col
    return sensor(spark, folder).select("event_id", r6(exprs.magnitude(c("lin_ax"), c("lin_ay"), c("lin_az"))).alias("accel"),
                                        r6(exprs.gyro_magnitude(c("gx"), c("gy"), c("gz"))).alias("gyro"))


@query("haversine_steps", f"""WITH {SIG_SQL},
p AS (SELECT event_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM sig WINDOW w AS (PARTITION BY trip_id ORDER BY ts_us, event_id)),
h AS (SELECT event_id, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS h FROM p)
SELECT event_id, round(12742000 * atan2(sqrt(h), sqrt(1 - h)), 4) AS step_m FROM h""")
def haversine_steps(spark, folder):
    s = sig(spark, folder)
    p = previous(s, sig_axis(s), {"plat": "lat", "plon": "lon"})
    d = exprs.haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return p.select("event_id", F.round(d, 4).alias("step_m"))


@query("gravity_projection", f"""WITH {SENSOR_SQL},
n AS (SELECT *, sqrt(grav_x*grav_x + grav_y*grav_y + grav_z*grav_z) AS gm FROM sensor),
m AS (SELECT *, (lin_ax * grav_x + lin_ay * grav_y + lin_az * grav_z) / (CASE WHEN gm = 0 THEN 1 ELSE gm END) AS vt,
        lin_ax*lin_ax + lin_ay*lin_ay + lin_az*lin_az AS en FROM n)
SELECT event_id, r6(vt) AS a_vert, r6(sqrt(greatest(0, en - vt * vt))) AS a_horiz,
  r6(sqrt(vt * vt + greatest(0, en - vt * vt))) AS a_linear_mag FROM m""")
def gravity_projection(spark, folder):
    c = F.col
    vert, horiz = exprs.gravity_projection((c("lin_ax"), c("lin_ay"), c("lin_az")), (c("grav_x"), c("grav_y"), c("grav_z")))
    s = sensor(spark, folder).select("event_id", vert.alias("a_vert"), horiz.alias("a_horiz"))
    return rounded(s.withColumn("a_linear_mag", exprs.magnitude(c("a_vert"), c("a_horiz"))), "a_vert", "a_horiz", "a_linear_mag")


@query("derived_axes", f"""WITH {SENSOR_SQL}
SELECT event_id, r6(lin_ax + grav_x) AS ax, r6(lin_ay + grav_y) AS ay, r6(lin_az + grav_z) AS az FROM sensor""")
def derived_axes(spark, folder):
    out = with_accelerometer(sensor(spark, folder).drop("ax", "ay", "az"))
    return rounded(out.select("event_id", "ax", "ay", "az"), "ax", "ay", "az")


@query("robust_norm", f"""WITH {SIG_SQL} SELECT event_id, r6((greatest(10, least(80, v)) - 10) / 70) AS norm FROM sig""")
def robust_norm(spark, folder):
    return sig(spark, folder).select("event_id", r6(exprs.robust_normalise(F.col("v"), 10, 80)).alias("norm"))


@query("minmax_norm", f"""WITH {SIG_SQL}, e AS (SELECT trip_id, min(v) AS lo, max(v) AS hi FROM sig GROUP BY trip_id)
SELECT event_id, r6(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (v - lo) / (hi - lo) END) AS norm FROM sig JOIN e USING (trip_id)""")
def minmax_norm(spark, folder):
    s = sig(spark, folder)
    ends = s.groupBy("trip_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return join_per_key(s, ends, ["trip_id"], ["event_id"]).select("event_id", r6(exprs.min_max(F.col("v"), F.col("lo"), F.col("hi"))).alias("norm"))


@query("severity_level", f"""WITH {SIG_SQL}
SELECT event_id, CASE WHEN abs(v - 50) / 9.80665 >= 1.8 OR g / 20.0 >= 6 THEN 'high_conf'
  WHEN abs(v - 50) / 9.80665 >= 1.4 OR g / 20.0 >= 4 THEN 'candidate' ELSE 'normal' END AS level FROM sig""")
def severity_level(spark, folder):
    return sig(spark, folder).select("event_id", exprs.severity_level(exprs.to_g(F.col("v") - 50), F.col("g") / 20.0).alias("level"))


SCORE_SQL = """s0 AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN (v - 50) / 9.80665 / 3 END AS vg, g / 20.0 AS gy, v * 3 AS jk,
    (g % 10) / 50.0 AS du, speed,
    CASE WHEN speed * 3.6 < 30 THEN 1 + 0.5 * exp(-speed * 3.6 / 10) ELSE 1 END AS speed_factor FROM sig),
s1 AS (SELECT event_id, speed_factor, CASE WHEN vg IS NOT NULL THEN greatest(0, least(1, speed_factor * (
    0.45 * (greatest(1.0, least(1.8, abs(vg))) - 1.0) / (1.8 - 1.0) + 0.2 * greatest(0, least(6, gy)) / 6
    + 0.2 * greatest(0, least(400, jk)) / 400 + 0.15 * greatest(0, least(0.15, du)) / 0.15))) END AS score FROM s0)"""


def _scored(spark, folder):
    vg = F.when(F.col("event_type") != "error", exprs.to_g(F.col("v") - 50) / 3)
    s = sig(spark, folder).select(
        "event_id", vg.alias("peak_vertical_g"), (F.col("g") / 20.0).alias("peak_gyro_mag"), (F.col("v") * 3).alias("vert_jrk"),
        ((F.col("g") % 10) / 50.0).alias("event_duration"), F.col("speed").alias("speed_mean"))
    return exprs.score_events(s)


@query("composite_score", f"""WITH {SIG_SQL}, {SCORE_SQL}
SELECT event_id, r6(speed_factor) AS speed_factor, r6(score) AS score FROM s1""")
def composite_score(spark, folder):
    return rounded(_scored(spark, folder).select("event_id", "speed_factor", "score"), "speed_factor", "score")


@query("priority", f"""WITH {SIG_SQL}, {SCORE_SQL}
SELECT event_id, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS priority FROM s1""")
def priority(spark, folder):
    return _scored(spark, folder).select("event_id", "priority")


@query("speed_buckets", f"""WITH {SIG_SQL}
SELECT trip_id, count(*) FILTER (speed < 2) AS low, count(*) FILTER (speed >= 2 AND speed < 8) AS mid,
  count(*) FILTER (speed >= 8) AS high FROM sig GROUP BY trip_id""")
def speed_buckets(spark, folder):
    b = exprs.speed_bucket(F.col("speed"))
    return sig(spark, folder).groupBy("trip_id").agg(*[F.count_if(b == n).alias(n) for n in ("low", "mid", "high")])


@query("unit_check", f"""WITH {SIG_SQL}
SELECT trip_id, max(v) AS max_magnitude, CASE WHEN max(v) < 2 THEN 'too_small' WHEN max(v) > 500 THEN 'too_large' ELSE 'ok' END AS unit
FROM (SELECT trip_id, CASE WHEN v > 300 THEN v * 2 ELSE v END AS v FROM sig) GROUP BY trip_id""")
def unit_check(spark, folder):
    s = sig(spark, folder).withColumn("v", F.when(F.col("v") > 300, F.col("v") * 2).otherwise(F.col("v")))
    out = s.groupBy("trip_id").agg(F.max("v").alias("max_magnitude"))
    return out.withColumn("unit", exprs.unit_check(F.col("max_magnitude")))


RULE_INPUT_SQL = """ri AS (SELECT event_id, v AS pm, (v - 50) / 3 AS vg, g % 6 AS npa, event_id % 7 AS npg, (g % 10) / 10.0 AS asym,
   (event_id % 9) / 10.0 AS dur, (event_id % 12)::DOUBLE AS fft, (g % 5) / 4.0 - 1 AS sk, g::DOUBLE AS pe, (g % 9) / 3.0 AS pr,
   (event_id % 700)::DOUBLE AS ge FROM sig)"""


def _rule_inputs(spark, folder):
    g, e, v = F.col("g"), F.col("event_id"), F.col("v")
    return sig(spark, folder).select(
        "event_id", v.alias("peak_mag"), ((v - 50) / 3).alias("peak_vertical_g"), (g % 6).alias("num_peaks_accel"),
        (e % 7).alias("num_peaks_gyro"), ((g % 10) / 10.0).alias("asymmetry_score"), ((e % 9) / 10.0).alias("local_duration"),
        (e % 12).cast("double").alias("fft_high_low_ratio"), ((g % 5) / 4.0 - 1).alias("skewness"),
        g.cast("double").alias("gyro_pitch_energy"), ((g % 9) / 3.0).alias("gyro_pitch_roll_ratio"),
        (e % 700).cast("double").alias("gyro_energy"))


RULE_SQL = """CASE WHEN pm >= 45 THEN 'R10' WHEN npg >= 3 AND asym > 0.6 AND abs(vg) < 12 THEN 'R5'
  WHEN abs(vg) >= 15 AND (fft >= 10 OR sk < -0.5) THEN 'R1' WHEN abs(vg) >= 12 AND fft < 5 AND pr > 1.5 THEN 'R3'
  WHEN abs(vg) >= 10 AND npa >= 3 AND dur > 0.4 THEN 'R7' WHEN abs(vg) < 6 AND npa <= 1 THEN 'R6'"""


@query("label_rules", f"""WITH {SIG_SQL}, {RULE_INPUT_SQL},
r AS (SELECT *, {RULE_SQL} WHEN npg >= 4 AND ge > 400 THEN 'R11' ELSE 'R9' END AS rule FROM ri),
l AS (SELECT *, CASE rule WHEN 'R10' THEN CASE WHEN pr > 1.8 AND pe > 40 THEN 'Speed Bump' ELSE 'Pothole' END WHEN 'R5' THEN 'Maneuver'
  WHEN 'R1' THEN 'Pothole' WHEN 'R3' THEN 'Speed Bump' WHEN 'R7' THEN 'Rough Road' WHEN 'R6' THEN 'Normal' WHEN 'R11' THEN 'Rough Road'
  ELSE 'Non-Event' END AS suggested_raw_label FROM r)
SELECT event_id, rule AS suggestion_rule, suggested_raw_label,
  CASE WHEN suggested_raw_label IN ('Pothole', 'Speed Bump') THEN suggested_raw_label ELSE 'Non-Event' END AS suggested_label,
  CASE WHEN rule IN ('R10', 'R1', 'R3') THEN 'event' WHEN rule = 'R9' THEN 'ambiguous' ELSE 'condition_like' END AS suggested_kind,
  CASE rule WHEN 'R10' THEN 0.98 WHEN 'R5' THEN 0.88 WHEN 'R1' THEN 0.95 WHEN 'R3' THEN 0.92 WHEN 'R7' THEN 0.75 WHEN 'R6' THEN 0.92
    WHEN 'R11' THEN 0.9 ELSE 0.4 END::DOUBLE AS suggestion_confidence, rule IN ('R7', 'R9') AS needs_review FROM l""")
def label_rules(spark, folder):
    out = labels.suggest_labels(_rule_inputs(spark, folder))
    return out.select("event_id", *[c for c in labels.SUGGESTION_COLUMNS if c != "suggestion_reason"])


@query("ml_or_rules", f"""WITH {SIG_SQL}, {RULE_INPUT_SQL},
p AS (SELECT ri.*, CASE WHEN event_id % 5 > 0 THEN (event_id % 97) / 96.0 END AS b FROM ri),
q AS (SELECT *, CASE WHEN b IS NULL THEN NULL ELSE greatest(b, (1 - b) / 2) END AS best FROM p),
r AS (SELECT *, CASE WHEN best >= 0.65 THEN 'ML_Ensemble(RF+GBT)' ELSE {RULE_SQL} WHEN best IS NOT NULL THEN 'ML_Ensemble(RF+GBT)_LOW_CONF'
   WHEN npg >= 4 AND ge > 400 THEN 'R11' ELSE 'R9' END END AS rule FROM q)
SELECT event_id, rule AS suggestion_rule, r6(CASE WHEN rule LIKE 'ML%' THEN best END) AS ml_confidence,
  CASE WHEN rule = 'ML_Ensemble(RF+GBT)' THEN best < 0.8 ELSE rule LIKE '%LOW_CONF' OR rule IN ('R7', 'R9') END AS needs_review FROM r""")
def ml_or_rules(spark, folder):
    b = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 97) / 96.0)
    votes = labels.mean_probability([F.array((1 - b) / 2, b, (1 - b) / 2)] * 2)
    proba = F.when(b.isNotNull(), votes)
    out = labels.suggest_labels(_rule_inputs(spark, folder), proba, "RF+GBT")
    conf = F.when(F.col("suggestion_rule").startswith("ML"), F.col("suggestion_confidence"))
    return out.select("event_id", "suggestion_rule", r6(conf).alias("ml_confidence"), "needs_review")


@query("taxonomy_map", f"""WITH {SIG_SQL},
r AS (SELECT event_id, ['Non-Event','Pothole','Speed Bump','Maneuver','Rough Road','Normal','Crack','Other'][g % 8 + 1] AS raw FROM sig)
SELECT event_id, CASE WHEN raw IN ('Pothole', 'Speed Bump') THEN raw ELSE 'Non-Event' END AS label FROM r""")
def taxonomy_map(spark, folder):
    names = F.array(*[F.lit(x) for x in (*labels.RAW_TO_CLASS, "Other")])
    return sig(spark, folder).select("event_id", labels.taxonomy(F.element_at(names, F.col("g") % 8 + 1)).alias("label"))


@query("alias_normalise", f"""WITH {SIG_SQL},
r AS (SELECT event_id, ['  Lubang', 'POLISI TIDUR ', 'jalan mulus', 'speed_bump', 'hole', 'jembatan', 'unknown thing'][g % 7 + 1] AS raw FROM sig)
SELECT event_id, CASE lower(trim(raw)) WHEN 'lubang' THEN 'Pothole' WHEN 'hole' THEN 'Pothole' WHEN 'polisi tidur' THEN 'Speed Bump'
  WHEN 'speed_bump' THEN 'Speed Bump' WHEN 'jalan mulus' THEN 'Non-Event' WHEN 'jembatan' THEN 'Non-Event' END AS label FROM r""")
def alias_normalise(spark, folder):
    raw = F.array(*[F.lit(x) for x in ("  Lubang", "POLISI TIDUR ", "jalan mulus", "speed_bump", "hole", "jembatan", "unknown thing")])
    return sig(spark, folder).select("event_id", labels.normalise_alias(F.element_at(raw, F.col("g") % 7 + 1)).alias("label"))


@query("relative_time", f"""WITH {SIG_SQL}, s0 AS (SELECT trip_id, min(ts_us) + {HOUR_US} AS start FROM sig GROUP BY trip_id),
r AS (SELECT event_id, ts_us, (ts_us - start) / 1e6 AS rel FROM sig JOIN s0 USING (trip_id))
SELECT event_id, r6(rel) AS rel_s, strftime(make_timestamp(ts_us // 1000 * 1000) + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time,
  format('{{}} menit {{}} detik', greatest(0, floor(rel)::BIGINT) // 60, greatest(0, floor(rel)::BIGINT) % 60) AS text FROM r""")
def relative_time(spark, folder):
    s = sig(spark, folder)
    start = s.groupBy("trip_id").agg((F.min("ts_us") + HOUR_US).alias("start"))
    rows = join_per_key(s, start, ["trip_id"], ["event_id"]).withColumn("rel_s", (F.col("ts_us") - F.col("start")) / 1e6)
    local = F.date_format(exprs.local_time(F.floor(F.col("ts_us") / 1000)), "yyyy-MM-dd HH:mm:ss")
    return rows.select("event_id", r6("rel_s").alias("rel_s"), local.alias("local_time"), exprs.minute_second_text(F.col("rel_s")).alias("text"))


@query("timebase_guard", f"""WITH {SIG_SQL}, s0 AS (SELECT trip_id, min(ts_us) / 1e6 AS start FROM sig GROUP BY trip_id)
SELECT trip_id, r6(CASE trip_id % 3 WHEN 0 THEN start + 60 ELSE start END) AS trip_start FROM s0""")
def timebase_guard(spark, folder):
    s = sig(spark, folder).groupBy("trip_id").agg((F.min("ts_us") / 1e6).alias("start"))
    meta = F.when(F.col("trip_id") % 3 == 0, F.col("start") + 60).when(F.col("trip_id") % 3 == 1, F.lit(5000.0))
    return s.select("trip_id", r6(exprs.guarded_start(F.col("start"), meta)).alias("trip_start"))


@query("map_link", """SELECT c_custkey, 'https://www.google.com/maps?q=' || c_custkey::VARCHAR || ',' || c_nationkey::VARCHAR AS maps_link,
  split_part('u' || c_custkey::VARCHAR || '-x-y', '-', 1) AS short, 'labels/u' || c_custkey::VARCHAR || '_labels.json' AS path FROM customer""")
def map_link(spark, folder):
    uid = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("-x-y"))
    return read_table(spark, folder, "customer").select(
        "c_custkey", exprs.map_link(F.col("c_custkey"), F.col("c_nationkey")).alias("maps_link"),
        exprs.short_id(uid).alias("short"), exprs.label_path("labels", uid).alias("path"))


@query("to_numeric", """SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') || '.5' END AS DOUBLE) AS x FROM events""")
def to_numeric(spark, folder):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.concat(F.get_json_object("props", "$.k"), F.lit(".5")))
    return read_table(spark, folder, "events").select("event_id", exprs.to_number(raw).alias("x"))


@query("augmented_filter", f"""WITH {LAB_SQL}, s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'augmented_' || source ELSE source END AS src FROM lab)
SELECT doc_id, coalesce(src, 'original') AS src FROM s WHERE NOT coalesce(src, 'original') LIKE 'augmented%'""")
def augmented_filter(spark, folder):
    src = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("augmented_"), F.col("source"))).otherwise(F.col("source"))
    rows = lab(spark, folder).select("doc_id", src.alias("src"))
    return rows.where(~exprs.is_augmented(F.col("src"))).select("doc_id", F.coalesce("src", F.lit("original")).alias("src"))


@query("skip_reason", f"""WITH {SIG_SQL}, {MARKED_SQL},
st AS (SELECT trip_id, ts_us, (ts_us - lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id)) / {DAY_US}::DOUBLE AS step FROM sig),
sp AS (SELECT trip_id, min(ts_us) AS t0, max(ts_us) AS t1 FROM sig GROUP BY trip_id),
g AS (SELECT m.ev, max(step) / 3 AS mg FROM marked m JOIN st ON st.trip_id = m.trip_id AND st.ts_us BETWEEN m.at - {2 * DAY_US} AND m.at + {2 * DAY_US} GROUP BY m.ev)
SELECT m.ev, CASE WHEN mg > 0.5 THEN 'gap_buffer' WHEN (m.at - t0) / {DAY_US}::DOUBLE < 1 OR (t1 - m.at) / {DAY_US}::DOUBLE < 1 THEN 'extract_failed'
  ELSE 'short_segment' END AS reason FROM marked m JOIN g USING (ev) JOIN sp USING (trip_id)""")
def skip_reason(spark, folder):
    s = sig(spark, folder)
    steps = previous(s.select("trip_id", "ts_us", "event_id"), sig_axis(s), {"_b": "ts_us"})
    steps = steps.select("trip_id", "ts_us", ((F.col("ts_us") - F.col("_b")) / float(DAY_US)).alias("step"))
    span = s.groupBy("trip_id").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    m = marked(spark, folder)
    worst = windows.range_join(steps, m, "trip_id", "ts_us", "at", 2 * DAY_US, 2 * DAY_US).groupBy("ev").agg((F.max("step") / 3).alias("gap"))
    rows = join_per_key(m.join(worst, "ev"), span, ["trip_id"], ["ev"])
    days = float(DAY_US)
    return rows.select("ev", exprs.skip_reason(F.col("gap"), (F.col("at") - F.col("t0")) / days, (F.col("t1") - F.col("at")) / days).alias("reason"))


@query("softmax_argmax", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT vec_id, list_transform(x, lambda z: exp(z * 10)) AS e FROM v),
p AS (SELECT vec_id, list_transform(e, lambda z: z / list_sum(e)) AS p FROM e)
SELECT vec_id, r6(list_max(p)) AS confidence, (list_position(p, list_max(p)) - 1)::INTEGER AS pred FROM p""")
def softmax_argmax(spark, folder):
    x = F.col("embedding").cast("array<double>")
    p = read_table(spark, folder, "embeddings").select("vec_id", exprs.softmax(F.transform(x, lambda z: z * 10)).alias("p"))
    return p.select("vec_id", r6(F.array_max("p")).alias("confidence"), exprs.best_class(F.col("p")).alias("pred"))


@query("labelled_events", """SELECT e.event_id, e.user_id, l.quality AS label FROM events e JOIN labels l ON e.event_id = l.doc_id""")
def labelled_events(spark, folder):
    gt = read_table(spark, folder, "labels").select(F.col("doc_id").alias("event_id"), F.col("quality").alias("label"))
    return read_table(spark, folder, "events").select("event_id", "user_id").join(gt, "event_id")


@query("meta_first_match", """SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o ON o.o_custkey = c_custkey AND rn = 1""")
def meta_first_match(spark, folder):
    orders = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return reconcile.first_match(read_table(spark, folder, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey")


TOL = 6 * HOUR_US
NEAR_SQL = f"""lb AS (SELECT trip_id, event_id AS label_no, ts_us + (event_id % 11 - 5) * {HOUR_US} AS label_at,
    ['Pothole','Speed Bump','Non-Event','Unsure',''][event_id % 5 + 1] AS label FROM sig),
ne AS (SELECT trip_id, event_id AS ev, ts_us AS ev_at FROM sig),
pr AS (SELECT l.*, e.ev, abs(e.ev_at - l.label_at) AS dt, row_number() OVER (PARTITION BY l.label_no ORDER BY abs(e.ev_at - l.label_at), e.ev) AS rk
  FROM lb l JOIN ne e ON e.trip_id = l.trip_id AND abs(e.ev_at - l.label_at) <= {TOL}),
mt AS (SELECT trip_id, label_no, label, ev, dt FROM pr WHERE rk = 1)"""


def _matched(spark, folder):
    s = sig(spark, folder)
    names = F.array(*[F.lit(x) for x in ("Pothole", "Speed Bump", "Non-Event", "Unsure", "")])
    lb = s.select("trip_id", F.col("event_id").alias("label_no"),
                  (F.col("ts_us") + (F.col("event_id") % 11 - 5) * HOUR_US).alias("label_at"),
                  F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("label"))
    ev = s.select("trip_id", F.col("event_id").alias("ev"), F.col("ts_us").alias("ev_at"))
    return lb, reconcile.nearest_in_time(lb, ev, "trip_id", "label_no", "label_at", "ev", "ev_at", TOL)


@query("nearest_time_label", f"""WITH {SIG_SQL}, {NEAR_SQL} SELECT trip_id, label_no, ev, dt FROM mt""")
def nearest_time_label(spark, folder):
    return _matched(spark, folder)[1]


@query("label_collisions", f"""WITH {SIG_SQL}, {NEAR_SQL},
k AS (SELECT *, CASE label WHEN 'Pothole' THEN 3 WHEN 'Speed Bump' THEN 2 WHEN 'Non-Event' THEN 1 WHEN 'Unsure' THEN 0 ELSE -1 END AS pri FROM mt),
z AS (SELECT *, row_number() OVER (PARTITION BY trip_id, ev ORDER BY pri DESC, dt, label_no) AS rk FROM k),
c AS (SELECT a.trip_id, a.ev, a.label_no, count(b.label_no) AS earlier,
   count(b.label_no) FILTER (b.pri > a.pri OR (b.pri = a.pri AND b.dt <= a.dt)) AS beaten
   FROM k a LEFT JOIN k b ON a.trip_id = b.trip_id AND a.ev = b.ev AND b.label_no < a.label_no GROUP BY ALL),
n AS (SELECT trip_id, ev, count(*) AS n_labels, count(*) FILTER (earlier > 0 AND beaten = 0) AS collisions FROM c GROUP BY ALL)
SELECT z.trip_id, z.ev, z.label, n_labels, collisions FROM z JOIN n ON n.trip_id = z.trip_id AND n.ev = z.ev WHERE rk = 1""")
def label_collisions(spark, folder):
    lb, matched = _matched(spark, folder)
    return reconcile.resolve_collisions(matched.join(lb.select("label_no", "label"), "label_no"), "trip_id", "ev", "label_no", "label", "dt")


@query("migration_counts", f"""WITH {SIG_SQL}, {NEAR_SQL},
t AS (SELECT trip_id, count(*) AS total_labels FROM lb GROUP BY trip_id),
m AS (SELECT trip_id, count(*) AS hit, count(DISTINCT ev) AS mapped FROM mt GROUP BY trip_id)
SELECT trip_id, total_labels, coalesce(mapped, 0) AS mapped, total_labels - coalesce(hit, 0) AS lost FROM t LEFT JOIN m USING (trip_id)""")
def migration_counts(spark, folder):
    lb, matched = _matched(spark, folder)
    done = reconcile.resolve_collisions(matched.join(lb.select("label_no", "label"), "label_no"), "trip_id", "ev", "label_no", "label", "dt")
    return reconcile.migration_counts(lb, matched, done, "trip_id").drop("collisions")


@query("nearest_space", f"""WITH {SIG_SQL},
a AS (SELECT event_id AS a_id, lat + (event_id % 3) * 2e-5 AS lat, lon + (trip_id % 4) * 3e-5 AS lon FROM sig WHERE cls = 'Pothole'),
b AS (SELECT event_id AS b_id, lat, lon FROM sig WHERE cls = 'Speed Bump'),
bd AS (SELECT lat, lon, min(b_id) AS b_id FROM b GROUP BY lat, lon),
h AS (SELECT a_id, b_id, 12742000 * atan2(sqrt(x), sqrt(1 - x)) AS d FROM (
  SELECT a_id, b_id, pow(sin(radians(bd.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(bd.lat)) * pow(sin(radians(bd.lon - a.lon) / 2), 2) AS x
  FROM a JOIN bd ON abs(a.lat - bd.lat) < 0.001 AND abs(a.lon - bd.lon) < 0.001))
SELECT a_id, round(min(d), 4) AS distance_m FROM h WHERE d <= 10 GROUP BY a_id""")
def nearest_space(spark, folder):
    s = sig(spark, folder)
    a = s.where("cls = 'Pothole'").select(F.col("event_id").alias("a_id"), (F.col("lat") + (F.col("event_id") % 3) * 2e-5).alias("lat"),
                                          (F.col("lon") + (F.col("trip_id") % 4) * 3e-5).alias("lon"))
    b = s.where("cls = 'Speed Bump'").select(F.col("event_id").alias("b_id"), "lat", "lon")
    return reconcile.nearest_in_space(a, b, "a_id", "b_id").select("a_id", F.round("distance_m", 4).alias("distance_m"))


@query("gap_buffer_antijoin", f"""WITH {SIG_SQL}, {MARKED_SQL},
gp AS (SELECT * FROM (SELECT trip_id, ts_us AS ge, lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS gs FROM sig) WHERE ge - gs > {2 * DAY_US})
SELECT ev, trip_id FROM marked m WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.trip_id = m.trip_id AND m.at <= ge + {HOUR_US} AND m.at >= gs - {HOUR_US})""")
def gap_buffer_antijoin(spark, folder):
    s, m = sig(spark, folder), marked(spark, folder)
    ax = sig_axis(s)
    hit = reconcile.near_gap(m, find_gaps(s, ax, 2 * DAY_US), ax, "at", HOUR_US)
    return reconcile.missing_ids(m, hit, "ev").select("ev", "trip_id")


@query("gap_distance", f"""WITH {SIG_SQL}, {MARKED_SQL},
gp AS (SELECT * FROM (SELECT trip_id, ts_us AS ge, lag(ts_us) OVER (PARTITION BY trip_id ORDER BY ts_us, event_id) AS gs FROM sig) WHERE ge - gs > {DAY_US}),
h AS (SELECT ev, least(abs(m.at - gs), abs(m.at - ge)) AS d, row_number() OVER (PARTITION BY ev ORDER BY gs DESC) AS rk
  FROM marked m JOIN gp ON gp.trip_id = m.trip_id AND m.at <= ge + {4 * HOUR_US} AND m.at >= gs - {4 * HOUR_US})
SELECT ev, d AS gap_distance FROM h WHERE rk = 1""")
def gap_distance(spark, folder):
    s, m = sig(spark, folder), marked(spark, folder)
    ax = sig_axis(s)
    return reconcile.near_gap(m, find_gaps(s, ax, DAY_US), ax, "at", 4 * HOUR_US).select("ev", "gap_distance")


@query("segment_events", f"""WITH {SIG_SQL}, {SEG_SQL}, probe AS (SELECT trip_id, event_id AS ev, ts_us + {9 * HOUR_US} AS at FROM sig),
b AS (SELECT trip_id, segment, max(ts_us) AS e, count(*) AS n FROM seg GROUP BY trip_id, segment)
SELECT p.ev, b.segment, b.n AS segment_rows FROM probe p LEFT JOIN b ON b.trip_id = p.trip_id AND p.at BETWEEN b.segment AND b.e""")
def segment_events(spark, folder):
    s = sig(spark, folder)
    ax = sig_axis(s)
    bounds = segment_bounds(segments(s.select("trip_id", "ts_us", "event_id"), ax, DAY_US), "trip_id", "ts_us")
    probe = s.select("trip_id", F.col("event_id").alias("ev"), (F.col("ts_us") + 9 * HOUR_US).alias("at"))
    return windows.in_segments(probe, bounds, "trip_id", "at", ax.chunk_len).select("ev", "segment", "segment_rows")


CAND_SQL = f"""cand AS (SELECT trip_id, event_id AS cid, ts_us + {5 * HOUR_US} AS at FROM sig WHERE cls = 'Non-Event')"""


@query("background_exclusion", f"""WITH {SIG_SQL}, {MARKED_SQL}, {CAND_SQL},
k AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.trip_id = c.trip_id AND abs(m.at - c.at) < {4 * HOUR_US}))
SELECT cid, r6(avg(speed)) AS speed_mean FROM k JOIN sig s ON s.trip_id = k.trip_id AND s.ts_us BETWEEN k.at - {12 * HOUR_US} AND k.at + {12 * HOUR_US}
GROUP BY cid HAVING avg(speed) > 7""")
def background_exclusion(spark, folder):
    s, m = sig(spark, folder), marked(spark, folder)
    cand = s.where("cls = 'Non-Event'").select("trip_id", F.col("event_id").alias("cid"), (F.col("ts_us") + 5 * HOUR_US).alias("at"))
    clear = reconcile.away_from_events(cand, m, "trip_id", "at", "at", 4 * HOUR_US, sig_axis(s).chunk_len)
    out = reconcile.moving(clear, s, "trip_id", "ts_us", "at", "cid", 12 * HOUR_US, 7.0)
    return rounded(out.select("cid", "speed_mean"), "speed_mean")


@query("background_sample", f"""WITH {SIG_SQL}, {MARKED_SQL},
lbl AS (SELECT trip_id, cls FROM sig WHERE cls <> 'Non-Event' OR event_id % 3 = 0),
need AS (SELECT greatest(0, 2 * count(*) FILTER (cls <> 'Non-Event') - count(*) FILTER (cls = 'Non-Event')) AS k FROM lbl),
sp AS (SELECT trip_id, min(ts_us) AS t0, max(ts_us) AS t1 FROM sig GROUP BY trip_id),
tr AS (SELECT trip_id, t0 + {DAY_US} + floor(((trip_id * 7919 + a * 104729) % 10007) / 10007.0 * (t1 - t0 - {2 * DAY_US}))::BIGINT AS at, a AS attempt
  FROM sp JOIN (SELECT unnest(generate_series(0, 99)) AS a) ON true WHERE t1 - t0 > {2 * DAY_US} AND trip_id IN (SELECT trip_id FROM lbl)),
ok AS (SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.trip_id = tr.trip_id AND abs(m.at - tr.at) < {2 * HOUR_US})),
mv AS (SELECT ok.trip_id, ok.attempt, ok.at, avg(speed) AS speed_mean FROM ok JOIN sig s ON s.trip_id = ok.trip_id
   AND s.ts_us BETWEEN ok.at - {12 * HOUR_US} AND ok.at + {12 * HOUR_US} GROUP BY ALL HAVING avg(speed) > 2),
nb AS (SELECT *, row_number() OVER (ORDER BY trip_id, attempt) - 1 AS i FROM mv)
SELECT 'bg_' || i::VARCHAR AS event_id, nb."at", trip_id, 'Non-Event' AS cls, 'auto_background' AS source, r6(speed_mean) AS speed_mean
FROM nb JOIN need ON i < k""")
def background_sample(spark, folder):
    s = sig(spark, folder)
    labelled = s.where("cls <> 'Non-Event' OR event_id % 3 = 0").select("trip_id", "cls")
    unit = ((F.col("trip_id") * 7919 + F.col("attempt") * 104729) % 10007) / 10007.0
    out = sampling.background_sample(s, marked(spark, folder), labelled, "trip_id", "ts_us", "at", "cls", unit, DAY_US,
                                     2 * HOUR_US, 12 * HOUR_US, sig_axis(s).chunk_len, F.floor(F.col("trip_id") / 32))
    return rounded(out, "speed_mean")


@query("undersample", f"""WITH {SIG_SQL}, a AS (SELECT floor(count(*) * 0.6) AS k FROM sig WHERE cls <> 'Non-Event'),
n AS (SELECT event_id, cls, row_number() OVER (ORDER BY (event_id * 7919) % 10007, event_id) AS rk FROM sig WHERE cls = 'Non-Event')
SELECT event_id, cls FROM sig WHERE cls <> 'Non-Event' UNION ALL SELECT event_id, cls FROM n JOIN a ON rk <= k""")
def undersample(spark, folder):
    s = sig(spark, folder).select("event_id", "cls").withColumn("key", (F.col("event_id") * 7919) % 10007)
    return sampling.undersample(s, "cls", "Non-Event", ["key", "event_id"], 0.6).drop("key")


@query("noise_filter", f"""WITH {SIG_SQL} SELECT event_id, cls FROM sig WHERE NOT (cls = 'Non-Event' AND (v > 30 OR g / 20.0 > 4 OR event_id % 25 > 20))""")
def noise_filter(spark, folder):
    s = sig(spark, folder).select("event_id", "cls", F.col("v").alias("peak_mag"), (F.col("g") / 20.0).alias("crest_factor"),
                                  (F.col("event_id") % 25).alias("snr_vertical"))
    return sampling.drop_noisy_negatives(s, "cls").select("event_id", "cls")


@query("semi_trips", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_trips(spark, folder):
    dev = read_table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reconcile.keep_trips(read_table(spark, folder, "orders").select("o_orderkey", "o_custkey"), dev, "o_custkey", ["o_orderkey"])


@query("align_models", f"""WITH {LAB_SQL} SELECT a.doc_id, a.score AS a_score, b.label AS b_label FROM lab a JOIN embeddings b ON a.doc_id = b.vec_id""")
def align_models(spark, folder):
    a = lab(spark, folder).select("doc_id", F.col("score").alias("a_score"))
    b = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b_label"))
    return reconcile.align(a, b, "doc_id")


@query("lookup_default", """SELECT e.event_id, coalesce(c.c_name, 'Unknown Trip') AS trip_name FROM events e
  LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = e.user_id""")
def lookup_default(spark, folder):
    names = read_table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("trip_name"))
    return reconcile.lookup(read_table(spark, folder, "events").select("event_id", "user_id"), names, "user_id",
                            {"trip_name": "Unknown Trip"}).drop("user_id")


@query("latest_label", """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_label(spark, folder):
    o = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return reconcile.latest(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("label_upsert", """SELECT doc_id, quality, toxic FROM labels WHERE NOT (doc_id % 5 = 0)
  UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def label_upsert(spark, folder):
    now = read_table(spark, folder, "labels")
    redone = now.where("doc_id % 5 = 0").withColumn("quality", 1 - F.col("quality"))
    new = reconcile.missing_ids(read_table(spark, folder, "documents").select("doc_id"), now, "doc_id")
    new = new.select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return reconcile.upsert(now, redone.unionByName(new), "doc_id")


@query("union_background", f"""WITH {SIG_SQL}, {MARKED_SQL}
SELECT ev::VARCHAR AS event_id, trip_id, m.at, label, NULL::VARCHAR AS source FROM marked m
UNION ALL SELECT 'bg_' || event_id::VARCHAR, trip_id, ts_us, 'Non-Event', 'auto_background' FROM sig WHERE cls = 'Non-Event'""")
def union_background(spark, folder):
    bg = sig(spark, folder).where("cls = 'Non-Event'").select(
        F.concat(F.lit("bg_"), F.col("event_id").cast("string")).alias("event_id"), "trip_id", F.col("ts_us").alias("at"),
        F.lit("Non-Event").alias("label"), F.lit("auto_background").alias("source"))
    return reconcile.union_background(marked(spark, folder).withColumnRenamed("ev", "event_id"), bg)


@query("skipped_events", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def skipped_events(spark, folder):
    return reconcile.missing_ids(read_table(spark, folder, "documents").select("doc_id"), read_table(spark, folder, "labels"), "doc_id")


@query("shared_events", """SELECT vec_id FROM embeddings INTERSECT SELECT doc_id FROM labels""")
def shared_events(spark, folder):
    return reconcile.shared_ids(read_table(spark, folder, "embeddings"),
                                read_table(spark, folder, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")


@query("distinct_trips", f"""WITH {SIG_SQL} SELECT DISTINCT trip_id, cls FROM sig""")
def distinct_trips(spark, folder):
    return sig(spark, folder).select("trip_id", "cls").distinct()
