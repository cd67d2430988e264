"""Queries for distributions, evaluation, statistics, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwave.functions.exprs import class_name, is_augmented
from tripwave.operators import aggregates, evaluation, split, stats, windows
from tripwave.operators.fusion import welch_bands
from tripwave.operators.ordered import Axis, join_per_key, row_index
from tripwave.operators.windows import channel_rms
from tripwave.params import CLASSES
from tripwave.plans.registry import query, r6, rounded
from tripwave.plans.sample_queries import NUM_SQL
from tripwave.plans.window_queries import welch_sql
from tripwave.plans.views import (DAY_US, HOUR_US, LAB_SQL, LI_FEATURES, LI_SQL, SENSOR_SQL, SIG_SQL, VEC_SQL, lab, li,
                                  sensor, sig, sig_axis, vec)
from tripwave.sources.tables import read_table

FLAGS = ("A", "N", "R")
LONG_SQL = f"{LI_SQL}, lf AS (UNPIVOT (SELECT trip_id, cls, {', '.join(LI_FEATURES)} FROM li) ON {', '.join(LI_FEATURES)} INTO NAME feature VALUE value)"


@query("class_distribution", f"""WITH {SIG_SQL}, c AS (SELECT cls, count(*) AS n FROM sig GROUP BY cls)
SELECT cls, n, r6(n * 100.0 / sum(n) OVER ()) AS pct, r6((max(n) FILTER (cls = 'Non-Event') OVER ()) / n::DOUBLE) AS imbalance FROM c""")
def class_distribution(spark, folder):
    return rounded(aggregates.class_distribution(sig(spark, folder), "cls"), "pct", "imbalance")


@query("trip_summary", f"""WITH {SENSOR_SQL},
e AS (SELECT count(*) AS n_events, count(*) FILTER (v >= 100) AS priority_high, count(*) FILTER (v >= 50 AND v < 100) AS priority_medium,
  count(*) FILTER (v < 50) AS priority_low, count(*) FILTER (g >= 80) AS level_high_conf, count(*) FILTER (g >= 50 AND g < 80) AS level_candidate,
  count(*) FILTER (g < 50) AS level_normal, count(*) FILTER (speed < 2) AS speed_low, count(*) FILTER (speed >= 2 AND speed < 8) AS speed_mid,
  count(*) FILTER (speed >= 8) AS speed_high FROM sensor),
w AS (SELECT count(*) AS n_windows, avg(a_vertical) AS vert_mean, stddev_samp(a_vertical) AS vert_std, max(a_vertical) AS vert_max,
  count(*) FILTER (g > 0) AS gyro_windows, avg(g) FILTER (g > 0) AS gyro_mean, stddev_samp(g) FILTER (g > 0) AS gyro_std, max(g) AS gyro_max FROM sensor),
m AS (SELECT count(*) AS n_trips, sum(o_totalprice) / 1000 AS distance_km, sum(o_orderkey) / 60 AS duration_min,
  sum(o_totalprice) / sum(o_orderkey) * 3.6 AS mean_kmh FROM orders)
SELECT n_trips, r6(distance_km) AS distance_km, r6(duration_min) AS duration_min, r6(mean_kmh) AS mean_kmh, e.*, n_windows, r6(vert_mean) AS vert_mean,
  r6(vert_std) AS vert_std, r6(vert_max) AS vert_max, gyro_windows, r6(gyro_mean) AS gyro_mean, r6(gyro_std) AS gyro_std, gyro_max::DOUBLE AS gyro_max,
  r6(n_events / distance_km) AS events_per_km FROM m, e, w""")
def trip_summary(spark, folder):
    s = sensor(spark, folder)
    pri = F.when(F.col("v") >= 100, "high").when(F.col("v") >= 50, "medium").otherwise("low")
    lvl = F.when(F.col("g") >= 80, "high_conf").when(F.col("g") >= 50, "candidate").otherwise("normal")
    cand = s.select(pri.alias("priority"), lvl.alias("level"), F.col("speed").alias("speed_mean"))
    wins = s.select(F.col("a_vertical").alias("vert_max"), F.col("g").cast("double").alias("gyro_mag_max"))
    meta = read_table(spark, folder, "orders").select(F.col("o_totalprice").alias("distance"), F.col("o_orderkey").alias("duration"))
    return rounded(aggregates.pipeline_summary(cand, wins, meta), "distance_km", "duration_min", "mean_kmh", "vert_mean",
                   "vert_std", "vert_max", "gyro_mean", "gyro_std", "events_per_km")


@query("describe_features", f"""WITH {LONG_SQL}
SELECT feature, r6(avg(value)) AS mean, r6(stddev_samp(value)) AS std, r6(min(value)) AS min, r6(max(value)) AS max FROM lf GROUP BY feature ORDER BY stddev_samp(value) DESC LIMIT 3""")
def describe_features(spark, folder):
    return rounded(aggregates.describe_features(li(spark, folder), LI_FEATURES, 3), "mean", "std", "min", "max")


@query("null_inf_counts", """WITH e AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS a,
  CASE WHEN event_type = 'view' THEN 'inf'::DOUBLE WHEN event_type = 'click' THEN '-inf'::DOUBLE ELSE value END AS b FROM events)
SELECT 'a' AS feature, count(*) FILTER (a IS NULL) AS n_null, count(*) FILTER (abs(a) = 'inf'::DOUBLE) AS n_inf FROM e
UNION ALL SELECT 'b', count(*) FILTER (b IS NULL), count(*) FILTER (abs(b) = 'inf'::DOUBLE) FROM e""")
def null_inf_counts(spark, folder):
    e = read_table(spark, folder, "events")
    inf = F.when(F.col("event_type") == "view", float("inf")).when(F.col("event_type") == "click", float("-inf")).otherwise(F.col("value"))
    return aggregates.missing_and_infinite(
        e.select(F.when(F.col("event_type") != "error", F.col("value")).alias("a"), inf.alias("b")), ["a", "b"])


@query("bounds_rules", """WITH x AS (SELECT min(l_quantity - 10) AS a0, max(l_quantity - 10) AS a1, min(l_discount * 20) AS b0, max(l_discount * 20) AS b1,
  min(l_tax * 20 - 1) AS c0, max(l_tax * 20 - 1) AS c1, min(l_extendedprice) AS d0, max(l_extendedprice) AS d1 FROM lineitem),
r AS (SELECT 'vertical_energy' AS feature, a0 AS lo, a1 AS hi, 'negative' AS broken, a0 < 0 AS bad FROM x
 UNION ALL SELECT 'asymmetry_score', b0, b1, 'outside_unit', b0 < -1.05 OR b1 > 1.05 FROM x
 UNION ALL SELECT 'first_peak_polarity', c0, c1, 'outside_unit', c0 < -1 OR c1 > 1 FROM x
 UNION ALL SELECT 'max_jerk', d0, d1, 'extreme', d1 > 1e4 FROM x UNION ALL SELECT 'linear_jerk_3d_max', d0, d1, 'extreme', false FROM x)
SELECT feature, r6(lo) AS lo, r6(hi) AS hi, broken FROM r WHERE bad""")
def bounds_rules(spark, folder):
    t = read_table(spark, folder, "lineitem").select(
        (F.col("l_quantity") - 10).alias("vertical_energy"), (F.col("l_discount") * 20).alias("asymmetry_score"),
        (F.col("l_tax") * 20 - 1).alias("first_peak_polarity"), F.col("l_extendedprice").alias("max_jerk"),
        F.col("l_extendedprice").alias("linear_jerk_3d_max"))
    return rounded(aggregates.bounds_report(t, t.columns), "lo", "hi")


@query("group_class_matrix", f"""WITH {SIG_SQL} SELECT trip_id, count(*) FILTER (cls = 'Non-Event') AS n_non_event,
  count(*) FILTER (cls = 'Pothole') AS n_pothole, count(*) FILTER (cls = 'Speed Bump') AS n_speed_bump FROM sig GROUP BY trip_id""")
def group_class_matrix(spark, folder):
    return aggregates.group_class_matrix(sig(spark, folder), "trip_id", "cls", CLASSES)


@query("fp_per_trip", f"""WITH {LAB_SQL} SELECT source, count(*) AS n FROM lab WHERE y3 = 0 AND pred = 1 GROUP BY source""")
def fp_per_trip(spark, folder):
    return aggregates.counts_by(lab(spark, folder).where("y3 = 0 AND pred = 1"), "source")


@query("tp_fp_ratio", f"""WITH {LAB_SQL}, o AS (SELECT CASE WHEN y3 = 1 AND pred = 1 THEN 'TP' WHEN y3 = 0 AND pred = 1 THEN 'FP' END AS o,
   n_chars::DOUBLE AS n_chars, score, (doc_id % 13)::DOUBLE AS mod13, pow(score, 6) AS s6, y3 * n_chars + 1.0::DOUBLE AS found_chars, 1.0::DOUBLE - 0.9 * y3 AS missed FROM lab),
f AS (UNPIVOT o ON n_chars, score, mod13, s6, found_chars, missed INTO NAME feature VALUE value),
m AS (SELECT feature, avg(value) FILTER (o = 'TP') AS tp, avg(value) FILTER (o = 'FP') AS fp FROM f GROUP BY feature),
r AS (SELECT *, fp / (tp + 1e-9) AS ratio FROM m)
SELECT feature, r6(tp) AS tp_mean, r6(fp) AS fp_mean, r6(ratio) AS ratio, CASE WHEN ratio < 0.5 OR ratio > 2 THEN 'HIGH' ELSE 'MED' END AS signal
FROM r WHERE ratio < 0.7 OR ratio > 1.5""")
def tp_fp_ratio(spark, folder):
    rows = lab(spark, folder).select(evaluation.outcome(F.col("y3"), F.col("pred")).alias("o"), F.col("n_chars").cast("double").alias("n_chars"), "score",
                                     (F.col("doc_id") % 13).cast("double").alias("mod13"), F.pow("score", F.lit(6.0)).alias("s6"),
                                     (F.col("y3") * F.col("n_chars") + 1.0).alias("found_chars"), (1 - F.col("y3") * 0.9).alias("missed"))
    return rounded(aggregates.outcome_ratio(rows, "o", ["n_chars", "score", "mod13", "s6", "found_chars", "missed"]), "tp_mean", "fp_mean", "ratio")


@query("histogram", f"""WITH {SIG_SQL}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM sig),
b AS (SELECT least(29, floor((v - lo) * 30 / (hi - lo)))::BIGINT AS bin, lo, hi FROM sig, e)
SELECT bin, count(*) AS n, r6(max(lo + bin * ((hi - lo) / 30))) AS edge FROM b GROUP BY bin""")
def histogram(spark, folder):
    return rounded(aggregates.histogram(sig(spark, folder), "v"), "edge")


@query("class_quantiles", f"""WITH {LONG_SQL}
SELECT feature, cls, count(*) AS n, r6(avg(value)) AS mean, r6(stddev_samp(value)) AS std, r6(quantile_cont(value, 0.25)) AS q25,
  r6(quantile_cont(value, 0.5)) AS median, r6(quantile_cont(value, 0.75)) AS q75 FROM lf GROUP BY feature, cls""")
def class_quantiles(spark, folder):
    return rounded(aggregates.class_statistics(li(spark, folder), "cls", LI_FEATURES), "mean", "std", "q25", "median", "q75")


STATS_SQL = """st AS (SELECT trip_id, stddev_pop(a_vertical) AS std, max(abs(a_vertical)) AS max_abs, avg(speed) AS mean_speed,
  quantile_cont(abs(a_vertical), 0.95) AS p95_abs FROM sensor GROUP BY trip_id)"""


@query("trip_signal_stats", f"""WITH {SENSOR_SQL}, {STATS_SQL}
SELECT trip_id, r6(std) AS std, r6(max_abs) AS max_abs, r6(mean_speed) AS mean_speed, r6(p95_abs) AS p95_abs FROM st""")
def trip_signal_stats(spark, folder):
    return rounded(aggregates.signal_stats(sensor(spark, folder), "trip_id", "a_vertical", "speed"), "std", "max_abs", "mean_speed", "p95_abs")


@query("control_trip", f"""WITH {SENSOR_SQL}, {STATS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY std, trip_id) - 1 AS i, count(*) OVER () AS n FROM st WHERE trip_id <> 7),
c AS (SELECT * FROM o WHERE i = n // 2), a AS (SELECT * FROM st WHERE trip_id = 7)
SELECT a.trip_id AS trip, c.trip_id AS control, r6(a.std / (c.std + 1e-9)) AS std_ratio, r6(a.max_abs / (c.max_abs + 1e-9)) AS max_abs_ratio,
  r6(a.mean_speed / (c.mean_speed + 1e-9)) AS mean_speed_ratio, r6(a.p95_abs / (c.p95_abs + 1e-9)) AS p95_abs_ratio,
  a.std / (c.std + 1e-9) > 1.5 AS excess_std FROM a, c""")
def control_trip(spark, folder):
    st = aggregates.signal_stats(sensor(spark, folder), "trip_id", "a_vertical", "speed")
    return rounded(aggregates.control_trip(st, "trip_id", 7), "std_ratio", "max_abs_ratio", "mean_speed_ratio", "p95_abs_ratio")


@query("route_bbox", f"""WITH {SIG_SQL} SELECT trip_id, count(*) AS n_points, r6(avg(lat)) AS lat_mean, r6(avg(lon)) AS lon_mean, r6(min(lat)) AS lat_min,
  r6(max(lat)) AS lat_max, r6(min(lon)) AS lon_min, r6(max(lon)) AS lon_max FROM sig GROUP BY trip_id""")
def route_bbox(spark, folder):
    return rounded(aggregates.route_bounds(sig(spark, folder), "trip_id"), "lat_mean", "lon_mean", "lat_min", "lat_max", "lon_min", "lon_max")


@query("route_polyline", f"""WITH {SIG_SQL} SELECT trip_id, ts_us // {5 * DAY_US} AS piece,
  row_number() OVER (PARTITION BY trip_id, ts_us // {5 * DAY_US} ORDER BY ts_us) - 1 AS pos, r6(lat) AS lat, r6(lon) AS lon FROM sig""")
def route_polyline(spark, folder):
    out = aggregates.route_pieces(sig(spark, folder), "trip_id", "ts_us", 5 * DAY_US)
    points = out.select("trip_id", "piece", F.posexplode("points").alias("pos", "_p"))
    return points.select("trip_id", "piece", F.col("pos").cast("bigint").alias("pos"), r6("_p.lat").alias("lat"), r6("_p.lon").alias("lon"))


EPOCH_SQL = """ep AS (SELECT (doc_id % 4)::INTEGER AS fold, (n_chars % 10)::INTEGER AS epoch, avg(n_chars % 1000) / 1000 AS train_loss,
   avg((n_chars * 7) % 1000) / 1000 AS val_loss, avg((n_chars * 13) % 1000) / 1000 AS val_f1 FROM documents GROUP BY ALL)"""


def _epochs(spark, folder):
    n = F.col("n_chars")
    return read_table(spark, folder, "documents").groupBy((F.col("doc_id") % 4).cast("int").alias("fold"), (n % 10).cast("int").alias("epoch")).agg(
        *[(F.avg((n * k) % 1000) / 1000).alias(c) for c, k in (("train_loss", 1), ("val_loss", 7), ("val_f1", 13))])


@query("learning_curve", f"""WITH {EPOCH_SQL} SELECT epoch, r6(avg(train_loss)) AS train_loss_mean, r6(stddev_pop(train_loss)) AS train_loss_std,
  r6(avg(val_loss)) AS val_loss_mean, r6(stddev_pop(val_loss)) AS val_loss_std, r6(avg(val_f1)) AS val_f1_mean, r6(stddev_pop(val_f1)) AS val_f1_std FROM ep GROUP BY epoch""")
def learning_curve(spark, folder):
    out = aggregates.learning_curve(_epochs(spark, folder))
    return rounded(out, *[c for c in out.columns if c != "epoch"])


@query("best_epochs", f"""WITH {EPOCH_SQL} SELECT fold, epoch, r6(val_f1) AS val_f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY val_f1 DESC, epoch) AS rk FROM ep) WHERE rk = 1""")
def best_epochs(spark, folder):
    return rounded(aggregates.best_epochs(_epochs(spark, folder)), "val_f1")


@query("source_mix", """SELECT CASE WHEN doc_id % 3 = 0 THEN 'augmented' ELSE 'original' END AS kind, lang, count(*) AS n FROM documents GROUP BY ALL""")
def source_mix(spark, folder):
    kind = F.when(F.col("doc_id") % 3 == 0, "augmented").otherwise("original")
    return aggregates.counts_by(read_table(spark, folder, "documents").select(kind.alias("kind"), "lang"), "kind", "lang")


@query("confusion_matrix", f"""WITH {LAB_SQL}, k AS (SELECT unnest([0, 1, 2]) AS c), g AS (SELECT a.c AS truth, b.c AS predicted FROM k a, k b),
n AS (SELECT y3, pred, count(*) AS n FROM lab GROUP BY ALL), t AS (SELECT y3, count(*) AS tot FROM lab GROUP BY y3)
SELECT truth, predicted, coalesce(n, 0) AS n, r6(coalesce(n * 100.0 / tot, 0)) AS row_pct FROM g LEFT JOIN n ON y3 = truth AND pred = predicted LEFT JOIN t ON t.y3 = truth""")
def confusion_matrix(spark, folder):
    return rounded(evaluation.confusion_matrix(lab(spark, folder), "y3", "pred", (0, 1, 2)), "row_pct")


def report_sql(source: str, by: str = "") -> str:
    """Classification report over ``source`` (columns y3, pred), optionally per ``by`` column."""
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""
k AS (SELECT unnest([0, 1, 2]) AS c, unnest(['Non-Event', 'Pothole', 'Speed Bump']) AS label),
m AS (SELECT {b}c, label, count(*) FILTER (y3 = c AND pred = c) AS tp, count(*) FILTER (pred = c) AS called, count(*) FILTER (y3 = c) AS support
      FROM {source} JOIN k ON true GROUP BY {b}c, label),
s AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM m),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s),
n AS (SELECT {b}count(*) AS n, avg((y3 = pred)::INT) AS acc FROM {source} {g}),
rep AS (SELECT {b}label, p AS precision, r AS recall, f1, support FROM f
  UNION ALL SELECT {b}'accuracy', acc, acc, acc, n FROM n
  UNION ALL SELECT {b}'macro avg', avg(p), avg(r), avg(f1), any_value(n) FROM f JOIN n {on} {g}
  UNION ALL SELECT {b}'weighted avg', sum(p * support) / any_value(n), sum(r * support) / any_value(n), sum(f1 * support) / any_value(n), any_value(n) FROM f JOIN n {on} {g})"""


NAMES = dict(enumerate(CLASSES))


@query("classification_report", f"""WITH {LAB_SQL}, {report_sql('lab')}
SELECT label, r6(precision) AS precision, r6(recall) AS recall, r6(f1) AS f1, support FROM rep""")
def classification_report(spark, folder):
    return rounded(evaluation.classification_report(lab(spark, folder), "y3", "pred", NAMES), "precision", "recall", "f1")


@query("per_trip_report", f"""WITH {LAB_SQL}, {report_sql('lab', 'source')}
SELECT source, label, r6(precision) AS precision, r6(recall) AS recall, r6(f1) AS f1, support FROM rep""")
def per_trip_report(spark, folder):
    return rounded(evaluation.classification_report(lab(spark, folder), "y3", "pred", NAMES, ["source"]), "precision", "recall", "f1")


@query("model_comparison", f"""WITH {LAB_SQL}, two AS (SELECT 'trees' AS model, y3, pred FROM lab UNION ALL SELECT 'network', y3, (pred + doc_id) % 3 FROM lab), {report_sql('two', 'model')}
SELECT label, {', '.join(f"r6(max({c}) FILTER (model = '{m}')) AS {m}_{c}" for m in ('trees', 'network') for c in ('precision', 'recall', 'f1'))},
  max(support) FILTER (model = 'trees') AS trees_support, max(support) FILTER (model = 'network') AS network_support FROM rep GROUP BY label""")
def model_comparison(spark, folder):
    a = lab(spark, folder)
    other = ((F.col("pred") + F.col("doc_id")) % 3).cast("int")
    both = a.select(F.lit("trees").alias("model"), "y3", "pred").unionByName(a.select(F.lit("network").alias("model"), "y3", other.alias("pred")))
    out = evaluation.comparison(evaluation.classification_report(both, "y3", "pred", NAMES, ["model"]), "model", ["trees", "network"])
    return rounded(out, *[c for c in out.columns if c != "label" and not c.endswith("support")])


def _corr_sql(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))"


def _wide_features() -> dict[str, str]:
    """47 features of line items as SQL that both engines read; the last ones have unknown and constant values."""
    base = list(LI_FEATURES)
    out = {f: f for f in base}
    out |= {f"{a}_x_{b}": f"{a} * {b}" for i, a in enumerate(base) for b in base[:i + 1]}
    out |= {f"{a}_over_{b}": f"{a} / ({b} + 1)" for a in base for b in base if a != b}
    out |= {f"key_{m}": f"cast(l_orderkey % {m} as double)" for m in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)}
    out |= {f"known_{m}": f"case when l_orderkey % {m} > 0 then l_quantity + l_orderkey % 10 end" for m in (2, 3, 5, 7, 9)}
    out |= {f"big_{m}": f"cast(1000000000 + l_linenumber * {m} as double)" for m in (1, 2, 3)}
    return out | {"constant": "cast(0.1 as double)", "unknown": "cast(null as double)", "rare": "case when l_orderkey % 97 = 0 then l_tax end"}


WIDE = _wide_features()
assert len(WIDE) == 47
WIDE_SQL = f"w AS (SELECT {', '.join(f'({e})::DOUBLE AS {n}' for n, e in WIDE.items())} FROM li)"


def _pair_sql(a: str, b: str) -> str:
    """Correlation on shared rows; 0 where one is constant or nothing is shared."""
    return "0.0" if {a, b} & {"constant", "unknown"} else f"coalesce(corr({a}, {b}), 0.0)"


@query("corr_matrix", f"""WITH {LI_SQL}, {WIDE_SQL}, c AS (SELECT {', '.join(
    f'{_pair_sql(a, b)} AS "{a}|{b}"' for i, a in enumerate(WIDE) for b in list(WIDE)[:i])} FROM w)
SELECT split_part(name, '|', 1) AS feature_a, split_part(name, '|', 2) AS feature_b, r6(r) AS r FROM (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE r)""")
def corr_matrix(spark, folder):
    """All pairs of 47 features, some unknown in places, one never known, one constant."""
    rows = li(spark, folder).select(*[F.expr(e).cast("double").alias(n) for n, e in WIDE.items()])
    return rounded(aggregates.correlation_pairs(rows, list(WIDE)), "r")


@query("target_corr", f"WITH {LI_SQL}, t AS (SELECT *, (cls <> 'N')::INT::DOUBLE AS y FROM li) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, r6(abs({_corr_sql(a, 'y')})) AS abs_r, abs({_corr_sql(a, 'y')}) >= 0.5 AS selected_r05, abs({_corr_sql(a, 'y')}) >= 0.35 AS selected_r035 FROM t"
    for a in LI_FEATURES))
def target_corr(spark, folder):
    return rounded(aggregates.target_correlation(li(spark, folder), LI_FEATURES, F.col("cls") != "N"), "abs_r")


@query("channel_rms_corr", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
r AS (SELECT sqrt(list_sum(list_transform(x[1:20], lambda e: e * e)) / 20) AS a, sqrt(list_sum(list_transform(x[21:40], lambda e: e * e)) / 20) AS b,
   sqrt(list_sum(list_transform(x[41:64], lambda e: e * e)) / 24) AS c FROM v)
SELECT 'b' AS feature_a, 'a' AS feature_b, r6(corr(b, a)) AS r FROM r UNION ALL SELECT 'c', 'a', r6(corr(c, a)) FROM r UNION ALL SELECT 'c', 'b', r6(corr(c, b)) FROM r""")
def channel_rms_corr(spark, folder):
    v = vec(spark, folder)
    parts = v.select(*[channel_rms(F.slice("x", at, n)).alias(c) for c, at, n in (("a", 1, 20), ("b", 21, 20), ("c", 41, 24))])
    return rounded(aggregates.correlation_pairs(parts, ["a", "b", "c"]), "r")


@query("worklist_strata", f"""WITH {SIG_SQL}, p AS (SELECT event_id, v, CASE WHEN v >= 150 THEN 'high' WHEN v >= 60 THEN 'medium' ELSE 'low' END AS pri FROM sig),
r AS (SELECT *, row_number() OVER (PARTITION BY pri ORDER BY (event_id * 7919) % 10007, event_id) AS rk FROM p)
SELECT event_id, v, pri FROM r WHERE pri = 'high' OR rk <= 500""")
def worklist_strata(spark, folder):
    pri = F.when(F.col("v") >= 150, "high").when(F.col("v") >= 60, "medium").otherwise("low")
    rows = sig(spark, folder).select("event_id", "v", pri.alias("pri"))
    order = F.struct((F.col("event_id") * 7919) % 10007, F.col("event_id"))
    return aggregates.worklist(rows, "pri", {"high": None, "medium": 500, "low": 500}, order)


@query("top_errors", f"""WITH {LAB_SQL}, n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS event_no FROM lab)
SELECT doc_id, source, event_no, y3, pred, score FROM lab JOIN n USING (doc_id, source) WHERE y3 = 1 AND pred <> 1 ORDER BY score DESC, doc_id LIMIT 100""")
def top_errors(spark, folder):
    rows = row_index(lab(spark, folder), Axis(("source",), ("doc_id",), 100_000), "_i").withColumn("event_no", F.col("_i") + 1)
    wrong = rows.where("y3 = 1 AND pred <> 1").select("doc_id", "source", "event_no", "y3", "pred", "score")
    return aggregates.top_rows(wrong, [F.desc("score"), F.asc("doc_id")], 100)


@query("best_representatives", f"""WITH {LAB_SQL}, o AS (SELECT doc_id, score, CASE WHEN y3 = 1 AND pred = 1 THEN 'TP' WHEN y3 = 1 AND pred = 0 THEN 'FN' END AS o FROM lab)
SELECT o, arg_max(doc_id, struct_pack(a := score, b := -doc_id)) AS doc_id, max(score) AS score FROM o WHERE o IS NOT NULL GROUP BY o""")
def best_representatives(spark, folder):
    o = F.when((F.col("y3") == 1) & (F.col("pred") == 1), "TP").when((F.col("y3") == 1) & (F.col("pred") == 0), "FN")
    rows = lab(spark, folder).select("doc_id", "score", o.alias("o")).where("o IS NOT NULL")
    return windows.representative(rows, ["o"], F.col("score"), "doc_id", 1).select("o", "doc_id", "score")


# Statistics


@query("pearson_rmse_mae", f"""WITH {LI_SQL} SELECT cls, count(*) AS n, r6({_corr_sql('l_quantity', 'l_tax * 500')}) AS pearson,
  r6(sqrt(avg(pow(l_quantity - l_tax * 500, 2)))) AS rmse, r6(avg(abs(l_quantity - l_tax * 500))) AS mae FROM li GROUP BY cls""")
def pearson_rmse_mae(spark, folder):
    return rounded(stats.agreement(li(spark, folder).withColumn("b", F.col("l_tax") * 500), "l_quantity", "b", ["cls"]), "pearson", "rmse", "mae")


@query("aligned_series", f"""WITH {SIG_SQL}, a AS (SELECT ts_us // {HOUR_US} AS h, avg(v) AS x FROM sig WHERE g < 50 GROUP BY 1), b AS (SELECT ts_us // {HOUR_US} AS h, avg(v) AS y FROM sig WHERE g >= 50 GROUP BY 1)
SELECT count(*) AS n, r6({_corr_sql('x', 'y')}) AS pearson, r6(sqrt(avg(pow(x - y, 2)))) AS rmse, r6(avg(abs(x - y))) AS mae FROM a JOIN b USING (h)""")
def aligned_series(spark, folder):
    s = sig(spark, folder).withColumn("h", F.floor(F.col("ts_us") / HOUR_US))
    a = s.where("g < 50").groupBy("h").agg(F.avg("v").alias("x"))
    b = s.where("g >= 50").groupBy("h").agg(F.avg("v").alias("y"))
    return rounded(stats.agreement(a.join(b, "h"), "x", "y"), "pearson", "rmse", "mae")


PIPES_SQL = f"""a AS (SELECT trip_id, event_id AS id, ts_us AS at, v AS x FROM sig),
b AS (SELECT trip_id, event_id + 1000000 AS id, ts_us + (event_id % 7 - 3) * {HOUR_US} AS at, v + (event_id % 5) / 10.0 AS y FROM sig WHERE event_id % 9 > 0),
near AS (SELECT a.trip_id, a.id AS l, b.id AS r, abs(a.at - b.at) AS dt, x, y, row_number() OVER (PARTITION BY a.trip_id, a.id ORDER BY abs(a.at - b.at), b.id) AS i,
  row_number() OVER (PARTITION BY b.trip_id, b.id ORDER BY abs(a.at - b.at), a.id) AS j FROM a JOIN b ON a.trip_id = b.trip_id AND abs(a.at - b.at) <= {6 * HOUR_US}),
pair AS (SELECT * FROM near WHERE i = 1 AND j = 1)"""


def _pipelines(spark, folder):
    """The samples, and a second stream of them with jitter, holes and another offset."""
    s = sig(spark, folder)
    e = F.col("event_id")
    other = s.where(e % 9 > 0).select("trip_id", (e + 1_000_000).alias("event_id"), (F.col("ts_us") + (e % 7 - 3) * HOUR_US).alias("ts_us"),
                                      (F.col("v") + (e % 5) / 10.0).alias("v"))
    return stats.align_pipelines(s, other, "trip_id", "event_id", "ts_us", "v", 6 * HOUR_US)


@query("aligned_pipelines", f"""WITH {SIG_SQL}, {PIPES_SQL} SELECT trip_id, l AS ident, r AS other, dt, r6(x) AS x, r6(y) AS y FROM pair""")
def aligned_pipelines(spark, folder):
    return rounded(_pipelines(spark, folder).select("trip_id", "ident", "other", "dt", "x", "y"), "x", "y")


@query("pipeline_agreement", f"""WITH {SIG_SQL}, {PIPES_SQL}, c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT x AS v, 1 AS a, 0 AS b FROM pair UNION ALL SELECT y, 0, 1 FROM pair) GROUP BY v),
s AS (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW o AS (ORDER BY v))
SELECT count(*) AS n, r6({_corr_sql('x', 'y')}) AS pearson, r6(sqrt(avg(pow(x - y, 2)))) AS rmse, r6(avg(abs(x - y))) AS mae, r6(avg(dt) / {HOUR_US}) AS mean_hours,
  r6((SELECT max(abs(ca / na - cb / nb)) FROM s)) AS d FROM pair""")
def pipeline_agreement(spark, folder):
    out = stats.pipeline_agreement(_pipelines(spark, folder)).withColumn("mean_hours", F.col("mean_dt") / HOUR_US)
    return rounded(out.select("n", "pearson", "rmse", "mae", "mean_hours", "d"), "pearson", "rmse", "mae", "mean_hours", "d")


@query("ks_two_sample", f"""WITH {LI_SQL}, c AS (SELECT l_extendedprice AS x, count(*) FILTER (cls = 'A') AS a, count(*) FILTER (cls = 'R') AS b FROM li WHERE cls IN ('A', 'R') GROUP BY 1),
s AS (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW o AS (ORDER BY x)),
d AS (SELECT na, nb, max(abs(ca / na - cb / nb)) AS d FROM s GROUP BY na, nb)
SELECT na::BIGINT AS n_a, nb::BIGINT AS n_b, r6(d) AS d, round(CASE WHEN sqrt(na * nb / (na + nb)) * d < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(generate_series(1, 100),
  lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * pow(sqrt(na * nb / (na + nb)) * d, 2)))))) END::DOUBLE, 5) AS p FROM d""")
def ks_two_sample(spark, folder):
    return rounded(stats.ks_two_sample(li(spark, folder), "cls", "A", "R", "l_extendedprice"), "d").withColumn("p", F.round("p", 5))


@query("kruskal", f"""WITH {LONG_SQL}, r AS (SELECT feature, cls, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk,
   count(*) OVER (PARTITION BY feature, value) AS t FROM lf),
n AS (SELECT feature, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY feature),
c AS (SELECT feature, cls, sum(rk) AS s, count(*) AS m FROM r GROUP BY ALL),
h AS (SELECT feature, any_value(n) AS n, count(*) AS k, (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (pow(any_value(n), 3) - any_value(n))) AS h
  FROM c JOIN n USING (feature) GROUP BY feature)
SELECT feature, n::BIGINT AS n, k::INTEGER AS n_classes, round(h, 4) AS h, round(exp(-h / 2), 5) AS p FROM h""")
def kruskal(spark, folder):
    out = stats.kruskal(li(spark, folder), "cls", FLAGS, LI_FEATURES)
    return out.withColumn("h", F.round("h", 4)).withColumn("p", F.round("p", 5))


D_SQL = f"""{LONG_SQL}, m AS (SELECT feature, cls, count(*) AS n, avg(value) AS a, var_samp(value) AS s FROM lf GROUP BY ALL),
dd AS (SELECT x.feature, x.cls AS class_a, y.cls AS class_b, (x.a - y.a) / sqrt(((x.n - 1) * x.s + (y.n - 1) * y.s) / (x.n + y.n - 2)) AS d
  FROM m x JOIN m y ON x.feature = y.feature AND x.cls < y.cls)"""


@query("cohens_d", f"WITH {D_SQL} SELECT feature, class_a, class_b, r6(d) AS d FROM dd")
def cohens_d(spark, folder):
    return rounded(stats.cohens_d(li(spark, folder), "cls", FLAGS, LI_FEATURES), "d")


@query("effect_summary", f"WITH {D_SQL} SELECT feature, r6(max(abs(d))) AS max_abs_d, r6(avg(abs(d))) AS mean_abs_d FROM dd GROUP BY feature")
def effect_summary(spark, folder):
    return rounded(stats.effect_summary(stats.cohens_d(li(spark, folder), "cls", FLAGS, LI_FEATURES)), "max_abs_d", "mean_abs_d")


@query("pca2")
def pca2(spark, folder):
    return rounded(stats.pca2(li(spark, folder), ["l_orderkey", "l_linenumber"], LI_FEATURES), "pc1", "pc2")


# Splits, weights, scaling

SPLIT_SQL = """tc AS (SELECT trip_id, count(*) FILTER (cls = 'A') AS a, count(*) FILTER (cls = 'N') AS n, count(*) FILTER (cls = 'R') AS r FROM li GROUP BY trip_id),
od AS (SELECT *, row_number() OVER (ORDER BY a + r DESC, trip_id) AS i FROM tc),
tt AS (SELECT sum(a) + 1e-9 AS ta, sum(n) + 1e-9 AS tn, sum(r) + 1e-9 AS tr FROM tc),
wk AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS ca, 0::DOUBLE AS cn, 0::DOUBLE AS cr, NULL::BIGINT AS trip_id, false AS up
  UNION ALL
  SELECT z.i, CASE WHEN up THEN z.ca + z.a ELSE z.ca END, CASE WHEN up THEN z.cn + z.n ELSE z.cn END, CASE WHEN up THEN z.cr + z.r ELSE z.cr END, z.trip_id, up FROM (
    SELECT od.i, w.ca, w.cn, w.cr, od.a, od.n, od.r, od.trip_id,
      pow((w.ca + od.a) / ta - 0.8, 2) + pow((w.cn + od.n) / tn - 0.8, 2) + pow((w.cr + od.r) / tr - 0.8, 2)
        < pow(w.ca / ta - 0.8, 2) + pow(w.cn / tn - 0.8, 2) + pow(w.cr / tr - 0.8, 2) AS up
    FROM wk w JOIN od ON od.i = w.i + 1 JOIN tt ON true) z)"""


@query("group_split", f"""WITH RECURSIVE {LI_SQL}, {SPLIT_SQL}
SELECT trip_id, CASE WHEN up THEN 'train' ELSE 'test' END AS side FROM wk WHERE trip_id IS NOT NULL""")
def group_split(spark, folder):
    return split.checked_split(split.group_split(li(spark, folder), "trip_id", "cls", FLAGS, ("A", "R"), 0.8))


FOLD_SQL = """tc AS (SELECT trip_id, [count(*) FILTER (cls = 'A')::DOUBLE, count(*) FILTER (cls = 'N')::DOUBLE, count(*) FILTER (cls = 'R')::DOUBLE] AS c FROM li GROUP BY trip_id),
od AS (SELECT *, row_number() OVER (ORDER BY round(sqrt((c[1]*c[1] + c[2]*c[2] + c[3]*c[3]) / 3 - pow((c[1] + c[2] + c[3]) / 3, 2)), 9) DESC, trip_id) AS i FROM tc),
tt AS (SELECT [sum(c[1]), sum(c[2]), sum(c[3])] AS t FROM tc),
st AS (SELECT 0::BIGINT AS i, [0.0::DOUBLE, 0, 0, 0] AS a, [0.0::DOUBLE, 0, 0, 0] AS b, [0.0::DOUBLE, 0, 0, 0] AS d, NULL::BIGINT AS trip_id, NULL::INTEGER AS fold
  UNION ALL
  SELECT z.i, list_transform(a, lambda x, k: x + CASE WHEN k - 1 = f THEN z.c[1] ELSE 0 END), list_transform(b, lambda x, k: x + CASE WHEN k - 1 = f THEN z.c[2] ELSE 0 END),
    list_transform(d, lambda x, k: x + CASE WHEN k - 1 = f THEN z.c[3] ELSE 0 END), z.trip_id, z.f FROM (
    SELECT od.i, od.c, od.trip_id, s.a, s.b, s.d, o.f::INTEGER AS f, row_number() OVER (ORDER BY
        round((list_stddev_pop(list_transform(s.a, lambda x, k: (x + CASE WHEN k - 1 = o.f THEN od.c[1] ELSE 0 END) / tt.t[1]))
             + list_stddev_pop(list_transform(s.b, lambda x, k: (x + CASE WHEN k - 1 = o.f THEN od.c[2] ELSE 0 END) / tt.t[2]))
             + list_stddev_pop(list_transform(s.d, lambda x, k: (x + CASE WHEN k - 1 = o.f THEN od.c[3] ELSE 0 END) / tt.t[3]))) / 3, 12),
        s.a[o.f + 1] + s.b[o.f + 1] + s.d[o.f + 1], o.f) AS rk
    FROM st s JOIN od ON od.i = s.i + 1 JOIN tt ON true JOIN (SELECT unnest([0, 1, 2, 3]) AS f) o ON true) z WHERE rk = 1)"""


@query("group_kfold", f"""WITH RECURSIVE {LI_SQL}, {FOLD_SQL} SELECT trip_id, fold FROM st WHERE trip_id IS NOT NULL""")
def group_kfold(spark, folder):
    return split.group_kfold(li(spark, folder), "trip_id", "cls", FLAGS, 4, tie=F.col("trip_id"))


@query("random_group_holdout", f"""WITH {LAB_SQL}, t AS (SELECT DISTINCT doc_id % 20 AS trip FROM lab), o AS (SELECT trip, row_number() OVER (ORDER BY (trip * 7919) % 10007, trip) AS i, count(*) OVER () AS n FROM t)
SELECT doc_id FROM lab WHERE doc_id % 20 IN (SELECT trip FROM o WHERE i <= ceil(0.2 * n)) AND NOT coalesce(CASE WHEN doc_id % 7 = 0 THEN 'augmented' END, 'original') LIKE 'augmented%'""")
def random_group_holdout(spark, folder):
    rows = lab(spark, folder).withColumn("trip", F.col("doc_id") % 20).withColumn("src", F.when(F.col("doc_id") % 7 == 0, "augmented"))
    held = split.group_holdout(rows, "trip", 0.2, (F.col("trip") * 7919) % 10007)
    return join_per_key(rows, held, ["trip"], ["doc_id"], "left_semi").where(~is_augmented(F.col("src"))).select("doc_id")


@query("balanced_weights", f"""WITH {LAB_SQL}, c AS (SELECT y3, count(*) AS m FROM lab GROUP BY y3), t AS (SELECT sum(m) AS n, count(*) AS k FROM c)
SELECT doc_id, y3, r6(n / (k * m)) AS weight FROM lab JOIN c USING (y3) JOIN t ON true""")
def balanced_weights(spark, folder):
    return rounded(split.balanced_weights(lab(spark, folder).select("doc_id", "y3"), "y3"), "weight")


@query("inject_missing", f"""WITH {LAB_SQL} SELECT doc_id, y3 FROM lab WHERE y3 <> 2 UNION ALL SELECT min(doc_id), 2 FROM lab WHERE y3 = 2""")
def inject_missing(spark, folder):
    pool = lab(spark, folder).select("doc_id", "y3")
    return split.inject_missing(pool.where("y3 <> 2"), pool, "y3", "doc_id")


@query("label_index", f"""WITH {SIG_SQL} SELECT event_id, (dense_rank() OVER (ORDER BY cls) - 1)::INTEGER AS label_idx, cls FROM sig""")
def label_index(spark, folder):
    out = split.label_index(sig(spark, folder).select("event_id", "cls"), "cls")
    return out.select("event_id", "label_idx", class_name(F.col("label_idx")).alias("cls"))


@query("zscore_global", f"""WITH {VEC_SQL}, u AS (SELECT unnest(x) AS e FROM vec WHERE trip_id < 15), s AS (SELECT avg(e) AS m, stddev_pop(e) AS d FROM u)
SELECT vec_id, pos, r6((e - m) / d) AS x FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS pos, unnest(x) AS e FROM vec) JOIN s ON true""")
def zscore_global(spark, folder):
    v = vec(spark, folder).select("vec_id", "trip_id", "x")
    out = split.apply_scaler(v, split.scaler(v.where("trip_id < 15"), ["x"]), ["x"])
    return rounded(out.select("vec_id", F.posexplode("x").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint")), "x")


@query("zscore_instance", f"""WITH {VEC_SQL}, s AS (SELECT vec_id, x, list_avg(x) AS m, list_stddev_pop(x) AS d FROM vec)
SELECT vec_id, pos, r6((e - m) / (d + 1e-8)) AS x FROM (SELECT vec_id, m, d, unnest(generate_series(0, 63)) AS pos, unnest(x) AS e FROM s)""")
def zscore_instance(spark, folder):
    out = vec(spark, folder).select("vec_id", F.posexplode(split.instance_scale(F.col("x"))).alias("pos", "x"))
    return rounded(out.withColumn("pos", F.col("pos").cast("bigint")), "x")


@query("model_rows", """SELECT event_id, (CASE WHEN event_type <> 'error' THEN value END) AS a, user_id FROM events WHERE event_type <> 'error'""")
def model_rows(spark, folder):
    e = read_table(spark, folder, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("a"))
    return split.model_rows(e, "user_id", ["event_id"]).select("event_id", "a", "user_id")


# Decisions and curves


@query("threshold_decision", f"""WITH {LAB_SQL} SELECT doc_id, CASE WHEN p[2] >= 0.3 AND p[3] >= 0.25 THEN CASE WHEN p[2] >= p[3] THEN 1 ELSE 2 END
  WHEN p[2] >= 0.3 THEN 1 WHEN p[3] >= 0.25 THEN 2 ELSE 0 END AS decided FROM lab""")
def threshold_decision(spark, folder):
    return lab(spark, folder).select("doc_id", evaluation.threshold_decision(F.col("p"), 0.3, 0.25).alias("decided"))


@query("priority_decision", f"""WITH {LAB_SQL} SELECT doc_id, CASE WHEN p[2] >= 0.4507 THEN 1 WHEN p[3] * 3 >= 0.7622 THEN 2 ELSE 0 END AS decided FROM lab""")
def priority_decision(spark, folder):
    p = F.array(F.col("p")[0], F.col("p")[1], F.col("p")[2] * 3)
    return lab(spark, folder).select("doc_id", evaluation.priority_decision(p).alias("decided"))


@query("ensemble", f"""WITH {LAB_SQL} SELECT doc_id, r6(0.3 * p[1] + 0.7 * p[3]) AS p0, r6(0.3 * p[2] + 0.7 * p[2]) AS p1, r6(0.3 * p[3] + 0.7 * p[1]) AS p2 FROM lab""")
def ensemble(spark, folder):
    p = F.col("p")
    out = evaluation.soft_vote(p, F.array(p[2], p[1], p[0]), 0.3)
    return lab(spark, folder).select("doc_id", *[r6(out[i]).alias(f"p{i}") for i in range(3)])


PR_SQL = """cc AS (SELECT quality AS grp, score AS threshold, count(*) FILTER (toxic = 1) AS pos, count(*) AS n FROM lab GROUP BY ALL),
cv AS (SELECT grp, threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY grp) AS total FROM cc WINDOW w AS (PARTITION BY grp ORDER BY threshold DESC)),
pr AS (SELECT grp, threshold, tp, called, tp / called AS precision, tp / total AS recall FROM cv),
st AS (SELECT *, recall - coalesce(lag(recall) OVER o, 0) AS w, coalesce(lag(precision) OVER o, 1) AS pp FROM pr WINDOW o AS (PARTITION BY grp ORDER BY threshold DESC))"""


@query("pr_curve", f"""WITH {LAB_SQL}, {PR_SQL} SELECT grp, threshold, tp::BIGINT AS tp, called::BIGINT AS called, r6(precision) AS precision, r6(recall) AS recall FROM pr""")
def pr_curve(spark, folder):
    rows = lab(spark, folder).withColumn("grp", F.col("quality"))
    return rounded(evaluation.pr_curve(rows, F.col("toxic") == 1, "score", ["grp"]), "precision", "recall")


@query("pr_auc", f"""WITH {LAB_SQL}, {PR_SQL} SELECT grp, r6(sum(w * (precision + pp) / 2)) AS pr_auc FROM st GROUP BY grp""")
def pr_auc(spark, folder):
    rows = lab(spark, folder).withColumn("grp", F.col("quality"))
    return rounded(evaluation.pr_areas(rows, F.col("toxic") == 1, "score", ["grp"]).select("grp", "pr_auc"), "pr_auc")


@query("average_precision", f"""WITH {LAB_SQL}, {PR_SQL} SELECT grp, r6(sum(w * precision)) AS average_precision FROM st GROUP BY grp""")
def average_precision(spark, folder):
    rows = lab(spark, folder).withColumn("grp", F.col("quality"))
    return rounded(evaluation.pr_areas(rows, F.col("toxic") == 1, "score", ["grp"]).select("grp", "average_precision"), "average_precision")


@query("cv_summary", f"""WITH {LAB_SQL}, x AS (SELECT doc_id % 4 AS fold, toxic, (score > 0.5)::INT AS pr, score FROM lab),
f AS (SELECT fold, coalesce(2 * count(*) FILTER (toxic = 1 AND pr = 1) / nullif(count(*) FILTER (toxic = 1) + count(*) FILTER (pr = 1), 0), 0) AS f1 FROM x GROUP BY fold HAVING count(*) FILTER (toxic = 1) > 0),
cc AS (SELECT fold, score, count(*) FILTER (toxic = 1) AS pos, count(*) AS n FROM x GROUP BY ALL),
cv AS (SELECT fold, score, sum(pos) OVER w / sum(n) OVER w AS p, sum(pos) OVER w / sum(pos) OVER (PARTITION BY fold) AS r FROM cc WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
st AS (SELECT fold, (r - coalesce(lag(r) OVER o, 0)) * (p + coalesce(lag(p) OVER o, 1)) / 2 AS a FROM cv WINDOW o AS (PARTITION BY fold ORDER BY score DESC)),
au AS (SELECT fold, sum(a) AS pr_auc FROM st GROUP BY fold)
SELECT count(*) AS folds, r6(avg(f1)) AS f1_mean, r6(stddev_pop(f1)) AS f1_std, r6(avg(pr_auc)) AS pr_auc_mean, r6(avg(f1) - stddev_pop(f1)) AS robust FROM f JOIN au USING (fold)""")
def cv_summary(spark, folder):
    rows = lab(spark, folder).select((F.col("doc_id") % 4).alias("fold"), "toxic", (F.col("score") > 0.5).cast("int").alias("pr"), "score")
    out = evaluation.cv_summary(evaluation.cv_folds(rows, "fold", "toxic", "pr", "score"))
    return rounded(out, "f1_mean", "f1_std", "pr_auc_mean", "robust")


@query("run_comparison", f"""WITH {LAB_SQL}, z AS (SELECT 'baseline' AS run, toxic, score FROM lab UNION ALL SELECT 'tuned', toxic, ((n_chars * 7) % 1000) / 1000.0 FROM lab),
cc AS (SELECT run, score, count(*) FILTER (toxic = 1) AS pos, count(*) AS n FROM z GROUP BY ALL),
cv AS (SELECT run, score, sum(pos) OVER w / sum(n) OVER w AS p, sum(pos) OVER w / sum(pos) OVER (PARTITION BY run) AS r FROM cc WINDOW w AS (PARTITION BY run ORDER BY score DESC)),
st AS (SELECT run, r - coalesce(lag(r) OVER o, 0) AS w, p, coalesce(lag(p) OVER o, 1) AS pp FROM cv WINDOW o AS (PARTITION BY run ORDER BY score DESC))
SELECT run, r6(sum(w * (p + pp) / 2)) AS pr_auc, r6(sum(w * p)) AS average_precision FROM st GROUP BY run""")
def run_comparison(spark, folder):
    a = lab(spark, folder)
    both = a.select(F.lit("baseline").alias("run"), "toxic", "score").unionByName(
        a.select(F.lit("tuned").alias("run"), "toxic", (((F.col("n_chars") * 7) % 1000) / 1000.0).alias("score")))
    return rounded(evaluation.run_comparison(both, "run", F.col("toxic") == 1, "score"), "pr_auc", "average_precision")


@query("hard_negatives", f"""WITH {LAB_SQL}, z AS (SELECT doc_id, list_max(p) AS confidence, (list_position(p, list_max(p)) - 1)::INTEGER AS pred_class, y3 FROM lab)
SELECT doc_id, pred_class, r6(confidence) AS confidence FROM z WHERE y3 = 0 AND pred_class > 0 AND confidence > 0.4""")
def hard_negatives(spark, folder):
    return rounded(evaluation.hard_negatives(lab(spark, folder), "y3", "p", 0.4).select("doc_id", "pred_class", "confidence"), "confidence")


OUT_SQL = """oc AS (SELECT *, CASE WHEN y3 = 1 AND pred = 1 THEN 'TP' WHEN y3 = 0 AND pred = 1 THEN 'FP' WHEN y3 = 1 AND pred <> 1 THEN 'FN' WHEN y3 = 0 AND pred = 0 THEN 'TN' END AS outcome FROM lab)"""


@query("error_audit", f"""WITH {LAB_SQL}, {OUT_SQL} SELECT outcome, count(*) AS n, r6(avg(p[2])) AS mean_p, r6(stddev_pop(p[2])) AS std_p, r6(min(p[2])) AS min_p, r6(max(p[2])) AS max_p,
  count(*) FILTER (p[2] < 0.3) AS borderline, count(*) FILTER (p[2] >= 0.3) AS confident FROM oc WHERE outcome IS NOT NULL GROUP BY outcome""")
def error_audit(spark, folder):
    rows = lab(spark, folder).withColumn("outcome", evaluation.outcome(F.col("y3"), F.col("pred")))
    return rounded(evaluation.error_summary(rows, "outcome", F.col("p")[1], 0.3), "mean_p", "std_p", "min_p", "max_p")


@query("precision_recall", f"""WITH {LAB_SQL}, {OUT_SQL}, n AS (SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM oc)
SELECT tp, fp, fn, r6(tp / (tp + fp + 1e-9)) AS precision, r6(tp / (tp + fn + 1e-9)) AS recall FROM n""")
def precision_recall(spark, folder):
    rows = lab(spark, folder).withColumn("outcome", evaluation.outcome(F.col("y3"), F.col("pred")))
    return rounded(evaluation.precision_recall(rows, "outcome"), "precision", "recall")


@query("calibration_check", f"""WITH {LAB_SQL}, h AS (SELECT p[2] AS q FROM lab WHERE y3 = 1 AND pred = 1)
SELECT count(*) AS n, r6(avg(q)) AS mean_p, r6(count(*) FILTER (q < 0.5) / count(*)) AS share_under_50, r6(count(*) FILTER (q < 0.3) / count(*)) AS share_under_30 FROM h""")
def calibration_check(spark, folder):
    return rounded(evaluation.calibration_check(lab(spark, folder), "y3", "pred", "p"), "mean_p", "share_under_50", "share_under_30")


@query("focal_loss", f"""WITH {LAB_SQL}, c AS (SELECT y3, greatest(p[y3 + 1], 1e-6) AS q FROM lab), w AS (SELECT -ln(q) AS ce, q, [0.5, 2.0, 4.0][y3 + 1] AS w FROM c)
SELECT r6(avg(ce)) AS log_loss, r6(sum(w * pow(1 - q, 2) * ce) / sum(w)) AS focal_loss FROM w""")
def focal_loss(spark, folder):
    rows = lab(spark, folder).withColumn("p", F.transform("p", lambda x: F.greatest(x, F.lit(1e-6))))
    return rounded(evaluation.focal_loss(rows, "y3", "p", 2.0, [0.5, 2.0, 4.0]), "log_loss", "focal_loss")


PERM_SQL = """pv AS (SELECT vec_id, x, cls AS y, row_number() OVER (ORDER BY vec_id) AS i, row_number() OVER (ORDER BY (vec_id * 7919) % 10007, vec_id) AS j FROM vec),
px AS (SELECT a.y, a.x AS c, b.x AS d, unnest(range(65)) AS k FROM pv a JOIN pv b ON a.i = b.j),
sc AS (SELECT k, y, list_transform(range(1, 65), lambda m: CASE WHEN m = k THEN d[m] ELSE c[m] END) AS c FROM px),
sm AS (SELECT k, y, list_sum(c[1:21]) AS s0, list_sum(c[22:42]) AS s1, list_sum(c[43:64]) AS s2 FROM sc),
pd AS (SELECT k, y, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred FROM sm),
ff AS (SELECT k, (2.0 * count(*) FILTER (y = 1 AND pred = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1))
   + 2.0 * count(*) FILTER (y = 2 AND pred = 2) / (count(*) FILTER (y = 2) + count(*) FILTER (pred = 2))) / 2 AS f1 FROM pd GROUP BY k)"""


@query("permutation_importance", f"""WITH {VEC_SQL}, {PERM_SQL} SELECT 'c' || (k - 1)::VARCHAR AS channel, r6(f1) AS new_f1, r6((SELECT f1 FROM ff WHERE k = 0) - f1) AS f1_drop FROM ff WHERE k > 0""")
def permutation_importance(spark, folder):
    """All 64 channels, one after the other, taken from another row."""
    names = [f"c{i}" for i in range(64)]
    rows = vec(spark, folder).select("vec_id", F.col("cls").alias("y"), *[F.col("x")[i].alias(c) for i, c in enumerate(names)])

    def predict(df):
        s = [sum((F.col(c) for c in names[a + 1:b]), F.col(names[a])) for a, b in ((0, 21), (21, 42), (42, 64))]
        df = df.withColumns({f"_s{i}": total for i, total in enumerate(s)})
        first = (F.col("_s0") >= F.col("_s1")) & (F.col("_s0") >= F.col("_s2"))
        return df.withColumn("pred", F.when(first, 0).when(F.col("_s1") >= F.col("_s2"), 1).otherwise(2))

    scores = evaluation.permutation_importance(rows, "vec_id", "y", names, predict, (F.col("vec_id") * 7919) % 10007)
    return rounded(evaluation.importance_drop(scores), "new_f1", "f1_drop")


@query("trip_anomaly", f"""WITH {SENSOR_SQL}, {STATS_SQL}, {NUM_SQL}, {welch_sql("v - 50")},
q AS (SELECT trip_id, k, avg(d) AS d FROM p GROUP BY trip_id, k),
bp AS (SELECT trip_id, avg(d) FILTER (k * 6.25 >= 2 AND k * 6.25 <= 15) AS power_low, avg(d) FILTER (k * 6.25 > 15 AND k * 6.25 <= 45) AS power_high FROM q GROUP BY trip_id),
al AS (SELECT * FROM st JOIN bp USING (trip_id)),
o AS (SELECT *, row_number() OVER (ORDER BY std, trip_id) - 1 AS i, count(*) OVER () AS n FROM al WHERE trip_id <> 7),
c AS (SELECT * FROM o WHERE i = n // 2), a AS (SELECT * FROM al WHERE trip_id = 7)
SELECT a.trip_id AS trip, c.trip_id AS control, {', '.join(f"r6(a.{m} / (c.{m} + 1e-9)) AS {m}_ratio" for m in ('std', 'max_abs', 'mean_speed', 'p95_abs', 'power_low', 'power_high'))},
  a.power_high / (c.power_high + 1e-9) > 3 AS loose_mount, a.std / (c.std + 1e-9) > 1.5 AS excess_std FROM a, c""")
def trip_anomaly(spark, folder):
    """Signal statistics and band powers of one trip against the control trip."""
    s = sensor(spark, folder)
    st = aggregates.signal_stats(s, "trip_id", "a_vertical", "speed")
    bands = welch_bands(s, sig_axis(s), "a_vertical", {"power_low": (2, 15, True), "power_high": (15, 45, False)}, 100.0, 16)
    out = aggregates.control_trip(st.join(bands, "trip_id"), "trip_id", 7)
    return rounded(out, *[c for c in out.columns if c.endswith("_ratio")])
