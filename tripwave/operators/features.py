"""The 47 shape features of an event window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tripwave.functions.exprs import bind, clip, ratio
from tripwave.operators.ordered import Axis, previous
from tripwave.operators.timeseries import ema_window
from tripwave.operators.windows import range_join
from tripwave.params import EventWindow

# Columns that are part of the schema and always zero.
CONSTANT_FEATURES = (
    "num_peaks_accel", "num_peaks_gyro", "peak_interval_mean", "peak_interval_std",
    "top2_peak_ratio", "fft_high_low_ratio", "energy_psd_2_10",
)

# The computed features.
COMPUTED_FEATURES = (
    "asymmetry_score", "vertical_energy", "gyro_energy", "accel_to_gyro_ratio", "local_duration",
    "duration_above_threshold", "max_jerk", "peak_to_peak", "zcr", "kurtosis", "skewness",
    "gyro_pitch_energy", "gyro_roll_energy", "gyro_yaw_energy", "gyro_pitch_roll_ratio",
    "speed_vert_interaction", "speed_normalized_p2p", "horizontal_to_vertical_ratio",
    "grav_y_std", "grav_z_std", "linear_jerk_3d_max", "snr_vertical", "crest_factor",
    "hjorth_activity", "hjorth_mobility", "hjorth_complexity", "corr_xy", "corr_xz", "corr_yz",
    "impulse_factor", "clearance_factor", "shape_factor", "time_center_of_mass",
    "min_z_to_max_z_ratio", "first_peak_polarity", "rise_time_ratio", "peak_asymmetry",
    "waveform_complexity", "brake_to_bump_ratio", "down_up_asymmetry",
)

EVENT_FEATURES = CONSTANT_FEATURES + COMPUTED_FEATURES

SAMPLE_COLUMNS = ("a_vertical", "a_horizontal", "gx", "gy", "gz", "speed",
                  "lin_ax", "lin_ay", "lin_az", "grav_y", "grav_z")


def _sq(c: Column) -> Column:
    return c * c


def with_missing(samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sensor columns that a recording does not have, as zeros."""
    return samples.withColumns({c: F.lit(0.0) for c in columns if c not in samples.columns})


def level_prefix(value: Column, row: WindowSpec) -> Column:
    """``value`` while all rows so far have the first one's, but for rounding; else NULL."""
    first = F.first(value).over(row)
    gap = F.greatest(F.abs(F.max(value).over(row) - first), F.abs(F.min(value).over(row) - first))
    return F.when(gap <= F.abs(first) * 1e-12, value)


def above_step_by_step(level: Column, p: EventWindow) -> Column:
    """Whether the last of the level values from a window's start exceeds its threshold, averaged one step after the other.

    There value and threshold differ by what each step rounds, which the running sums of ``ema_window`` do not repeat.
    """
    a, keep = F.lit(p.ema_alpha), F.lit(1.0 - p.ema_alpha)
    start = F.struct(level[0].alias("base"), F.lit(0.0).alias("dev"))

    def step(acc: Column, x: Column) -> Column:
        base = a * x + keep * acc["base"]
        return F.struct(base.alias("base"), (a * F.abs(x - base) + keep * acc["dev"]).alias("dev"))

    end = F.aggregate(F.slice(level, 2, F.size(level)), start, step)
    return bind(end, lambda e: F.element_at(level, -1) > e["base"] + p.ema_multiplier * e["dev"])


def event_rows(samples: DataFrame, events: DataFrame, ax: Axis, event: str, at: str, p: EventWindow) -> DataFrame:
    """Window rows of each event with in-window differences, peak position, thresholds and background energy.

    Differences are taken once per sample before the join; a difference counts
    only if both rows are inside the window. An event's rows are bounded by the
    window length, so the per-event windows below stay small.
    """
    key, ts = ax.keys[0], ax.order[0]
    samples = with_missing(samples, SAMPLE_COLUMNS)
    linked = previous(samples.select(key, *ax.order, *SAMPLE_COLUMNS), ax,
                      {"_pts": ts, "_pv": "a_vertical", "_px": "lin_ax", "_py": "lin_ay", "_pz": "lin_az"}, steps=2)
    pairs = range_join(linked, events.select(key, event, at), key, ts, at, max(p.half, p.context_from), p.half)
    each = Window.partitionBy(key, event)
    inside = F.col(ts) >= F.col(at) - p.half
    context = (F.col(ts) >= F.col(at) - p.context_from) & (F.col(ts) < F.col(at) - p.context_to)
    v = F.col("a_vertical")
    pairs = pairs.withColumn("_bg_n", F.count(F.when(context, 1)).over(each))
    pairs = pairs.withColumn("_bg_e", F.sum(F.when(context, _sq(v))).over(each))
    rows = pairs.where(inside)
    row = each.orderBy(*ax.order)
    start = F.col(at) - p.half
    rows = rows.withColumn("_i", F.row_number().over(row) - 1).withColumn("_n", F.count(F.lit(1)).over(each))
    rows = rows.withColumn("_one", F.coalesce(F.col("_pts") >= start, F.lit(False)))
    rows = rows.withColumn("_two", F.col("_one") & F.coalesce(F.col("_pts_2") >= start, F.lit(False)))
    step = F.when(F.col("_one") & (F.col(ts) > F.col("_pts")), (F.col(ts) - F.col("_pts")) / p.per_second)
    rows = rows.withColumn("_dt", F.median(step).over(each))
    strongest = F.struct(F.abs(v), -F.col("_i"))
    rows = rows.withColumn("_p", F.max_by("_i", strongest).over(each))
    rows = rows.withColumn("_tp", F.max_by(ts, strongest).over(each))
    rows = rows.withColumn("_fs", F.coalesce(1.0 / F.col("_dt"), F.lit(100.0)))
    rows = rows.withColumn("_smooth", F.avg(F.abs(v)).over(row.rowsBetween(-(p.smooth_rows - 1), 0)))
    rows = ema_window(rows, [key, event], "_i", "_smooth", p.ema_alpha, "_base")
    rows = rows.withColumn("_off", F.abs(F.col("_smooth") - F.col("_base")))
    rows = ema_window(rows, [key, event], "_i", "_off", p.ema_alpha, "_limit")
    rows = rows.withColumn("_level", level_prefix(F.col("_smooth"), row))
    rows = rows.withColumn("_level", F.collect_list("_level").over(row))
    rows = rows.withColumn("_above", F.when(F.size("_level") > F.col("_i"), above_step_by_step(F.col("_level"), p)).otherwise(
        F.col("_smooth") > F.col("_base") + p.ema_multiplier * F.col("_limit"))).drop("_limit", "_level")
    nth = F.row_number().over(Window.partitionBy(key, event, "_above").orderBy(*ax.order))
    rows = rows.withColumn("_run", F.col("_i") - nth)
    run = Window.partitionBy(key, event, "_above", "_run")
    rows = rows.withColumn("_rs", F.min("_i").over(run)).withColumn("_re", F.max("_i").over(run) + 1)
    return rows


def shape_features(rows: DataFrame, key: str, event: str, ts: str, p: EventWindow, compat_snr: bool = False) -> DataFrame:
    """Aggregates ``event_rows`` to one feature row per event."""
    v, i, n = F.col("a_vertical"), F.col("_i"), F.col("_n")
    gx, gy, gz = [F.coalesce(c, F.lit(0.0)) for c in ("gx", "gy", "gz")]
    one, two = F.col("_one"), F.col("_two")
    d1 = F.when(one, v - F.col("_pv"))
    d2 = F.when(two, v - 2 * F.col("_pv") + F.col("_pv_2"))
    rel = F.col(ts) - F.col("_tp")
    left = (rel >= -p.narrow) & (rel < 0)
    right = (rel >= 0) & (rel <= p.narrow)
    min_dist = F.greatest(F.lit(1), F.floor(0.15 * F.col("_fs")))
    rs, re, pk = F.col("_rs"), F.col("_re"), F.col("_p")
    near = ((rs <= pk) & (pk <= re)) | (F.abs(rs - pk) < min_dist) | (F.abs(re - pk) < min_dist)
    jerk3d = F.sqrt(_sq(F.col("lin_ax") - F.col("_px")) + _sq(F.col("lin_ay") - F.col("_py"))
                    + _sq(F.col("lin_az") - F.col("_pz")))
    above = F.col("_above")

    agg = rows.groupBy(key, event).agg(
        F.max("_n").alias("n"), F.max("_p").alias("pk"), F.max("_fs").alias("fs"),
        F.max("_bg_n").alias("bg_n"), F.max("_bg_e").alias("bg_e"),
        F.sum(_sq(v)).alias("ve"), F.sum(F.abs(v)).alias("va"), F.sum(F.sqrt(F.abs(v))).alias("vr"),
        F.max(F.abs(v)).alias("vmax"), F.max(v).alias("hi"), F.min(v).alias("lo"),
        F.coalesce(F.sum(F.when(left, _sq(v))), F.lit(0.0)).alias("el"),
        F.coalesce(F.sum(F.when(right, _sq(v))), F.lit(0.0)).alias("er"),
        F.coalesce(F.sum(F.when(i < F.col("_p"), _sq(v))), F.lit(0.0)).alias("eb"),
        F.coalesce(F.sum(F.when(i > F.col("_p"), _sq(v))), F.lit(0.0)).alias("ea"),
        F.coalesce(F.sum(F.when(v < 0, _sq(v))), F.lit(0.0)).alias("ed"),
        F.coalesce(F.sum(F.when(v > 0, _sq(v))), F.lit(0.0)).alias("eu"),
        F.sum(_sq(gx)).alias("gxe"), F.sum(_sq(gy)).alias("gye"), F.sum(_sq(gz)).alias("gze"),
        F.max(F.when(above & near, re - rs)).alias("run_near"), F.max(F.when(above, re - rs)).alias("run_any"),
        F.max(F.abs(d1)).alias("dmax"), F.sum(F.abs(d1)).alias("dsum"),
        F.count_if(one & (F.signum(v) != F.signum("_pv"))).alias("crossings"),
        F.kurtosis(v).alias("kurt"),
        F.count(F.when(left | right, 1)).alias("n_narrow"), F.skewness(F.when(left | right, v)).alias("skew"),
        F.avg("speed").alias("speed"), F.sum(_sq(F.col("a_horizontal"))).alias("he"),
        F.stddev_samp("grav_y").alias("grav_y_std"), F.stddev_samp("grav_z").alias("grav_z_std"),
        F.max(F.when(one, jerk3d)).alias("j3"),
        F.sum(rel / p.per_second * F.abs(v)).alias("moment"),
        F.min_by("_i", F.struct(v, i)).alias("i_lo"), F.max_by("_i", F.struct(v, -i)).alias("i_hi"),
        F.var_pop(v).alias("var0"), F.var_pop(d1).alias("var1"), F.var_pop(d2).alias("var2"),
        *[F.covar_pop(f"lin_a{a}", f"lin_a{b}").alias(f"c{a}{b}") for a, b in ("xy", "xz", "yz")],
        *[F.stddev_pop(f"lin_a{a}").alias(f"s{a}") for a in "xyz"],
        F.min_by(v, i).alias("v_first"), F.max_by(v, i).alias("v_last"),
        F.sum(_sq(F.col("lin_az"))).alias("brake"),
        ((F.max(ts) - F.min(ts)) / p.per_second).alias("local_duration"),
    )
    c = F.col
    eps = 1e-6
    rms = F.sqrt(c("ve") / c("n"))
    gyro = c("gxe") + c("gye") + c("gze")
    mean_abs = c("va") / c("n")
    mobility = F.sqrt(F.try_divide(c("var1"), c("var0")))
    snr = F.lit(1.0) if compat_snr else F.when(
        (c("bg_n") > 10) & (c("n") > 5), (c("ve") / c("n")) / (F.try_divide(c("bg_e"), c("bg_n")) + eps)).otherwise(1.0)

    def when(cond: Column, value: Column, other: float = 0.0) -> Column:
        return F.when(cond, value).otherwise(F.lit(other))

    def corr(a: str, b: str) -> Column:
        return when(c("n") > 5, ratio(c(f"c{a}{b}"), c(f"s{a}") * c(f"s{b}")))

    computed = {
        "asymmetry_score": F.abs(c("el") - c("er")) / (c("el") + c("er") + eps),
        "vertical_energy": c("ve"),
        "gyro_energy": gyro,
        "accel_to_gyro_ratio": c("ve") / (gyro + eps),
        "local_duration": c("local_duration"),
        "duration_above_threshold": F.coalesce(F.coalesce("run_near", "run_any") / c("fs"), F.lit(0.0)),
        "max_jerk": F.coalesce(c("dmax") * c("fs"), F.lit(0.0)),
        "peak_to_peak": c("hi") - c("lo"),
        "zcr": c("crossings") / c("n"),
        "kurtosis": when(c("n") >= 4, c("kurt")),
        "skewness": when(c("n_narrow") >= 4, c("skew")),
        "gyro_pitch_energy": c("gxe"),
        "gyro_roll_energy": c("gze"),
        "gyro_yaw_energy": c("gye"),
        "gyro_pitch_roll_ratio": c("gxe") / (c("gze") + eps),
        "speed_vert_interaction": c("ve") * c("speed"),
        "speed_normalized_p2p": (c("hi") - c("lo")) / (c("speed") + 1.0),
        "horizontal_to_vertical_ratio": c("he") / (c("ve") + eps),
        "grav_y_std": c("grav_y_std"),
        "grav_z_std": c("grav_z_std"),
        "linear_jerk_3d_max": F.coalesce(c("j3") * c("fs"), F.lit(0.0)),
        "snr_vertical": snr,
        "crest_factor": c("vmax") / (rms + eps),
        "hjorth_activity": when(c("n") > 2, c("var0")),
        "hjorth_mobility": when((c("n") > 2) & (c("var0") > 0), mobility),
        "hjorth_complexity": when((c("n") > 2) & (c("var0") > 0) & (c("var1") > 0),
                                  F.sqrt(F.try_divide(c("var2"), c("var1"))) / mobility),
        "corr_xy": corr("x", "y"),
        "corr_xz": corr("x", "z"),
        "corr_yz": corr("y", "z"),
        "impulse_factor": c("vmax") / (mean_abs + eps),
        "clearance_factor": c("vmax") / (_sq(c("vr") / c("n")) + eps),
        "shape_factor": rms / (mean_abs + eps),
        "time_center_of_mass": ratio(c("moment"), c("va")),
        "min_z_to_max_z_ratio": when(c("hi") > 0, clip(c("lo") / (c("hi") + eps), -10, 10)),
        "first_peak_polarity": when(c("i_lo") < c("i_hi"), F.lit(1.0), -1.0),
        "rise_time_ratio": when(c("n") > 5, clip(c("pk") / (c("n") - 1 - c("pk") + eps), 0, 50)),
        "peak_asymmetry": when(c("n") > 5, (c("ea") - c("eb")) / (c("ea") + c("eb") + eps)),
        "waveform_complexity": when(c("n") > 2, clip(c("dsum") / (F.abs(c("v_last") - c("v_first")) + eps), 0, 100)),
        "brake_to_bump_ratio": when(c("ve") > 0, clip(c("brake") / (c("ve") + eps), 0, 100)),
        "down_up_asymmetry": clip(c("ed") / (c("eu") + eps), 0, 100),
    }
    return agg.select(key, event, c("n").alias("window_rows"), *[computed[f].alias(f) for f in COMPUTED_FEATURES])


def event_features(samples: DataFrame, events: DataFrame, ax: Axis, event: str = "event_id", at: str = "at",
                   p: EventWindow = EventWindow(), compat_snr: bool = False) -> DataFrame:
    """All 47 features per event; an event without rows gets zeros."""
    key, ts = ax.keys[0], ax.order[0]
    rows = event_rows(samples, events, ax, event, at, p)
    found = shape_features(rows, key, event, ts, p, compat_snr)
    full = events.join(found, [key, event], "left")
    empty = F.col("window_rows").isNull()
    return full.select(
        *events.columns, *[F.lit(0.0).alias(f) for f in CONSTANT_FEATURES],
        *[F.when(empty, F.lit(0.0)).otherwise(F.col(f)).alias(f) for f in COMPUTED_FEATURES])
