"""Column expressions. NULL is the only missing value: sources turn NaN into NULL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripwave.params import CLASSES, EARTH_RADIUS_M, G_TO_MS2, Scoring, Severity


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_nans(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column, so comparisons and averages skip it."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def holds(predicate: Column) -> Column:
    """Three-valued predicate to boolean: unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))


def ratio(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(zero)) if zero is not None else F.try_divide(num, den)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def magnitude(*axes: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [a * a for a in axes]))


def gyro_magnitude(*axes: Column) -> Column:
    return magnitude(*[F.coalesce(a, F.lit(0.0)) for a in axes])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_phi = F.sin(F.radians(lat2 - lat1) / 2)
    half_lam = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_phi * half_phi + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lam * half_lam
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def robust_normalise(c: Column, lo: float, hi: float) -> Column:
    if hi - lo < 1e-12:
        return F.when(c.isNotNull(), F.lit(0.0))
    return (clip(c, lo, hi) - lo) / (hi - lo)


def min_max(c: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo < 1e-12, F.lit(0.0)).otherwise(ratio(c - lo, hi - lo))


def gravity_projection(lin: tuple[Column, Column, Column], grav: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Raw (vertical, horizontal) acceleration from linear acceleration and gravity."""
    norm = magnitude(*grav)
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    vertical = reduce(lambda a, b: a + b, [a * (g / norm) for a, g in zip(lin, grav)])
    energy = reduce(lambda a, b: a + b, [a * a for a in lin])
    return vertical, F.sqrt(F.greatest(F.lit(0.0), energy - vertical * vertical))


def to_g(c: Column) -> Column:
    return c / F.lit(G_TO_MS2)


def severity_level(vertical_g: Column, gyro: Column, p: Severity = Severity()) -> Column:
    def reaches(g: float, w: float) -> Column:
        return holds(F.abs(vertical_g) >= g) | holds(gyro >= w)

    return (
        F.when(reaches(p.high_g, p.high_gyro), "high_conf")
        .when(reaches(p.candidate_g, p.candidate_gyro), "candidate")
        .otherwise("normal")
    )


def speed_factor(speed: Column | None) -> Column:
    """Boost below 30 km/h; without a speed column the factor is 1."""
    if speed is None:
        return F.lit(1.0)
    kph = speed * 3.6
    return F.when(holds(kph < 30.0), 1.0 + 0.5 * F.exp(-kph / 10.0)).otherwise(F.lit(1.0))


def composite_score(vertical_g: Column, gyro: Column, jerk: Column, duration: Column, factor: Column,
                    p: Scoring = Scoring()) -> Column:
    base = (
        p.w_accel * robust_normalise(F.abs(vertical_g), p.accel_min_g, p.accel_max_g)
        + p.w_gyro * robust_normalise(gyro, 0.0, p.gyro_max)
        + p.w_jerk * robust_normalise(jerk, 0.0, p.jerk_max)
        + p.w_duration * robust_normalise(duration, 0.0, p.duration_max_s)
    )
    return clip(base * factor, 0.0, 1.0)


def priority(score: Column, p: Scoring = Scoring()) -> Column:
    return F.when(holds(score >= p.high), "high").when(holds(score >= p.medium), "medium").otherwise("low")


def score_events(events: DataFrame, p: Scoring = Scoring()) -> DataFrame:
    """Adds speed_factor, score and priority to candidate events."""
    speed = F.col("speed_mean") if "speed_mean" in events.columns else None
    return (
        events.withColumn("speed_factor", speed_factor(speed))
        .withColumn("score", composite_score(F.col("peak_vertical_g"), F.col("peak_gyro_mag"), F.col("vert_jrk"),
                                             F.col("event_duration"), F.col("speed_factor"), p))
        .withColumn("priority", priority(F.col("score"), p))
    )


def speed_bucket(speed: Column, p: Scoring = Scoring()) -> Column:
    return (F.when(speed < p.speed_low, "low").when(speed < p.speed_high, "mid")
            .when(speed >= p.speed_high, "high"))


def unit_check(max_magnitude: Column) -> Column:
    """Plausibility of a trip's peak magnitude in m/s^2."""
    return F.when(max_magnitude < 2.0, "too_small").when(max_magnitude > 500.0, "too_large").otherwise("ok")


def map_link(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps?q="), lat.cast("string"), F.lit(","), lon.cast("string"))


def short_id(trip_id: Column) -> Column:
    return F.substring_index(trip_id, "-", 1)


def label_path(folder: str, trip_id: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), short_id(trip_id), F.lit("_labels.json"))


def local_time(ts_ms: Column, offset_hours: int = 7) -> Column:
    return F.timestamp_millis(ts_ms + offset_hours * 3_600_000)


def minute_second_text(seconds: Column) -> Column:
    """Trip-relative time as Indonesian text, floored at zero."""
    s = F.greatest(F.lit(0), F.floor(seconds).cast("bigint"))
    return F.format_string("%d menit %d detik", F.floor(s / 60).cast("bigint"), s % 60)


def guarded_start(data_start_s: Column, meta_start_s: Column) -> Column:
    """Metadata start time, unless it is on another time base (a year or more apart)."""
    return F.when(holds(F.abs(data_start_s - meta_start_s) < 86400 * 365), meta_start_s).otherwise(data_start_s)


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def is_augmented(source: Column) -> Column:
    return F.coalesce(source, F.lit("original")).startswith("augmented")


def skip_reason(max_gap_s: Column, to_start_s: Column, to_end_s: Column) -> Column:
    return (F.when(holds(max_gap_s > 0.5), "gap_buffer")
            .when(holds(to_start_s < 1.0) | holds(to_end_s < 1.0), "extract_failed")
            .otherwise("short_segment"))


def best_class(proba: Column) -> Column:
    """Zero-based index of the first largest probability."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row; a plain column would be evaluated again inside every lambda."""
    return F.transform(F.array(value), body)[0]


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    shifted = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bind(shifted, lambda e: bind(array_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def class_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), index + 1)
