"""Label taxonomy, aliases, and the rule and model suggestions for candidate events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripwave.params import CLASSES

# Raw diagnostic label -> class.
RAW_TO_CLASS = {
    "Non-Event": "Non-Event",
    "Pothole": "Pothole",
    "Speed Bump": "Speed Bump",
    "Maneuver": "Non-Event",
    "Rough Road": "Non-Event",
    "Normal": "Non-Event",
    "Crack": "Non-Event",
}

# Label spellings, English and Indonesian.
NON_EVENT_ALIASES = (
    "non-event", "non event", "nonevent", "normal", "jalan mulus", "mulus", "bukan lubang",
    "non-anomaly", "non anomaly", "none", "no anomaly", "bukan anomali", "maneuver", "rough road",
    "crack", "jalan rusak", "jembatan", "severe anomaly",
)
POTHOLE_ALIASES = ("pothole", "lubang", "hole")
SPEED_BUMP_ALIASES = ("speed bump", "polisi tidur", "bump", "speedbump", "speed_bump")

# Inputs of the suggestion model.
SUGGESTION_FEATURES = (
    "peak_mag", "peak_vertical_g", "peak_gyro_mag", "speed_mean", "event_duration", "vert_jrk",
    "num_peaks_accel", "num_peaks_gyro", "peak_interval_mean", "peak_interval_std", "asymmetry_score",
    "vertical_energy", "gyro_energy", "accel_to_gyro_ratio", "local_duration", "top2_peak_ratio",
    "duration_above_threshold", "max_jerk", "peak_to_peak", "fft_high_low_ratio", "zcr", "kurtosis",
    "skewness", "gyro_pitch_energy", "gyro_roll_energy", "gyro_yaw_energy", "gyro_pitch_roll_ratio",
    "energy_psd_2_10", "speed_vert_interaction", "speed_normalized_p2p",
)

SUGGESTION_COLUMNS = ("suggested_label", "suggested_raw_label", "suggested_kind", "suggestion_confidence",
                      "suggestion_rule", "suggestion_reason", "needs_review")


def taxonomy(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RAW_TO_CLASS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.coalesce(raw, F.lit(""))), F.lit("Non-Event"))


def normalise_alias(label: Column) -> Column:
    """Class of a free-text label; unknown text is NULL."""
    text = F.lower(F.trim(label))
    return (F.when(text.isin(*NON_EVENT_ALIASES), CLASSES[0]).when(text.isin(*POTHOLE_ALIASES), CLASSES[1])
            .when(text.isin(*SPEED_BUMP_ALIASES), CLASSES[2]))


def _answer(raw: Column | str, kind: Column | str, confidence: Column | float, rule: Column | str,
            reason: Column | str, review: Column | bool) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        taxonomy(lit(raw)).alias("suggested_label"), lit(raw).alias("suggested_raw_label"),
        lit(kind).alias("suggested_kind"), lit(confidence).cast("double").alias("suggestion_confidence"),
        lit(rule).alias("suggestion_rule"), lit(reason).alias("suggestion_reason"), lit(review).alias("needs_review"))


def mean_probability(votes: list[Column]) -> Column:
    total = votes[0]
    for v in votes[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(votes))


def suggestion(columns: set[str], proba: Column | None = None, model: str = "RF") -> Column:
    """Struct of the suggestion columns: a confident model first, then the rules, then the unsure model.

    ``columns`` names the available inputs; a missing or NULL input takes its default.
    ``proba`` is a class-probability array in class order, NULL where no model spoke.
    """

    def value(name: str, default: float | None = None) -> Column:
        c = F.col(name).cast("double") if name in columns else F.lit(None).cast("double")
        return c if default is None else F.coalesce(c, F.lit(default))

    def true(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    a, asym, dur = F.abs(value("peak_vertical_g")), value("asymmetry_score"), value("local_duration")
    npa, npg = value("num_peaks_accel", 0).cast("int"), value("num_peaks_gyro", 0).cast("int")
    fft, mag, skew = value("fft_high_low_ratio", 0), value("peak_mag", 0), value("skewness", 0)
    pitch, pr = value("gyro_pitch_energy", 0), value("gyro_pitch_roll_ratio", 0)
    bump = (pr > 1.8) & (pitch > 40)
    shock = F.when(bump, F.format_string("Extreme shock (%.1f m/s²) + High Pitch/Roll Ratio (%.1f) → Speed Bump", mag, pr)
                   ).otherwise(F.format_string("Extreme shock (%.1f m/s²) + Low Pitch/Roll Ratio (%.1f) → Pothole", mag, pr))
    impulse = F.format_string("impulse tajam + FFT High (%.1f) + Skewness (%.2f) → Pothole", fft, skew)
    low_freq = F.format_string("low frequency energy (FFT < 5) + Pitch Dominant (P/R Ratio: %.1f)", pr)
    gravel = F.format_string("Repetitive gyro peaks (%d) + high energy → Likely Gravel/Rough Road", npg)

    # Rule order, thresholds, confidences and texts.
    rules = [
        (mag >= 45, _answer(F.when(bump, "Speed Bump").otherwise("Pothole"), "event", 0.98, "R10", shock, False)),
        ((npg >= 3) & (asym > 0.60) & (a < 12),
         _answer("Maneuver", "condition_like", 0.88, "R5",
                 "gyro dominan + asimetri tinggi + low accel → maneuver (Non-Event)", False)),
        ((a >= 15) & ((fft >= 10.0) | (skew < -0.5)), _answer("Pothole", "event", 0.95, "R1", impulse, False)),
        ((a >= 12) & (fft < 5.0) & (pr > 1.5), _answer("Speed Bump", "event", 0.92, "R3", low_freq, False)),
        ((a >= 10) & (npa >= 3) & (dur > 0.4),
         _answer("Rough Road", "condition_like", 0.75, "R7",
                 "struktur kontinu panjang + low-mid magnitude → Rough Road (Non-Event)", True)),
        ((a < 6) & (npa <= 1),
         _answer("Normal", "condition_like", 0.92, "R6", "amplitudo rendah + tidak ada struktur event → Non-Event", False)),
    ]
    rough = (_answer("Rough Road", "condition_like", 0.90, "R11", gravel, False))
    is_rough = true((npg >= 4) & (value("gyro_energy", 0) > 400))
    fallback = F.when(is_rough, rough).otherwise(_answer("Non-Event", "ambiguous", 0.40, "R9", "fallback", True))

    if proba is not None:
        best = F.array_max(proba)
        name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position(proba, best).cast("int"))
        kind = F.when(name.isin("Pothole", "Speed Bump"), "event").otherwise("condition_like")
        percent = F.round(best * 100).cast("int")
        sure = _answer(name, kind, best, f"ML_Ensemble({model})",
                       F.format_string("Dipelajari dari data (Confidence: %d%%)", percent), best < 0.80)
        unsure = _answer(name, kind, best, f"ML_Ensemble({model})_LOW_CONF",
                         F.format_string("ML ragu-ragu (Conf: %d%%), pakai tebakan terbaik ML", percent), True)
        rules.insert(0, (best >= 0.65, sure))
        rules.append((proba.isNotNull(), unsure))

    chain = F.when(true(rules[0][0]), rules[0][1])
    for cond, answer in rules[1:]:
        chain = chain.when(true(cond), answer)
    return chain.otherwise(fallback)


def suggest_labels(events: DataFrame, proba: Column | None = None, model: str = "RF") -> DataFrame:
    """Adds the seven suggestion columns; existing labels are never touched."""
    out = events.withColumn("_s", suggestion(set(events.columns), proba, model))
    return out.select(*events.columns, *[F.col(f"_s.{c}").alias(c) for c in SUGGESTION_COLUMNS])
