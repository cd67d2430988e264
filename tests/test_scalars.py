"""Scalar functions, scoring and label rules on crafted rows."""

import math

import pytest
from pyspark.sql import functions as F

from tripwave.functions import exprs
from tripwave.operators.labels import normalise_alias, suggest_labels
from tripwave.params import CLASSES


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


class TestHaversine:
    def test_same_point(self, spark):
        assert value(spark, exprs.haversine(*lits(-7, 110, -7, 110))) == 0

    def test_city_pair(self, spark):
        assert 115_000 < value(spark, exprs.haversine(*lits(-6.2088, 106.8456, -6.9175, 107.6191))) < 130_000

    def test_short_step(self, spark):
        assert value(spark, exprs.haversine(*lits(-7, 110, -7.00005, 110))) < 10

    def test_symmetric(self, spark):
        a = value(spark, exprs.haversine(*lits(-7, 110, -6.5, 110.2)))
        assert a == pytest.approx(value(spark, exprs.haversine(*lits(-6.5, 110.2, -7, 110))))

    def test_one_degree(self, spark):
        assert 110_000 < value(spark, exprs.haversine(*lits(0, 110, 1, 110))) < 112_000


class TestNormalise:
    @pytest.mark.parametrize("xs, want", [([1, 2, 3, 4, 5], [0, .25, .5, .75, 1]), ([4, 4], [0, 0]), ([7], [0]),
                                          ([10, 5, 20, 1], [9 / 19, 4 / 19, 1, 0])])
    def test_min_max(self, spark, xs, want):
        lo, hi = F.lit(float(min(xs))), F.lit(float(max(xs)))
        assert [value(spark, exprs.min_max(x, lo, hi)) for x in lits(*xs)] == pytest.approx(want)

    @pytest.mark.parametrize("x, want", [(3, 0), (5, .4), (8, 1), (-999, 0), (999, 1), (100, 1), (5.5, .5)])
    def test_robust(self, spark, x, want):
        assert value(spark, exprs.robust_normalise(F.lit(float(x)), 3, 8)) == pytest.approx(want)

    def test_robust_zero_range(self, spark):
        assert value(spark, exprs.robust_normalise(F.lit(5.0), 5, 5)) == 0

    def test_robust_keeps_null(self, spark):
        assert value(spark, exprs.robust_normalise(F.lit(None).cast("double"), 3, 8)) is None


SCHEMA = "peak_vertical_g double, peak_gyro_mag double, vert_jrk double, event_duration double, speed_mean double"


def score(spark, rows, schema=SCHEMA):
    return exprs.score_events(spark.createDataFrame(rows, schema))


class TestScoring:
    def test_empty_keeps_schema(self, spark):
        out = score(spark, [])
        assert out.count() == 0 and {"speed_factor", "score", "priority"} <= set(out.columns)

    def test_range(self, spark):
        rows = [(i / 10, i / 3, i * 20.0, i / 100, 8.0) for i in range(30)]
        assert all(0 <= r.score <= 1 for r in score(spark, rows).collect())

    def test_all_above_max(self, spark):
        r = score(spark, [(9.0, 9.0, 999.0, 9.0, 20.0)]).first()
        assert r.score == 1.0 and r.priority == "high"

    def test_minimal_is_low(self, spark):
        assert score(spark, [(1.01, 0.0, 0.0, 0.0, 20.0)]).first().priority == "low"

    def test_priority_follows_thresholds(self, spark):
        rows = [(1 + i / 20, i / 4, i * 15.0, i / 150, 9.0) for i in range(20)]
        for r in score(spark, rows).collect():
            assert r.priority == ("high" if r.score >= .5 else "medium" if r.score >= .3 else "low")

    def test_no_speed_column(self, spark):
        out = score(spark, [(1.2, 1.0, 1.0, 0.1)], SCHEMA.rsplit(",", 1)[0])
        assert out.first().speed_factor == 1.0

    def test_extra_column_kept(self, spark):
        out = exprs.score_events(spark.createDataFrame([(1.2, 1.0, 1.0, 0.1, 3.0, "x")], SCHEMA + ", note string"))
        assert out.first().note == "x"

    def test_monotone_in_acceleration(self, spark):
        a, b = score(spark, [(1.1, 0.0, 0.0, 0.0, 9.0), (1.7, 0.0, 0.0, 0.0, 9.0)]).collect()
        assert b.score > a.score

    def test_missing_parts_and_speed_factor(self, spark):
        rows = [(None, 1.0, 1.0, 0.1, 9.0), (1.2, 1.0, 1.0, 0.1, 0.0), (1.2, 1.0, 1.0, 0.1, 30 / 3.6)]
        a, b, c = score(spark, rows).collect()
        assert a.score is None and a.priority == "low"
        assert b.speed_factor == 1.5 and c.speed_factor == 1.0

    def test_nan_is_missing_after_cleaning(self, spark):
        rows = exprs.clean_nans(spark.createDataFrame([(math.nan, 1.0, 1.0, 0.1, 9.0)], SCHEMA))
        assert exprs.score_events(rows).first().priority == "low"


LEVELS = [(8.5, 0.0, "high_conf"), (0.0, 6.0, "high_conf"), (-1.4, 0.0, "candidate"), (0.0, 4.0, "candidate"), (1.0, 1.0, "normal"), (None, None, "normal")]


@pytest.mark.parametrize("g, w, want", LEVELS)
def test_level(spark, g, w, want):
    assert value(spark, exprs.severity_level(F.lit(g).cast("double"), F.lit(w).cast("double"))) == want


RULES = [
    (dict(peak_mag=50.0, gyro_pitch_roll_ratio=2.0, gyro_pitch_energy=41.0), "R10", "Speed Bump"),
    (dict(peak_mag=50.0), "R10", "Pothole"),
    (dict(num_peaks_gyro=3, asymmetry_score=0.7, peak_vertical_g=2.0), "R5", "Maneuver"),
    (dict(peak_vertical_g=-15.0, skewness=-0.6), "R1", "Pothole"),
    (dict(peak_vertical_g=12.0, gyro_pitch_roll_ratio=1.6), "R3", "Speed Bump"),
    (dict(peak_vertical_g=10.0, num_peaks_accel=3, local_duration=0.5), "R7", "Rough Road"),
    (dict(peak_vertical_g=2.0), "R6", "Normal"),
    (dict(peak_vertical_g=8.0), "R9", "Non-Event"),
    (dict(peak_vertical_g=8.0, num_peaks_gyro=4, gyro_energy=401.0), "R11", "Rough Road"),
    (dict(peak_vertical_g=2.0, num_peaks_gyro=4, gyro_energy=401.0), "R6", "Normal"),
    (dict(), "R9", "Non-Event"),
]


@pytest.mark.parametrize("row, rule, raw", RULES)
def test_rule(spark, row, rule, raw):
    df = spark.createDataFrame([(1,)], "event_id int")
    for k, v in row.items():
        df = df.withColumn(k, F.lit(v))
    got = suggest_labels(df).first()
    assert (got.suggestion_rule, got.suggested_raw_label) == (rule, raw)
    assert got.suggested_label in CLASSES


@pytest.mark.parametrize("p, rule, review", [(0.9, "ML_Ensemble(RF)", False), (0.7, "ML_Ensemble(RF)", True), (0.5, "ML_Ensemble(RF)_LOW_CONF", True)])
def test_model_shortcut(spark, p, rule, review):
    df = spark.createDataFrame([(8.0,)], "peak_vertical_g double")
    proba = F.array(*lits((1 - p) / 2, p, (1 - p) / 2))
    got = suggest_labels(df, proba).first()
    assert (got.suggestion_rule, got.needs_review, got.suggested_label) == (rule, review, "Pothole")


def test_alias(spark):
    assert value(spark, normalise_alias(F.lit(" Lubang "))) == "Pothole"
    assert value(spark, normalise_alias(F.lit("whatever"))) is None


def test_relative_text(spark):
    assert value(spark, exprs.minute_second_text(F.lit(125.7))) == "2 menit 5 detik"
    assert value(spark, exprs.minute_second_text(F.lit(-3.0))) == "0 menit 0 detik"
