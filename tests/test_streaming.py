"""Streams over several micro-batches give what the batch operators give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwave.functions.exprs import gravity_projection
from tripwave.operators import fusion, peaks, windows
from tripwave.operators.ordered import Axis
from tripwave.params import Clustering, Detection
from tripwave.streaming import streams
from trips_fixture import T0, trip

PARTS = 5


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    a = trip(40, "aa-1", potholes=(10, 25), bumps=(32,))
    b = trip(40, "bb-2", potholes=(12, 30), seed=8)
    end = pd.concat([trip(1, "zz-9", t0=T0 + 400_000, seed=2)])  # moves the watermark past both trips
    df = pd.concat([a, b, end]).assign(magnitude=lambda d: np.sqrt(d.ax ** 2 + d.ay ** 2 + d.az ** 2), a_vertical=lambda d: d.lin_ay,
                                       sig=lambda d: d.lin_ay.abs(), gyro=0.0)
    sdf = spark.createDataFrame(df).withColumn("at", F.timestamp_millis("ts_ms"))
    folder = str(tmp_path_factory.mktemp("live") / "files")
    for i in range(PARTS):
        lo, hi = T0 - 100 + i * 8_000, T0 - 100 + (i + 1) * 8_000
        last = i == PARTS - 1
        sdf.where((F.col("ts_ms") >= lo) & ((F.col("ts_ms") < hi) | F.lit(last))).coalesce(1).write.mode("append").parquet(folder)
    return sdf.cache(), folder


def live(spark, samples):
    return streams.ingest(spark, samples[1], samples[0].schema, 1)


def test_filters(spark, samples):
    got = streams.drain(streams.causal_filters(live(spark, samples), "trip_id", ["ts_ms"], "lin_ay"), "f").toPandas()
    want = fusion.causal_filters(samples[0], Axis(chunk_len=3_000), {"bandpass": "lin_ay"}, {"lowpass": "lin_ay"}, block_rows=900).toPandas()
    both = got.merge(want, on=["trip_id", "ts_ms"], suffixes=("", "_w"))
    assert len(both) == len(want) == len(got)
    for c in ("bandpass", "lowpass"):
        assert np.abs(both[c] - both[f"{c}_w"]).max() < 1e-9


def test_fused_thresholds_over_batches_and_a_restart(spark, samples, tmp_path):
    sdf, folder = samples
    p = Detection(alpha=0.05, window_rows=20)
    ax = Axis(chunk_len=3_000)
    raw = sdf.withColumn("_v", gravity_projection(*[tuple(F.col(f"{c}{a}") for a in "xyz") for c in ("lin_a", "grav_")])[0]).withColumn(
        "_h", gravity_projection(*[tuple(F.col(f"{c}{a}") for a in "xyz") for c in ("lin_a", "grav_")])[1]).withColumn("turn", F.abs("gx") * 3)
    smooth = fusion.causal_filters(raw, ax, {"a_vertical_f": "_v"}, {"a_horizontal_f": "_h"}, block_rows=900).drop("idx")
    want = peaks.adaptive_energy(smooth, ax, "a_vertical_f", "turn", p).toPandas()

    # the files come in two parts: a second run goes on from the checkpoint of the first
    parts, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    lasts = [T0 - 100 + i * 8_000 for i in range(1, PARTS)]
    with streams.rocks_db(spark):
        for run in ((0, 1, 2), (3, 4)):
            for i in run:
                lo = lasts[i - 1] if i else 0
                hi = lasts[i] if i < len(lasts) else 10 ** 15
                raw.where((F.col("ts_ms") >= lo) & (F.col("ts_ms") < hi)).drop("_v", "_h").coalesce(1).write.mode("append").parquet(parts)
            live_ = streams.ingest(spark, parts, raw.drop("_v", "_h").schema, 1)
            streams.write_available(streams.fused_thresholds(live_, "trip_id", ["ts_ms"], "turn", p), out, state)
    got = spark.read.parquet(out).toPandas()
    both = got.merge(want, on=["trip_id", "ts_ms"], suffixes=("", "_w"))
    assert len(got) == len(want) == len(both)
    for a, b in (("a_vertical", "a_vertical_f"), ("a_horizontal", "a_horizontal_f"), ("energy", "energy_w"), ("threshold", "threshold_w"),
                 ("gyro_threshold", "gyro_threshold_w")):
        assert np.abs(both[a] - both[b]).max() < 1e-8, a
    assert (both.active == both.active_w).mean() > 0.999 and both.active.any()


def test_cooldown_frees_its_state(spark, samples):
    hot = live(spark, samples).withColumn("prob", F.abs("lin_ay") / 10)
    got = streams.drain(streams.cooldown(hot, "trip_id", ["ts_ms"], "prob", 0.04, 700, "at", "1 second"), "ct")
    want = fusion.cooldown_triggers(samples[0].withColumn("prob", F.abs("lin_ay") / 10), Axis(chunk_len=3_000), "prob", 0.04, 700)
    key = lambda d: sorted((r.trip_id, r.ts_ms) for r in d.collect())
    assert key(got) == key(want)


def test_cooldown(spark, samples):
    hot = lambda df: df.withColumn("prob", F.abs("lin_ay") / 10)
    got = streams.drain(streams.cooldown(hot(live(spark, samples)), "trip_id", ["ts_ms"], "prob", 0.04, 700), "c")
    want = fusion.cooldown_triggers(hot(samples[0]), Axis(chunk_len=3_000), "prob", 0.04, 700)
    key = lambda d: sorted((r.trip_id, r.ts_ms) for r in d.collect())
    assert key(got) == key(want) and len(key(want)) > 20


def test_candidates(spark, samples):
    p = Detection(alpha=0.05)
    got = streams.drain(streams.candidates(live(spark, samples), "trip_id", "at", ["ts_ms"], "sig", "gyro", "1 second", p, Clustering(), 5_000), "k")
    found = peaks.detect_peaks(samples[0], Axis(chunk_len=3_000), "sig", "gyro", ["ts_ms", "sig", "gyro", "lat", "lon", "speed"], p)
    found = found.select("trip_id", "ts_ms", "lat", "lon", F.col("sig").alias("peak_vertical"), F.col("sig").alias("peak_mag"),
                         F.col("gyro").alias("peak_gyro_mag"), F.col("speed").alias("peak_speed"))
    ax = Axis(chunk_len=3_000)
    want = peaks.cluster_events(peaks.cluster_peaks(found, ax), ax)
    a = sorted((r.trip_id, r.time, r.n_peaks) for r in got.collect())
    b = sorted((r.trip_id, r.ts_ms, r.n_peaks) for r in want.where("trip_id <> 'zz-9'").collect())
    assert a == b and len(b) > 5


def test_windows_and_sessions(spark, samples):
    got = streams.drain(streams.sliding_features(live(spark, samples), "trip_id", "at", "1 second", "2 seconds", "1 second"), "w").toPandas()
    pdf = samples[0].toPandas()
    for r in got[got.trip_id == "aa-1"].sample(8, random_state=1).itertuples():
        w = pdf[(pdf.trip_id == "aa-1") & (pdf.ts_ms >= r.window_start / 1000) & (pdf.ts_ms < r.window_end / 1000)].sort_values("ts_ms")
        assert r.mag_mean == pytest.approx(w.magnitude.mean()) and r.mag_jrk == pytest.approx(w.magnitude.diff().abs().mean())
        assert r.vert_std == pytest.approx(w.a_vertical.std(ddof=0))
    seen = streams.drain(streams.sessions(live(spark, samples), "trip_id", "at", "1 second", "5 seconds"), "s").collect()
    assert {(r.trip_id, r.segment_rows) for r in seen} == {("aa-1", 4000), ("bb-2", 4000)}


def test_duplicates(spark, samples):
    twice = live(spark, samples).select("trip_id", "ts_ms", "at").withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    assert streams.drain(streams.unique_samples(twice, "trip_id", "at", "1 second"), "d").count() == 8100
