"""Ordered helpers against plain pandas, on chunk lengths that force every carry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwave.functions.recurrence import CausalFilter, lowpass
from tripwave.operators import fusion, peaks, timeseries
from tripwave.operators.ordered import Axis, asof, exact_quantiles, fill, islands, previous, row_index, running, running_max
from tripwave.params import BANDPASS_A, BANDPASS_B, Clustering, Detection, Resampling
from trips_fixture import NUMERIC, trip

LENGTHS = [1, 7, 50, 10_000]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 300
    df = pd.DataFrame({"trip_id": rng.choice(["a", "b", "hot"], n, p=[.1, .1, .8]), "ts_ms": rng.choice(2000, n, replace=False),
                       "x": rng.normal(size=n).round(3)})
    df["y"] = df.x.where(rng.random(n) < .3)
    return df.sort_values(["trip_id", "ts_ms"]).reset_index(drop=True)


def result(df, *order):
    return df.toPandas().sort_values(list(order or ("trip_id", "ts_ms"))).reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("length", LENGTHS)
def test_carry(spark, rows, length):
    ax = Axis(chunk_len=length)
    df = spark.createDataFrame(rows.sample(frac=1, random_state=2)).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    g = rows.groupby("trip_id")
    same(result(row_index(df, ax)).idx, g.cumcount())
    same(result(running(df, ax, {"s": F.col("x")})).s, g.x.cumsum())
    two = result(previous(df, ax, {"p": "x"}, steps=2))
    same(two.p, g.x.shift(1))
    same(two.p_2, g.x.shift(2))
    same(result(running_max(df, ax, "m", F.col("x"))).m, g.x.transform(lambda s: s.cummax().shift(1)))
    filled = result(fill(df, ax, back={"b": F.col("y")}, ahead={"f": F.col("y")}))
    same(filled.b, g.y.ffill())
    same(filled.f, g.y.transform(lambda s: s.bfill().shift(-1)))


@pytest.mark.parametrize("length", LENGTHS)
def test_islands(spark, rows, length):
    df = spark.createDataFrame(rows.sample(frac=1, random_state=4))
    got = result(islands(df, Axis(chunk_len=length), ["ts_ms"], lambda now, before: now["ts_ms"] - before["ts_ms"] > 9))
    brk = rows.groupby("trip_id").ts_ms.diff().gt(9)
    run = brk.groupby(rows.trip_id).cumsum()
    want = rows.groupby([rows.trip_id, run]).ts_ms.transform("min")
    assert got.island.map(lambda r: r["ts_ms"]).tolist() == want.tolist()


def test_quantiles_with_a_hot_group(spark, rows):
    got = exact_quantiles(spark.createDataFrame(rows), ["trip_id"], "x", {"q1": .25, "q2": .5, "p95": .95}).toPandas().set_index("trip_id").sort_index()
    want = rows.groupby("trip_id").x.quantile([.25, .5, .95]).unstack()
    np.testing.assert_allclose(got[["q1", "q2", "p95"]].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("length", LENGTHS)
def test_asof(spark, length):
    left = pd.DataFrame({"trip_id": "a", "at": [0, 5, 10, 11, 40]})
    right = pd.DataFrame({"trip_id": "a", "start": [5, 11, 30], "end": [6, 12, 31]})
    got = asof(spark.createDataFrame(left), spark.createDataFrame(right), Axis(("trip_id",), ("at",), length), F.col("at"), F.col("start"), ["end"], "hit")
    assert [(r.at, r.hit and r.hit["end"]) for r in got.orderBy("at").collect()] == [(0, None), (5, 6), (10, 6), (11, 12), (40, 31)]


def plain_filter(b, a, x, y0=None):
    y = []
    for n in range(len(x)):
        y.append(sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k))
    return np.array(y)


class TestFilters:
    t = np.linspace(0, 10, 1000)
    x = np.sin(2 * np.pi * .2 * t) + np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 45 * t)

    def test_bandpass_equals_recurrence(self):
        f = CausalFilter(BANDPASS_B, BANDPASS_A)
        got, _ = f.run(self.x, f.rest())
        assert np.abs(got - plain_filter(BANDPASS_B, BANDPASS_A, self.x)).max() < 1e-12

    def test_state_continues(self):
        f = CausalFilter(BANDPASS_B, BANDPASS_A)
        whole, _ = f.run(self.x, f.rest())
        first, s = f.run(self.x[:333], f.rest())
        second, _ = f.run(self.x[333:], s)
        assert np.abs(np.concatenate([first, second]) - whole).max() < 1e-12

    def test_lowpass_design_and_constant(self):
        f = lowpass(20, 100)
        b, a = [0.20657208, 0.41314417, 0.20657208], [1, -0.36952738, 0.19581571]
        np.testing.assert_allclose(f.run(self.x, f.rest())[0], plain_filter(b, a, self.x), atol=1e-6)
        np.testing.assert_allclose(f.steady(), [0.79342792, 0.01075637], atol=1e-8)
        np.testing.assert_allclose(f.run(np.full(200, 3.5), f.steady() * 3.5)[0], 3.5)
        assert lowpass(50, 100) is None

    def test_blocks_equal_one_pass(self, spark):
        df = spark.createDataFrame(pd.DataFrame({"trip_id": "a", "ts_ms": np.arange(5000), "x": np.tile(self.x, 5)}))
        out = {rows: result(fusion.causal_filters(df, Axis(chunk_len=999), {"bp": "x"}, {"lp": "x"}, block_rows=rows)) for rows in (800, 10_000)}
        for c in ("bp", "lp"):
            assert np.abs(out[800][c] - out[10_000][c]).max() < 1e-9


@pytest.mark.parametrize("alpha", [0.05, 0.2])
def test_ema_in_blocks(spark, alpha):
    x = np.random.default_rng(5).normal(size=6000)
    df = spark.createDataFrame(pd.DataFrame({"trip_id": "a", "ts_ms": np.arange(6000), "x": x}))
    got = result(timeseries.ema_stream(df, Axis(chunk_len=1000), "x", alpha, block_rows=500)).ema
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), atol=1e-10)


def test_threshold_blocks_do_not_change_peaks(spark):
    df = trip(60, potholes=(10, 30, 45), bumps=(20,)).assign(sig=lambda d: d.lin_ay, g=0.0)
    p = Detection(alpha=0.05)
    found = [result(peaks.detect_peaks(spark.createDataFrame(df), Axis(chunk_len=7_000), "sig", "g", ["ts_ms", "sig"], p, rows)) for rows in (1_500, 100_000)]
    assert found[0].ts_ms.tolist() == found[1].ts_ms.tolist() and len(found[0]) >= 4


def test_fast_average_on_a_long_trip(spark):
    """Far more rows than one block of an alpha of 0.2 may hold."""
    x = np.random.default_rng(7).normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"trip_id": "a", "ts_ms": np.arange(20_000), "x": x}))
    got = result(peaks.adaptive_energy(df, Axis(chunk_len=4_000), "x", None, Detection(alpha=0.2)))
    energy = pd.Series(x).rolling(20, min_periods=1).std().fillna(0)
    base = energy.ewm(alpha=0.2, adjust=False).mean()
    want = base + 3 * (energy - base).abs().ewm(alpha=0.2, adjust=False).mean()
    np.testing.assert_allclose(got.threshold, want, atol=1e-9)


def pandas_grid(df, cols):
    """Bin means on a full grid, then the bounded fills, straight from pandas."""
    d = df.drop_duplicates("ts_ms").sort_values("ts_ms")
    s = d.set_index(pd.to_datetime(d.ts_ms, unit="ms"))[cols].resample("10ms").mean()
    s = s.interpolate("linear", limit=5).ffill(limit=5)
    s = s.dropna(subset=["ax"])
    s["ts_ms"] = s.index.as_unit("ms").astype("int64")
    return s.reset_index(drop=True)


@pytest.mark.parametrize("chunk", [500, 3_000, 600_000])
def test_resample_equals_pandas(spark, chunk):
    df = trip(12, holes=((2, .07), (4, .15), (7, 1.2)))
    df.loc[100:103, "speed"] = np.nan
    df.loc[600:640, "speed"] = np.nan
    df.loc[len(df) - 7:, "speed"] = np.nan
    df.loc[:3, "lat"] = np.nan
    df = pd.concat([df, df.iloc[[50]]])
    cols = ["ax", "speed", "lat"]
    sdf = spark.createDataFrame(df[["trip_id", "ts_ms", *cols]].drop_duplicates("ts_ms"))
    sdf = sdf.select("trip_id", "ts_ms", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    got = result(timeseries.resample(sdf, ["trip_id"], "ts_ms", cols, ["ax"], chunk))
    want = pandas_grid(df, cols)
    assert got.ts_ms.tolist() == want.ts_ms.tolist()
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)


def test_long_hole_is_five_linear_then_five_held(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 200, 20.0)], "trip_id string, ts_ms bigint, ax double")
    got = result(timeseries.resample(df, ["trip_id"], "ts_ms", ["ax"], ["ax"], 50)).ax.tolist()
    assert got == pytest.approx([0, 1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 20])


def test_fill_rows_equals_pandas(spark):
    rng = np.random.default_rng(9)
    x = pd.Series(rng.normal(size=200)).where(rng.random(200) < .2)
    x[40:70] = np.nan
    df = pd.DataFrame({"trip_id": "a", "ts_ms": np.arange(200) * 10, "x": x})
    sdf = spark.createDataFrame(df).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    ax = Axis(chunk_len=130)
    got = result(timeseries.fill_rows(row_index(sdf, ax), ax, "idx", ["x"])).x
    want = x.interpolate("linear", limit=5).ffill(limit=5).bfill(limit=5)
    np.testing.assert_allclose(got.astype(float), want)


def test_strict_and_segment_modes(spark):
    df = spark.createDataFrame(trip(30, holes=((10, 5.2),)))
    ax = Axis(chunk_len=2_000)
    assert timeseries.gap_quarantine(df, ax).first().rejected
    assert timeseries.segments(df, ax).select("segment").distinct().count() == 2
    assert timeseries.large_gaps(df, ax).count() == 1


def test_guards(spark):
    df = spark.createDataFrame([("a", float(i) if i % 5 else None) for i in range(20)] + [("b", 1.0)] * 60, "trip_id string, lin_ax double")
    got = {r.trip_id: r.rejected for r in timeseries.null_ratio_guard(df, "trip_id", ["lin_ax"]).collect()}
    assert got == {"a": True, "b": False}
    assert {r.trip_id: r.too_short for r in timeseries.min_length_guard(df, "trip_id").collect()} == {"a": True, "b": False}


def test_dedupe_keeps_first_by_position(spark):
    df = spark.createDataFrame([("a", 1, 5, "late"), ("a", 1, 2, "early"), ("a", 2, 3, "x")], "trip_id string, ts_ms bigint, pos int, v string")
    assert sorted(r.v for r in timeseries.dedupe_samples(df, "trip_id", "ts_ms", "pos").collect()) == ["early", "x"]


def test_sample_rate(spark):
    df = spark.createDataFrame([("a", 10 * i) for i in range(100)] + [("b", 5)], "trip_id string, ts_ms bigint")
    got = timeseries.sample_rate(df, Axis(chunk_len=90), 1000.0).where("trip_id = 'a'").first()
    assert (got.hz, got.min_dist) == (100.0, 20)


def make_peaks(spark, times, trip_id="a", **over):
    base = dict(lat=-7.0, lon=110.0, peak_mag=30.0, peak_vertical=30.0, peak_gyro_mag=2.0, peak_speed=5.0) | over
    schema = "trip_id string, ts_ms bigint, " + ", ".join(f"{c} double" for c in base)
    return spark.createDataFrame([(trip_id, int(t * 1000), *base.values()) for t in times], schema)


@pytest.mark.parametrize("length", [100, 100_000])
class TestClustering:
    def events(self, spark, df, length):
        ax = Axis(chunk_len=length)
        return peaks.cluster_events(peaks.cluster_peaks(df, ax), ax)

    def test_empty(self, spark, length):
        assert self.events(spark, make_peaks(spark, []), length).count() == 0

    @pytest.mark.parametrize("times, n", [([1], 1), ([0, .5], 1), ([0, 5], 2), ([0, .8], 1), ([0, .7, 1.4, 2.1], 1), ([0, .801], 2)])
    def test_merge_and_split(self, spark, length, times, n):
        assert self.events(spark, make_peaks(spark, times), length).count() == n

    def test_far_or_unknown_place_splits(self, spark, length):
        far = make_peaks(spark, [0]).unionByName(make_peaks(spark, [.1], lat=-7.0001))
        assert self.events(spark, far, length).count() == 2
        lost = make_peaks(spark, [0]).unionByName(make_peaks(spark, [.1]).withColumn("lat", F.lit(None).cast("double")))
        assert self.events(spark, lost, length).count() == 2

    def test_ids_continue_across_trips(self, spark, length):
        both = make_peaks(spark, [0, 5]).unionByName(make_peaks(spark, [100, 105], trip_id="b"))
        ev = self.events(spark, both, length)
        out = peaks.number_events(ev, F.substring("trip_id", 1, 1), Axis(chunk_len=length), 42)
        assert [(r.trip_id, r.event_id) for r in out.orderBy("event_id").collect()] == [("a", 42), ("a", 43), ("b", 44), ("b", 45)]

    def test_columns_and_level(self, spark, length):
        ev = self.events(spark, make_peaks(spark, [0], peak_vertical=8.5 * 9.80665, peak_gyro_mag=0.0), length)
        assert {"ts_ms", "lat", "lon", "peak_mag", "peak_vertical", "peak_vertical_g", "peak_gyro_mag", "speed_mean", "level"} <= set(ev.columns)
        assert ev.first().level == "high_conf"

    def test_dominant_peak_and_missing_speed(self, spark, length):
        df = make_peaks(spark, [0], peak_vertical=3.0).unionByName(make_peaks(spark, [.2], peak_vertical=-9.0)).unionByName(
            make_peaks(spark, [.4], peak_vertical=9.0).withColumn("peak_speed", F.lit(None).cast("double")))
        r = self.events(spark, df, length).first()
        assert (r.ts_ms, r.peak_vertical, r.speed_mean) == (200, -9.0, 5.0)


def test_cooldown_of_an_endless_hot_run(spark):
    rng = np.random.default_rng(4)
    rows = [("long", int(t), float(p)) for t, p in zip(np.cumsum(rng.integers(1, 30, 6000)), rng.uniform(0.35, 1, 6000))]
    rows += [("calm", int(t), 0.9) for t in np.cumsum(rng.choice([5, 40, 2500], 300))] + [("calm", 5, 0.8), ("one", 7, 0.5)]
    df = spark.createDataFrame(rows, "trip_id string, ts_ms long, prob double").repartition(7)
    want = []
    for trip_id in ("long", "calm", "one"):
        at = np.array(sorted({t for k, t, _ in rows if k == trip_id}))
        want += [(trip_id, int(at[i])) for i in fusion.cooldown_walk(at, 0, 2_000)]
    for chunk_len in (900, 7_000, 600_000):
        got = fusion.cooldown_triggers(df, Axis(chunk_len=chunk_len), "prob")
        assert sorted((r.trip_id, r.ts_ms) for r in got.collect()) == sorted(want)
    # the endless run is many groups: no chunk of it holds a twentieth of its rows
    assert 20 * max(r["count"] for r in df.where("trip_id = 'long'").groupBy(F.floor(F.col("ts_ms") / 4_000)).count().collect()) < 6000 * 2
    assert fusion.cooldown_triggers(df.limit(0), Axis(), "prob").count() == 0


def test_cooldown(spark):
    df = spark.createDataFrame([("a", t, p) for t, p in [(0, .4), (500, .9), (2000, .5), (2001, .35), (9000, .1), (9001, .36)]], "trip_id string, ts_ms bigint, prob double")
    assert sorted(r.ts_ms for r in fusion.cooldown_triggers(df, Axis(chunk_len=700), "prob").collect()) == [0, 2001, 9001]


def test_welch_of_a_tone(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(3000) / 100)
    df = spark.createDataFrame(pd.DataFrame({"trip_id": "a", "ts_ms": np.arange(3000) * 10, "x": x}))
    got = fusion.welch_bands(df, Axis(chunk_len=5_000), "x", {"low": (2, 15, True), "high": (15, 45, False)}).first()
    assert got.low > 1e6 * got.high
