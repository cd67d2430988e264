"""Whole stages on synthetic trips: detection, training rows, tensors, file sources, streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tripwave.operators import features, fusion, reconcile, sampling, split, stats, windows
from tripwave.operators.aggregates import target_correlation
from tripwave.operators.ordered import Axis
from tripwave.operators.timeseries import ema_window
from tripwave.params import CLASSES, EventWindow, Tensor
from tripwave.plans import candidates
from tripwave.sources import logs, trips
from trips_fixture import NUMERIC, T0, trip

AX = Axis(("trip_id",), ("ts_ms",), 4_000)


@pytest.fixture(scope="module")
def raw(spark):
    a = trip(40, "aa-1", potholes=(10, 25), bumps=(32,))
    b = trip(40, "bb-2", potholes=(12,), seed=8)
    broken = trip(30, "cc-3", holes=((10, 6),))
    return spark.createDataFrame(pd.concat([a, b, broken])).cache()


def test_candidates(spark, raw):
    found, wins = candidates.trip_candidates(raw, AX, NUMERIC)
    rows = found.toPandas()
    assert set(rows.trip_id) == {"aa-1", "bb-2"}  # the trip with a six second hole is left out
    assert sorted(rows.candidate_id) == list(range(len(rows)))
    for trip_id, second in (("aa-1", 10), ("aa-1", 25), ("aa-1", 32), ("bb-2", 12)):
        near = rows[(rows.trip_id == trip_id) & ((rows["at"] - T0) / 1000).between(second - .2, second + .8)]
        assert len(near), (trip_id, second)
    assert set(rows.priority) <= {"high", "medium", "low"} and rows.score.between(0, 1).all()
    assert {"suggested_label", "kurtosis", "level"} <= set(rows.columns)
    assert wins.groupBy("trip_id").count().where("trip_id = 'aa-1'").first()["count"] == 39


def test_row_order_does_not_matter(spark, raw):
    a = candidates.trip_candidates(raw, AX, NUMERIC)[0].select("trip_id", "at", F.round("score", 9).alias("s"))
    mixed = raw.orderBy(F.xxhash64("ts_ms")).repartition(3)
    b = candidates.trip_candidates(mixed, Axis(("trip_id",), ("ts_ms",), 90_000), NUMERIC)[0].select("trip_id", "at", F.round("score", 9).alias("s"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def numpy_features(w):
    """A few features of one window straight from their definitions."""
    v, t = w.a_vertical.to_numpy(), w.ts_ms.to_numpy() / 1000
    d = np.diff(v)
    p = int(np.argmax(np.abs(v)))
    return {
        "vertical_energy": (v ** 2).sum(), "peak_to_peak": np.ptp(v), "zcr": (np.diff(np.sign(v)) != 0).sum() / len(v),
        "max_jerk": np.abs(d).max() / np.median(np.diff(t)), "hjorth_mobility": np.sqrt(d.var() / v.var()),
        "hjorth_complexity": np.sqrt(np.diff(d).var() / d.var()) / np.sqrt(d.var() / v.var()),
        "corr_xy": np.corrcoef(w.lin_ax, w.lin_ay)[0, 1], "rise_time_ratio": min(p / (len(v) - 1 - p + 1e-6), 50),
        "waveform_complexity": min(np.abs(d).sum() / (abs(v[-1] - v[0]) + 1e-6), 100), "grav_y_std": w.grav_y.std(),
        "kurtosis": ((v - v.mean()) ** 4).mean() / v.var() ** 2 - 3}


def test_features_equal_definitions(spark, raw):
    fused = fusion.native_fusion(raw.where("trip_id = 'aa-1'"), AX, NUMERIC).cache()
    ev = spark.createDataFrame([("aa-1", i, T0 + s) for i, s in enumerate((10_050, 3_000, 200, 39_950, 90_000))], "trip_id string, ev int, at bigint")
    got = features.event_features(fused, ev, AX, "ev", "at").toPandas().set_index("ev")
    pdf = fused.toPandas().sort_values("ts_ms")
    for i, s in enumerate((10_050, 3_000, 200, 39_950)):
        for name, want in numpy_features(pdf[pdf.ts_ms.between(T0 + s - 1000, T0 + s + 1000)]).items():
            assert got.loc[i, name] == pytest.approx(want, rel=1e-6, abs=1e-9), (i, name)
    assert (got.loc[4, list(features.EVENT_FEATURES)] == 0).all()  # no samples: zeros
    assert got.snr_vertical[0] > 5 and got.snr_vertical[2] == 1.0
    flat = features.event_features(fused, ev, AX, "ev", "at", EventWindow(), compat_snr=True).where("ev = 0").first()
    assert flat.snr_vertical == 1.0
    assert len(features.EVENT_FEATURES) == 47


def test_training_rows(spark, raw):
    events = spark.createDataFrame([("e1", "aa-1", T0 + 10_050), ("e2", "cc-3", T0 + 5_000), ("e3", "cc-3", T0 + 13_000), ("e4", "bb-2", T0 + 1)],
                                   "event_id string, trip_id string, at bigint")
    truth = spark.createDataFrame([("e1", "Pothole"), ("e2", "Non-Event"), ("e3", "Pothole")], "event_id string, label string")
    bg = spark.createDataFrame([("bg_0", "bb-2", T0 + 20_000, "Non-Event", "auto_background")], "event_id string, trip_id string, at bigint, label string, source string")
    out = candidates.labelled_feature_rows(raw, events, truth, bg, AX, NUMERIC).toPandas().set_index("event_id")
    assert sorted(out.index) == ["bg_0", "e1", "e2"]  # e3 lies in a hole, e4 has no label
    assert out.vertical_energy.e1 > 10 * out.vertical_energy.e2


def test_tensors_and_reasons(spark):
    df = trip(40, "aa-1", holes=((20, 5.2), (30, 5.5)))
    df = df[(df.ts_ms < T0 + 36_500)]
    labelled = spark.createDataFrame([("ok", "aa-1", T0 + 10_000), ("near", "aa-1", T0 + 18_600), ("hole", "aa-1", T0 + 22_000),
                                      ("edge", "aa-1", T0 + 200), ("short", "aa-1", T0 + 36_000)], "event_id string, trip_id string, at bigint")
    done, skipped = candidates.tensor_set(spark.createDataFrame(df), labelled, AX)
    rows = {r.event_id: r for r in done.collect()}
    assert set(rows) == {"ok"} and all(len(rows["ok"][c]) == 230 for c in Tensor().channels)
    assert {r.event_id: r.reason for r in skipped.collect()} == {
        "near": "gap_buffer", "hole": "in_gap", "edge": "extract_failed", "short": "short_segment"}


def test_sliding_windows_are_anchored(spark):
    df = spark.createDataFrame([("a", 3 + 10 * i) for i in range(501)], "trip_id string, ts_ms bigint")
    got = windows.sliding_windows(df, AX, 2000, 1000).groupBy("window_start").count().orderBy("window_start").collect()
    assert [(r.window_start, r["count"]) for r in got] == [(3, 200), (1003, 200), (2003, 200), (3003, 200)]


def test_range_join_edges(spark):
    s = spark.createDataFrame([("a", t) for t in range(0, 5000, 100)], "trip_id string, ts bigint")
    e = spark.createDataFrame([("a", "e", t) for t in (0, 999, 1000, 2000, 4999)], "trip_id string, ev string, at bigint")
    for closed in (True, False):
        got = windows.range_join(s, e, "trip_id", "ts", "at", 1000, 1000, closed).groupBy("at").count().collect()
        for r in got:
            want = sum(1 for t in range(0, 5000, 100) if r["at"] - 1000 <= t and (t <= r["at"] + 1000 if closed else t < r["at"] + 1000))
            assert r["count"] == want


def test_collisions(spark):
    rows = [("t", 1, 1, "Non-Event", 100), ("t", 1, 2, "Pothole", 300), ("t", 1, 3, "Pothole", 200), ("t", 1, 4, "Pothole", 200),
            ("t", 1, 5, "Speed Bump", 1), ("t", 2, 6, "Unsure", 5), ("t", 2, 7, "nonsense", 0)]
    df = spark.createDataFrame(rows, "trip_id string, ev int, label_no int, label string, dt int")
    for length in (1, 1000):
        got = {r.ev: (r.label, r.n_labels, r.collisions) for r in reconcile.resolve_collisions(df, "trip_id", "ev", "label_no", "label", "dt", length).collect()}
        assert got == {1: ("Pothole", 5, 2), 2: ("Unsure", 2, 0)}


def test_nearest_in_space_is_exact(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"a_id": range(60), "lat": -7 + rng.normal(0, 2e-4, 60), "lon": 110 + rng.normal(0, 2e-4, 60)})
    b = pd.DataFrame({"b_id": range(80), "lat": -7 + rng.normal(0, 2e-4, 80), "lon": 110 + rng.normal(0, 2e-4, 80)})
    got = reconcile.nearest_in_space(spark.createDataFrame(a), spark.createDataFrame(b), "a_id", "b_id").toPandas().set_index("a_id").b_id.to_dict()

    def dist(p, q):
        p1, p2 = np.radians(p.lat), np.radians(q.lat)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(q.lon - p.lon) / 2) ** 2
        return 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    want = {}
    for p in a.itertuples():
        d = dist(p, b)
        if d.min() <= 10:
            want[p.a_id] = int(b.b_id[d.idxmin()])
    assert got == want and len(want) > 10


def test_nearest_in_space_across_the_meridian(spark):
    a = [(1, 0.0, 179.99999), (2, 60.0, -179.99999), (3, -7.0, 180.0), (4, 0.0, 179.9), (5, 89.5, -180.0)]
    b = [(1, 0.0, -179.99999), (2, 60.0, 179.99999), (3, -7.0, -180.0), (4, 0.0, -179.9), (5, 89.5, 179.9999)]
    got = reconcile.nearest_in_space(spark.createDataFrame(a, "a long, lat double, lon double"),
                                     spark.createDataFrame(b, "b long, lat double, lon double"), "a", "b", 10.0)
    found = {r["a"]: (r["b"], r["distance_m"]) for r in got.collect()}
    assert {k: v[0] for k, v in found.items()} == {1: 1, 2: 2, 3: 3, 5: 5}
    assert abs(found[1][1] - 2.2239) < 0.01 and abs(found[2][1] - 1.112) < 0.01 and found[3][1] < 1e-6


@pytest.mark.parametrize("pivots,part", [(64, 4096), (7, 20), (2, 5)])
def test_neighbours_are_exact(spark, pivots, part):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) * 0.1 + 5, np.ones((40, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    got = sampling.neighbours(df, "id", "x", 3, pivots, part).toPandas()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:3]
        assert got[got.id == i].sort_values("rank").other.tolist() == want.tolist()
    assert sampling.neighbours(df.limit(1), "id", "x", 3).count() == 0


def test_smote_fills_classes(spark):
    df = spark.createDataFrame([(i, int(i >= 20), [float(i), 1.0]) for i in range(27)], "id int, cls int, x array<double>")
    out = sampling.smote(df, "id", "cls", "x").toPandas()
    assert out.cls.value_counts().to_dict() == {0: 20, 1: 20}
    made = out[out.synthetic]
    assert all(20 <= v[0] <= 26 and v[1] == 1.0 for v in made.x)
    alone = spark.createDataFrame([(0, 0, [1.0]), (1, 1, [2.0]), (2, 1, [3.0])], "id int, cls int, x array<double>")
    assert sampling.smote(alone, "id", "cls", "x").count() == 3


def test_augment_repeats(spark):
    df = spark.createDataFrame([(i, [float(j) for j in range(230)]) for i in range(5)], "id int, x array<double>")
    a, b = [sampling.augment(df, "id", ["x"], 200).orderBy("id").toPandas() for _ in range(2)]
    assert all(len(v) == 200 for v in a.x) and all(np.array_equal(p, q) for p, q in zip(a.x, b.x))


class TestSplit:
    def rows(self, spark):
        data = [(t, c) for t, counts in dict(A=(50, 9, 5), B=(40, 2, 8), C=(60, 5, 1), D=(20, 0, 0), E=(30, 4, 4), F=(10, 1, 2)).items()
                for c, n in zip(CLASSES, counts) for _ in range(n)]
        return spark.createDataFrame(data, "trip_id string, label string")

    def test_split_is_disjoint_and_greedy(self, spark):
        df = self.rows(spark)
        got = {r.trip_id: r.side for r in split.checked_split(split.group_split(df, "trip_id", "label", CLASSES, CLASSES[1:], .7)).collect()}
        counts = df.toPandas().groupby(["trip_id", "label"]).size().unstack(fill_value=0)[list(CLASSES)]
        order = sorted(counts.index, key=lambda t: (-counts.loc[t, list(CLASSES[1:])].sum(), t))
        total, taken, want = counts.sum().to_numpy() + 1e-9, np.zeros(3), {}
        for t in order:
            c = counts.loc[t].to_numpy()
            better = (((taken + c) / total - .7) ** 2).sum() < ((taken / total - .7) ** 2).sum()
            want[t] = "train" if better else "test"
            taken = taken + c if better else taken
        assert got == want and set(got.values()) == {"train", "test"}

    def test_errors(self, spark):
        df = self.rows(spark)
        for ratio in (0.0, 1.0):
            with pytest.raises(ValueError):
                split.group_split(df, "trip_id", "label", CLASSES, CLASSES[1:], ratio)
        with pytest.raises(ValueError):
            split.group_split(df.where("false"), "trip_id", "label", CLASSES, CLASSES[1:])
        with pytest.raises(ValueError):
            split.checked_split(split.group_split(df.where("trip_id = 'A'"), "trip_id", "label", CLASSES, CLASSES[1:]))

    def test_kfold(self, spark):
        df = self.rows(spark)
        a, b = [{r.trip_id: r.fold for r in split.group_kfold(df, "trip_id", "label", CLASSES, 3).collect()} for _ in range(2)]
        assert a == b and set(a) == set("ABCDEF") and set(a.values()) == {0, 1, 2}

    def test_weights_sum_to_n(self, spark):
        df = self.rows(spark)
        assert split.balanced_weights(df, "label").agg(F.sum("weight")).first()[0] == pytest.approx(df.count())


def test_constant_correlation_and_effect(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("b", 3.0, 5.0), ("b", 5.0, 5.0)], "cls string, x double, k double")
    assert stats.agreement(df, "x", "k").first().pearson == 0
    got = {r.feature: r.d for r in stats.cohens_d(df, "cls", ["a", "b"], ["x", "k"]).collect()}
    assert got["k"] == 0 and got["x"] == pytest.approx(-2.5 / np.sqrt(1.25))


def test_kruskal_two_classes(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i + 4)) for i in range(10)], "cls string, x double")
    r = stats.kruskal(df, "cls", ["a", "b"], ["x"]).first()
    assert r.n_classes == 2 and 0 < r.p < 0.05


# Files


def test_trip_files(spark, tmp_path):
    for d in ("csv", "meta", "labels"):
        (tmp_path / d).mkdir()
    body = trip(1)[[c for c in trips.SAMPLE_SCHEMA.fieldNames() if c != "timestamp"]]
    body.insert(0, "timestamp", trip(1).ts_ms)
    body.loc[3, "speed"] = np.nan
    body.to_csv(tmp_path / "csv" / "Road_1.csv", index=False, na_rep="NaN")
    body.to_csv(tmp_path / "csv" / "Road_2.csv", index=False)
    (tmp_path / "meta" / "Road_1.json").write_text(json.dumps({"tripId": "id-1", "duration": 5, "distance": 2.5}, indent=2))
    (tmp_path / "meta" / "other.json").write_text(json.dumps({"tripId": "id-9"}))
    (tmp_path / "labels" / "x_labels.json").write_text(json.dumps(
        {"trip_index": 1, "trip_id": "id-1", "event_mapping": {"1": 2.5}, "labels": {"1": "Pothole", "2": "Non-Event"}}, indent=1))
    (tmp_path / "labels" / "old_labels.json").write_text(json.dumps({"trip_id": "id-2", "labels": {"7": "Speed Bump"}}))
    rows = trips.read_trip_csv(spark, str(tmp_path / "csv"))
    assert rows.where("speed IS NULL").count() >= 1 and rows.where(F.isnan("speed")).count() == 0
    paired = trips.pair_meta(rows, trips.read_trip_meta(spark, str(tmp_path / "meta")))
    assert {(r.trip_id, r["count"]) for r in paired.groupBy("trip_id").count().collect()} == {("id-1", 100), ("Road_2.csv", 100)}
    got = {(r.trip_id, r.event_no, r.label, r.time_s) for r in trips.read_labels(spark, str(tmp_path / "labels")).collect()}
    assert got == {("id-1", 1, "Pothole", 2.5), ("id-1", 2, "Non-Event", None), ("id-2", 7, "Speed Bump", None)}


def test_csv_by_header_classes(spark, tmp_path):
    files = {
        "plain.csv": "timestamp,ax,ay,az,lin_ax,note\n1000,1,2,3,4,x\n1010,5,6,7,8,\n",
        "quoted.csv": 'note,timestamp,"ax",ay,az,lin_ax\n"a, ""b"", c",2000,1,2,3,4\n"plain",2010,"5", 6 ,NaN,\n',
        "crlf.csv": "\ufefftimestamp,gx,accel_x,accel_y,accel_z\r\n3000,9,1,2,3\r\n3010,oops,4,5,6\r\n",
        "odd [1] name.csv": "\ntimestamp,ax,ay,az,lin_ax,note\n4000,1,2,3,4,last\n4010,1\n",
        "twice.csv": "timestamp,ax,ax\n5000,1,99\n", "empty.csv": "", "blank.csv": "\n\n", "head.csv": "timestamp,ax\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    schema = T.StructType([*trips.SAMPLE_SCHEMA.fields, T.StructField("note", T.StringType())])
    rows = {r.ts_ms: r for r in trips.read_trip_csv(spark, str(tmp_path), schema).collect()}
    cells = lambda t, *names: [rows[t][n] for n in names]
    assert sorted(rows) == [1000, 1010, 2000, 2010, 3000, 3010, 4000, 4010, 5000]
    assert cells(1000, "ax", "ay", "az", "lin_ax", "note") == [1, 2, 3, 4, "x"] and rows[1010].note is None
    assert cells(2000, "ax", "ay", "az", "lin_ax", "note") == [1, 2, 3, 4, 'a, "b", c']
    assert cells(2010, "ax", "ay", "az", "lin_ax", "note") == [5, 6, None, None, "plain"]
    assert cells(3000, "ax", "ay", "az", "gx") == [1, 2, 3, 9] and cells(3010, "ax", "gx") == [4, None]
    assert cells(4000, "ax", "note") == [1, "last"] and cells(4010, "ax", "ay", "note") == [1, None, None]
    assert rows[5000].ax == 1 and rows[4000].trip_file.startswith("odd")
    assert len(trips.header_classes(spark, str(tmp_path))) == 5
    (tmp_path / "none").mkdir()
    assert trips.read_trip_csv(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.csv").write_text('note,timestamp\n"two\nlines, one cell",7000\n')
    assert trips.read_trip_csv(spark, str(tmp_path / "lines"), schema, multi_line=True).first().note == "two\nlines, one cell"


def test_columns_are_required(spark):
    df = spark.createDataFrame([(1.0,)], "lin_ax double")
    with pytest.raises(ValueError):
        trips.with_accelerometer(df)
    with pytest.raises(ValueError):
        trips.require_columns(df, ["lat"])
    with pytest.raises(ValueError):
        fusion.native_fusion(df, AX, [])


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("noise\n[Epoch 09/50] Train Loss: 9 | Val Loss: 9\nx - === Fold 1 ===\n[Epoch 01/50] Train Loss: 0.1 | Val Loss: 0.2 | Val Macro F1: 0.5\n"
                                    "[Epoch 02/50] Train Loss: 0.1 | Val Loss: 0.3\n=== Fold 2 ===\n[Epoch 01/50] Train Loss: 0.4 | Val Loss: 0.5\n")
    got = [(r.fold, r.epoch, r.train_loss, r.val_loss, r.val_f1) for r in logs.read_epochs(spark, str(tmp_path)).orderBy("fold", "epoch").collect()]
    assert got == [(1, 1, .1, .2, .5), (1, 2, .1, .3, None), (2, 1, .4, .5, None)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16le", "utf-16"])
def test_trials(spark, tmp_path, encoding):
    text = "[I] Trial 3 finished with value: 0.56 and parameters: {'n': 242,\n 'lr': 0.01}. Best\r\n[I] Trial 4 pruned.\n"
    (tmp_path / "t.log").write_bytes(text.encode(encoding))
    r = logs.read_trials(spark, str(tmp_path)).collect()
    assert [(x.trial, x.value, x.params) for x in r] == [(3, .56, {"n": "242", "lr": "0.01"})]


def test_trials_with_python_literals(spark, tmp_path):
    (tmp_path / "t.log").write_text("[I] Trial 7 finished with value: 6.1e-05 and parameters: {'fast': True, 'depth': None, 'mode': \"a, b\", 'lr': 1e-3}. Best\n"
                                    "[I] Trial 8 finished with value: nan and parameters: {}.\n[I] Trial 9 finished with value: -inf and parameters: {'x': 1}.\n")
    r = sorted(logs.read_trials(spark, str(tmp_path)).collect())
    assert (r[0].trial, r[0].value) == (7, 6.1e-05)
    assert r[0].params == {"fast": "True", "depth": None, "mode": "a, b", "lr": "1e-3"}
    assert np.isnan(r[1].value) and r[1].params == {} and r[2].value == -np.inf


def test_statistics_skip_unknown_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 2 * x + rng.normal(size=60) * 0.1
    rows = [(float(a) if i % 4 else None, float(b) if i % 5 else None, i % 2) for i, (a, b) in enumerate(zip(x, y))]
    known = np.array([(a, b) for a, b, _ in rows if a is not None and b is not None])
    df = spark.createDataFrame(rows, "a double, b double, t int")
    got = stats.agreement(df, "a", "b").first()
    assert got.n == len(known) and abs(got.pearson - np.corrcoef(known.T)[0, 1]) < 1e-12
    assert abs(got.mae - np.abs(known[:, 0] - known[:, 1]).mean()) < 1e-12
    part = np.array([(a, t) for a, _, t in rows if a is not None])
    want = abs(np.corrcoef(part.T)[0, 1])
    assert abs(target_correlation(df, ["a"], F.col("t")).first().abs_r - want) < 1e-12


def test_ema_of_a_long_window(spark):
    n, alpha = 30_000, 0.05
    x = np.random.default_rng(2).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(n), "x": x}))
    got = ema_window(df, ["k"], "i", "x", alpha, "e").orderBy("i").toPandas().e.to_numpy()
    want, e = np.empty(n), x[0]
    for i, v in enumerate(x):
        e = v if i == 0 else alpha * v + (1 - alpha) * e
        want[i] = e
    assert np.abs(got - want).max() < 1e-9


def test_windows_without_gyroscope(spark):
    rows = [("t", i * 10, float(i % 7), float(i % 5), 1.0, 2.0) for i in range(300)]
    df = spark.createDataFrame(rows, "trip_id string, ts_ms long, magnitude double, a_vertical double, lat double, lon double")
    got = windows.window_features(df, AX, 1000, 500).collect()
    assert len(got) >= 4 and all(r.gyro_mag_max == 0 and r.gyro_x_std == 0 and r.speed_mean == 0 for r in got)
    assert features.with_missing(df, ["gx", "lat"]).first().gx == 0.0
