"""Distributions, summaries, data-quality reports and top-k tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwave.functions.exprs import ratio, speed_bucket
from tripwave.operators.ordered import Axis, exact_quantiles, join_per_key, materialize, range_chunks, running
from tripwave.params import CLASSES


def attach_one(df: DataFrame, row: DataFrame) -> DataFrame:
    """Columns of a table of one row at most on every row, as a scalar subquery; NULL if it is empty."""
    one = row.select(F.struct(*[F.col(c) for c in row.columns])).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col("_one")[c].alias(c) for c in row.columns])


def long_form(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids..., feature, value) rows."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(ids), list(features), "feature", "value")


def class_distribution(df: DataFrame, label: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Count, share, and Non-Event : class ratio for each class; an absent class counts as one in the ratio."""
    spark = df.sparkSession
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(c,) for c in classes], f"{label} string")
    full = grid.join(counts, label, "left").na.fill(0, ["n"])
    whole = Window.partitionBy()
    full = full.withColumn("_total", F.sum("n").over(whole))
    full = full.withColumn("_first", F.sum(F.when(F.col(label) == classes[0], F.col("n"))).over(whole))
    share = ratio(F.col("n") * 100.0, F.col("_total"))
    return full.select(label, "n", share.alias("pct"), (
        F.greatest("_first", F.lit(1)) / F.greatest("n", F.lit(1))).alias("imbalance"))


def pipeline_summary(candidates: DataFrame, windows: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: trips, distance, durations, event and level counts, window statistics."""
    def tally(col: str, names: Sequence[str], prefix: str) -> list[Column]:
        return [F.count_if(F.col(col) == v).alias(f"{prefix}_{v}") for v in names]

    bucket = speed_bucket(F.col("speed_mean"))
    ev = candidates.agg(
        F.count(F.lit(1)).alias("n_events"), *tally("priority", ("high", "medium", "low"), "priority"),
        *tally("level", ("high_conf", "candidate", "normal"), "level"),
        *[F.count_if(bucket == b).alias(f"speed_{b}") for b in ("low", "mid", "high")])
    positive = F.when(F.col("gyro_mag_max") > 0, F.col("gyro_mag_max"))
    wi = windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("vert_max").alias("vert_mean"),
        F.stddev_samp("vert_max").alias("vert_std"), F.max("vert_max").alias("vert_max"),
        F.count(positive).alias("gyro_windows"), F.avg(positive).alias("gyro_mean"),
        F.stddev_samp(positive).alias("gyro_std"), F.max(positive).alias("gyro_max"))
    me = meta.agg(F.count(F.lit(1)).alias("n_trips"), (F.sum("distance") / 1000).alias("distance_km"),
                  (F.sum("duration") / 60).alias("duration_min"),
                  (ratio(F.sum("distance"), F.sum("duration"), None) * 3.6).alias("mean_kmh"))
    return attach_one(attach_one(me, ev), wi).withColumn(
        "events_per_km", ratio(F.col("n_events"), F.col("distance_km"), None))


def describe_features(df: DataFrame, features: Sequence[str], top: int = 20) -> DataFrame:
    """Mean, sample std, min, max of the ``top`` features by std."""
    rows = long_form(df, [], features).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return rows.orderBy(F.desc("std"), "feature").limit(top)


def missing_and_infinite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    inf = F.abs(F.col("value")) == float("inf")
    return long_form(df, [], features).groupBy("feature").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(inf).alias("n_inf"))


def bounds_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features breaking a physical rule; extremes come from one pass over the rows."""
    ext = long_form(df, [], features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    name, lo, hi = F.col("feature"), F.col("lo"), F.col("hi")
    # Rule bounds and the features they apply to.
    positive = name.contains("energy") | name.contains("std") | name.contains("mag")
    unit = name.isin("min_z_to_max_z_ratio", "asymmetry_score")
    rules = F.array_compact(F.array(
        F.when(positive & (lo < 0), "negative"),
        F.when(unit & ((lo < -1.05) | (hi > 1.05)), "outside_unit"),
        F.when((name == "first_peak_polarity") & ((lo < -1.0) | (hi > 1.0)), "outside_unit"),
        F.when((hi > 1e4) & (name != "linear_jerk_3d_max"), "extreme")))
    return ext.withColumn("broken", F.explode(rules))


def group_class_matrix(df: DataFrame, key: str, label: str, classes: Sequence[object]) -> DataFrame:
    """Rows per trip and class, one column per class."""
    names = [str(c).lower().replace(" ", "_").replace("-", "_") for c in classes]
    return df.groupBy(key).agg(*[F.count_if(F.col(label) == c).alias(f"n_{n}") for c, n in zip(classes, names)])


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def outcome_ratio(df: DataFrame, outcome: str, features: Sequence[str], top: int = 10) -> DataFrame:
    """FP mean over TP mean per feature, flagged, most different first."""
    rows = long_form(df, [outcome], features).groupBy("feature").agg(
        F.avg(F.when(F.col(outcome) == "TP", F.col("value"))).alias("tp_mean"),
        F.avg(F.when(F.col(outcome) == "FP", F.col("value"))).alias("fp_mean"))
    r = F.col("fp_mean") / (F.col("tp_mean") + 1e-9)
    signal = F.when((F.col("ratio") < 0.5) | (F.col("ratio") > 2.0), "HIGH").when(
        (F.col("ratio") < 0.7) | (F.col("ratio") > 1.5), "MED")
    rows = rows.withColumn("ratio", r).withColumn("signal", signal).where(F.col("signal").isNotNull())
    return rows.orderBy(F.desc(F.abs(F.col("ratio") - 1)), "feature").limit(top)


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the group's extremes; the last bin includes the maximum."""
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    ends = known.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    rows = join_per_key(known, ends, by, ["_x"]) if by else attach_one(known, ends)
    place = F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))))
    rows = rows.withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0)))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                        F.max(F.col("_lo") + F.col("bin") * width).alias("edge"))


def class_statistics(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """n, mean, sample std and exact quartiles per feature and class."""
    rows = long_form(df, [label], features)
    stats = rows.groupBy("feature", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    cuts = exact_quantiles(rows, ["feature", label], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return stats.join(cuts, ["feature", label])


def signal_stats(df: DataFrame, key: str, value: str, speed: str) -> DataFrame:
    """Population std, largest and 95th-percentile magnitude, mean speed per trip."""
    stats = df.groupBy(key).agg(F.stddev_pop(value).alias("std"), F.max(F.abs(F.col(value))).alias("max_abs"),
                                F.coalesce(F.avg(speed), F.lit(0.0)).alias("mean_speed"))
    p95 = exact_quantiles(df.select(key, F.abs(F.col(value)).alias("_abs")), [key], "_abs", {"p95_abs": 0.95})
    return stats.join(p95, key)


def control_trip(stats: DataFrame, key: str, anomaly: object) -> DataFrame:
    """The suspect trip against the middle trip by std, with ratios and findings."""
    others = range_chunks(stats.where(F.col(key) != F.lit(anomaly)), ["std", key])
    ranked = running(others, Axis((), ("std", key), None), {"_rank": F.lit(1)})
    total = others.agg(F.floor(F.count(F.lit(1)) / 2).alias("_mid"))
    middle = attach_one(ranked, total).where(F.col("_rank") - 1 == F.col("_mid")).drop("_rank", "_mid")
    suspect = stats.where(F.col(key) == F.lit(anomaly))
    measures = [c for c in stats.columns if c != key]
    pair = attach_one(suspect.select(F.col(key).alias("trip"), *[F.col(c).alias(f"a_{c}") for c in measures]),
                      middle.select(F.col(key).alias("control"), *[F.col(c).alias(f"c_{c}") for c in measures]))
    out = pair.where(F.col("control").isNotNull()).select("trip", "control", *[
        (F.col(f"a_{c}") / (F.col(f"c_{c}") + 1e-9)).alias(f"{c}_ratio") for c in measures])
    # Diagnosis thresholds.
    if "power_high" in measures:
        out = out.withColumn("loose_mount", F.col("power_high_ratio") > 3.0)
    return out.withColumn("excess_std", F.col("std_ratio") > 1.5)


def route_bounds(df: DataFrame, key: str) -> DataFrame:
    """Centre, bounding box and point count per trip, rows without position left out."""
    known = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("lat").alias("lat_mean"), F.avg("lon").alias("lon_mean"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def route_pieces(df: DataFrame, key: str, ts: str, piece_len: int) -> DataFrame:
    """A trip's polyline as ordered pieces of ``piece_len`` time units, so no trip becomes one array."""
    known = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    cut = known.withColumn("piece", F.floor(F.col(ts) / piece_len))
    points = F.array_sort(F.collect_list(F.struct(ts, "lat", "lon")))
    return cut.groupBy(key, "piece").agg(points.alias("points"))


def worklist(events: DataFrame, priority: str, limits: Mapping[str, int | None], order: Column) -> DataFrame:
    """All rows of unlimited strata, and the first ``limit`` by ``order`` of the others."""
    parts = []
    for value, limit in limits.items():
        rows = events.where(F.col(priority) == value)
        if limit is not None:
            rows = rows.orderBy(order).limit(limit)
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def learning_curve(epochs: DataFrame) -> DataFrame:
    """Mean and population std over folds per epoch."""
    return epochs.groupBy("epoch").agg(*[
        f(c).alias(f"{c}_{n}") for c in ("train_loss", "val_loss", "val_f1")
        for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def best_epochs(epochs: DataFrame) -> DataFrame:
    """The epoch of the highest validation F1 per fold, earliest on a tie."""
    best = F.struct("val_f1", -F.col("epoch"))
    return epochs.where(F.col("val_f1").isNotNull()).groupBy("fold").agg(
        F.max_by("epoch", best).alias("epoch"), F.max("val_f1").alias("val_f1"))


MOMENTS = "a int, b int, n long, mx double, my double, cxx double, cyy double, cxy double"


class Comoments:
    """Counts, means and central products of every pair of columns over the rows where both are known."""

    def __init__(self, k: int) -> None:
        self.n = np.zeros((k, k))
        self.mean, self.square, self.product = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))

    def add(self, x: np.ndarray) -> None:
        """Rows of a block; entry (i, j) of ``mean`` and ``square`` is of column i on the rows shared with j."""
        known = ~np.isnan(x)
        middle = np.array([c[m].mean() if m.any() else 0.0 for c, m in zip(x.T, known.T)])
        v, m = np.where(known, x - middle, 0.0), known.astype(float)
        n, s = _product(m, m), _product(v, m)
        mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        square, product = _product(v * v, m) - n * mean * mean, _product(v, v) - n * mean * mean.T
        mean = np.where(n > 0, mean + middle[:, None], 0.0)
        total = self.n + n
        share = np.divide(n, total, out=np.zeros_like(n), where=total > 0)
        step = mean - self.mean
        self.square += np.maximum(square, 0.0) + step * step * self.n * share
        self.product += product + step * step.T * self.n * share
        self.mean += step * share
        self.n = total


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b without the threads of a linear algebra library, which would compete with Spark's."""
    return np.einsum("ri,rj->ij", a, b)


def correlation_pairs(df: DataFrame, features: Sequence[str], block_rows: int = 4_096) -> DataFrame:
    """Lower-triangle Pearson correlations from one pass: tasks keep the co-moments of all pairs as matrices,
    Spark adds them up. A pair goes by the rows where both are known; NaN is unknown; constants give 0."""
    k, names = len(features), list(features)
    values = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Comoments(k)
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                kept.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]))
        a, b = np.tril_indices(k, -1)
        both = kept.n[a, b] > 0
        a, b = a[both], b[both]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(kept.n[a, b].astype(np.int64)),
             *[pa.array(x) for x in (kept.mean[a, b], kept.mean[b, a], kept.square[a, b], kept.square[b, a], kept.product[a, b])]],
            names=["a", "b", "n", "mx", "my", "cxx", "cyy", "cxy"])

    parts = materialize(values.mapInArrow(run, MOMENTS))  # a row per pair and task
    n = F.col("n")
    means = parts.groupBy("a", "b").agg(*[(F.sum(n * F.col(c)) / F.sum("n")).alias(f"_{c}") for c in ("mx", "my")])
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    sums = parts.join(means, ["a", "b"]).groupBy("a", "b").agg(
        F.sum(F.col("cxy") + n * dx * dy).alias("xy"), F.sum(F.col("cxx") + n * dx * dx).alias("xx"),
        F.sum(F.col("cyy") + n * dy * dy).alias("yy"), F.sum("n").alias("n"),
        F.max(F.abs(F.col("mx"))).alias("_ax"), F.max(F.abs(F.col("my"))).alias("_ay"))

    def moves(square: str, size: str) -> Column:  # more than what rounding leaves of a constant
        return F.col(square) > F.col("n") * F.pow(F.col(size) * 1e-13, F.lit(2.0))

    r = F.when(moves("xx", "_ax") & moves("yy", "_ay"), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0))
    grid = [(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names[:i])]
    pairs = df.sparkSession.createDataFrame(grid, "a int, b int, feature_a string, feature_b string")
    return pairs.join(sums.select("a", "b", r.alias("r")), ["a", "b"], "left").select(
        "feature_a", "feature_b", F.coalesce("r", F.lit(0.0)).alias("r"))


def target_correlation(df: DataFrame, features: Sequence[str], target: Column) -> DataFrame:
    """Absolute correlation of each feature with a 0/1 target where both are known, and whether it passes either threshold."""
    rows = df.select(target.cast("double").alias("_y"), *features)

    def strength(f: str) -> Column:
        both = F.col(f).isNotNull() & F.col("_y").isNotNull()
        x, y = F.when(both, F.col(f).cast("double")), F.when(both, F.col("_y"))
        return F.abs(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    cells = [F.struct(F.lit(f).alias("feature"), strength(f).alias("abs_r")) for f in features]
    out = rows.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    # Selection thresholds.
    return out.withColumn("selected_r05", F.col("abs_r") >= 0.5).withColumn("selected_r035", F.col("abs_r") >= 0.35)
