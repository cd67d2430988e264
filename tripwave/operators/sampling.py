"""Background sampling, undersampling, oversampling, augmentation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tripwave.operators.ordered import Axis, materialize, range_chunks, row_index
from tripwave.operators.reconcile import away_from_events, moving


def seeded_unit(seed: int, *cols: Column) -> Column:
    """Pseudo-random number in [0, 1) that depends on the columns and the seed only; SQL engines agree on it."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 13), 16, 10).cast("double") / float(1 << 52)


def seeded_key(seed: int, *cols: Column) -> Column:
    """Hex hash of the columns and the seed, a repeatable random order."""
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))


def first_by(df: DataFrame, order: Sequence[str], k: int | Column) -> DataFrame:
    """The first ``k`` rows by ``order``: totals of range partitions decide which of them count, nothing is gathered."""
    numbered = row_index(range_chunks(df, list(order)), Axis((), tuple(order), None), "_i")
    return numbered.where(F.col("_i") < k).drop("_i")


def background_candidates(trips: DataFrame, key: str, start: str, end: str, margin: int, unit: Column,
                          attempts: int = 100) -> DataFrame:
    """Up to ``attempts`` random times per trip, ``margin`` away from both ends; ``unit`` may use column ``attempt``."""
    rows = trips.where(F.col(end) - F.col(start) > 2 * margin)
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    at = F.col(start) + margin + F.floor(unit * (F.col(end) - F.col(start) - 2 * margin))
    return rows.select(key, "attempt", at.alias("at"))


def background_sample(samples: DataFrame, events: DataFrame, labelled: DataFrame, key: str, ts: str, event_at: str,
                      label: str, unit: Column, margin: int, away: int, half: int, chunk_len: int, trip_bucket: Column,
                      negative: str = "Non-Event", per_positive: int = 2, min_speed: float = 2.0) -> DataFrame:
    """Extra negatives: clear of every event, moving, and no more than needed for ``per_positive`` : 1.

    Candidates are taken in trip and attempt order until the quota is met.
    """
    counts = labelled.agg(F.count_if(F.col(label) != negative), F.count_if(F.col(label) == negative)).first()
    needed = max(0, per_positive * counts[0] - counts[1])
    spans = samples.groupBy(key).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    spans = spans.join(labelled.select(key), key, "left_semi")
    tries = background_candidates(spans, key, "_t0", "_t1", margin, unit)
    clear = away_from_events(tries, events, key, "at", event_at, away, chunk_len)
    kept = moving(clear, samples, key, ts, "at", "attempt", half, min_speed)
    kept = kept.withColumn("_bucket", trip_bucket)
    order = ["_bucket", key, "attempt"]
    numbered = row_index(range_chunks(kept, order), Axis((), tuple(order), None), "_i").where(F.col("_i") < needed)
    return numbered.select(F.concat(F.lit("bg_"), F.col("_i")).alias("event_id"), "at", key, F.lit(negative).alias(label),
                           F.lit("auto_background").alias("source"), "speed_mean")


def undersample(df: DataFrame, label: str, negative: str, order: Sequence[str], per_anomaly: float = 1.5) -> DataFrame:
    """All anomalies and at most ``per_anomaly`` times as many negatives, in hash order."""
    anomalies = df.where(F.col(label) != negative)
    limit = int(anomalies.count() * per_anomaly)
    return anomalies.unionByName(first_by(df.where(F.col(label) == negative), order, limit))


def drop_noisy_negatives(df: DataFrame, label: str, peak: str = "peak_mag", crest: str = "crest_factor",
                         snr: str = "snr_vertical") -> DataFrame:
    # Noise bounds of a clean negative.
    noisy = (F.col(peak) > 30.0) | (F.col(crest) > 4.0) | (F.col(snr) > 20.0)
    return df.where(~((F.col(label) == "Non-Event") & F.coalesce(noisy, F.lit(False))))


def neighbours(df: DataFrame, ident: str, vector: str, k: int, pivots: int = 64, part: int = 4096,
               seed: int = 42) -> DataFrame:
    """The ``k`` nearest other rows of each row, exactly: (ident, rank, other, distance), equal distances by ``other``.

    Rows belong to the nearest of up to ``pivots`` rows. The sizes and radii of these cells
    bound how far a row's k-th neighbour can be, and by the triangle inequality the row is
    compared only with cells that reach into that distance. Cells are read in parts of
    about ``part`` rows, so a dense one is many tasks. ``ident`` must be unique.
    """
    rows = df.select(ident, vector)
    chosen = rows.orderBy(seeded_key(seed, F.col(ident)), ident).limit(pivots).select(vector).collect()
    ident_type = rows.schema[ident].dataType
    near = T.StructType([T.StructField(ident, ident_type), T.StructField("other", ident_type), T.StructField("distance", T.DoubleType())])
    if len(chosen) < 2:
        return rows.sparkSession.createDataFrame([], T.StructType([*near.fields, T.StructField("rank", T.IntegerType())]))
    centres = np.array([r[0] for r in chosen], float)
    kind = f"{ident} {ident_type.simpleString()}, {vector} array<double>, cell int, away array<double>"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(float)
                away = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)
                yield batch.assign(cell=away.argmin(axis=1).astype("int32"), away=list(away))

    placed = materialize(rows.select(ident, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(place, kind))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.get("away", F.col("cell"))).alias("radius"))
    cells = sorted(tuple(r) for r in cells.collect())  # one row per pivot
    ids, size, radius = (np.array(c) for c in zip(*cells))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that can hold one of a row's k nearest."""
        for batch in batches:
            if len(batch):
                away = np.stack(batch["away"].to_numpy())
                far = away + radius
                order = np.argsort(far, axis=1, kind="stable")
                enough = (np.cumsum(size[order], axis=1) > k).argmax(axis=1)  # all of them, if none is
                enough = np.where(size.sum() > k, enough, len(size) - 1)
                bound = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough]
                fits = away - radius <= (bound * (1 + 1e-9))[:, None]
                yield batch[[ident, vector]].assign(reach=[ids[row].astype("int32") for row in fits])

    asked = placed.withColumn("away", F.array(*[F.get("away", F.lit(int(c))) for c in ids])).mapInPandas(
        reach, f"{ident} {ident_type.simpleString()}, {vector} array<double>, reach array<int>")
    asked = asked.select(ident, vector, F.explode("reach").alias("cell"))
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for c, n in zip(ids, -(-size // part)) for x in (c, n)]), F.col("cell"))
    blocks = int(-(-size.sum() // part))
    hashed = F.xxhash64(ident)
    left = placed.select(ident, vector, "cell", F.pmod(hashed, parts).cast("int").alias("part"), F.explode(F.sequence(
        F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select(ident, vector, "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                         F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"))

    def compare(held: pd.DataFrame, seekers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(seekers):
            x, ids = np.stack(held[vector].to_numpy()), held[ident].to_numpy()
            seek = np.stack(seekers[vector].to_numpy())
            codes = pd.factorize(np.concatenate([ids, seekers[ident].to_numpy()]))[0]
            held_code, seek_code = codes[:len(ids)], codes[len(ids):]
            least = min(k, len(x)) - 1
            square, rows_at_once = (x * x).sum(axis=1), max(1, (1 << 21) // len(x))
            for start in range(0, len(seek), rows_at_once):
                q = seek[start:start + rows_at_once]
                own = seek_code[start:start + rows_at_once, None] == held_code  # a row is no neighbour of its own id
                size = (q * q).sum(axis=1)
                # products tell which rows may be among the nearest, whatever they round; these get the exact distance
                rough = square - 2 * (q @ x.T) + size[:, None]
                slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (size + square.max())
                rough[own] = np.inf
                bound = np.partition(rough, least, axis=1)[:, least] + slack
                one, other = np.nonzero(~(rough > bound[:, None]))
                d = np.sqrt(((x[other] - q[one]) ** 2).sum(axis=1))
                good = np.isfinite(d) & ~own[one, other]
                one, other, d = one[good], other[good], d[good]
                order = np.lexsort((ids[other], d, one))
                one, other, d = one[order], other[order], d[order]
                first = np.arange(len(one)) - np.searchsorted(one, one) < k
                out.append(pd.DataFrame({ident: seekers[ident].to_numpy()[start + one[first]], "other": ids[other[first]], "distance": d[first]}))
        return pd.concat(out) if out else pd.DataFrame({ident: held[ident][:0], "other": held[ident][:0], "distance": np.zeros(0)})

    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, near)
    best = Window.partitionBy(ident).orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def smote(df: DataFrame, ident: str, label: str, vector: str, seed: int = 42, max_k: int = 5) -> DataFrame:
    """Synthetic minority rows between a row and one of its exact neighbours, up to the largest class.

    Every row gets equally many, the first in hash order one more. Without at least two
    rows in every class the input comes back unchanged.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row per class
    base = df.select(F.col(ident).cast("string").alias(ident), label, vector, F.lit(False).alias("synthetic"))
    if not counts or min(counts.values()) < 2:
        return base
    k, top = min(max_k, min(counts.values()) - 1), max(counts.values())
    out = base
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        if n == top:
            continue
        rows = df.where(F.col(label) == F.lit(value)).select(ident, vector)
        per_row, extra = divmod(top - n, n)
        hashed = rows.withColumn("_h", seeded_key(seed, F.col(ident)))
        more = first_by(hashed.select(ident, "_h"), ["_h", ident], extra).select(ident, F.lit(1).alias("_more"))
        copies = F.lit(per_row) + F.coalesce("_more", F.lit(0))
        wanted = rows.join(more, ident, "left").where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        wanted = wanted.withColumn("rank", (F.floor(seeded_unit(seed + 1, F.col(ident), F.col("_copy")) * k) + 1).cast("int"))
        wanted = wanted.withColumn("_u", seeded_unit(seed + 2, F.col(ident), F.col("_copy"))).drop("_more")
        near = neighbours(rows, ident, vector, k, seed=seed).select(ident, "rank", "other")
        others = rows.select(F.col(ident).alias("other"), F.col(vector).alias("_v"))
        made = wanted.join(near, [ident, "rank"]).join(others, "other")

        def between(u: Column, a: Column, b: Column) -> Column:
            return F.zip_with(a, b, lambda x, y: x + u * (y - x))

        out = out.unionByName(made.select(
            F.concat_ws("_", F.lit("syn"), F.col(ident), F.col("_copy")).alias(ident), F.lit(value).alias(label),
            between(F.col("_u"), F.col(vector), F.col("_v")).alias(vector), F.lit(True).alias("synthetic")))
    return out


def _draws(ident: str, seed: int, name: str, *counters: Column, at: int = 1) -> Column:
    """A number in [0, 1) for a row, a purpose and counters: 13 hex digits of one hash from the place ``at`` on."""
    key = F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(name), *[c.cast("string") for c in counters], F.lit(str(seed))))
    return F.conv(F.substring(key, at, 13), 16, 10).cast("double") / float(1 << 52)


def augment(df: DataFrame, ident: str, channels: Sequence[str], length: int, seed: int = 42, noise: float = 0.02,
            scale: tuple[float, float] = (0.85, 1.15), warp_prob: float = 0.8, warp: float = 0.1,
            drop_prob: float = 0.1, knots: int = 4) -> DataFrame:
    """Random crop, time warp, noise, per-channel scale, channel drop of windows (arrays).

    Every draw is a hash of the row's id, its purpose and a counter (knot, channel, sample), so reruns and other engines
    make the same ones, and all steps are column expressions. Windows shorter than ``length`` are an error.
    """
    size = F.size(channels[0])
    short = F.raise_error(F.concat(F.lit("window of "), size.cast("string"), F.lit(f" rows is shorter than {length}")))
    start = F.when(size < length, short.cast("int")).otherwise(
        F.floor(_draws(ident, seed, "crop") * (size - length + 1)).cast("int"))
    offsets = F.array(F.lit(0.0), *[(_draws(ident, seed, "knot", F.lit(k)) * 2 - 1) * (warp * length) for k in range(1, knots + 1)], F.lit(0.0))
    cut = df.withColumns({"_start": start, "_off": offsets, "_warped": _draws(ident, seed, "warp") < warp_prob,
                          "_dropped": F.when(_draws(ident, seed, "drop") < drop_prob, F.floor(_draws(ident, seed, "dropped") * len(channels)))})

    def source(j: Column) -> Column:
        """Where a sample comes from: the knots' offsets, interpolated."""
        place = j * (knots + 1) / float(max(1, length - 1))
        left = F.least(F.lit(knots), F.floor(place)).cast("int")
        low, high = F.get("_off", left), F.get("_off", left + 1)
        moved = F.greatest(F.lit(0.0), F.least(F.lit(float(length - 1)), j + low + (place - left) * (high - low)))
        return F.when(F.col("_warped"), moved).otherwise(j.cast("double"))

    def sampled(c: int, name: str) -> Column:
        x = F.slice(F.col(name).cast("array<double>"), F.col("_start") + 1, length)
        gain = F.lit(scale[0]) + _draws(ident, seed, "scale", F.lit(c)) * (scale[1] - scale[0])

        def value(j: Column) -> Column:
            src = F.get("_src", j)
            low = F.floor(src).cast("int")
            a, b = F.get(f"_x{c}", low), F.get(f"_x{c}", F.least(low + 1, F.lit(length - 1)))
            u, v = (_draws(ident, seed, "noise", F.lit(c), j, at=at) for at in (1, 17))
            normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(math.pi) * v)
            return F.when(F.col("_dropped") == c, F.lit(0.0)).otherwise((a + (src - low) * (b - a) + noise * normal) * F.col(f"_gain{c}"))

        steps[f"_x{c}"], steps[f"_gain{c}"] = x, gain
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), value)

    steps = {"_src": F.transform(F.sequence(F.lit(0), F.lit(length - 1)), source)}
    made = {name: sampled(c, name) for c, name in enumerate(channels)}
    done = cut.withColumns(steps).withColumns({f"_made_{name}": value for name, value in made.items()})
    return done.select(*[F.col(f"_made_{c}").alias(c) if c in channels else F.col(c) for c in df.columns])
