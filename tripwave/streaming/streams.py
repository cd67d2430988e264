"""Causal operators on Structured Streaming.

Rows of a trip are taken in event-time order within each micro-batch; rows older
than the last one already processed for their trip are dropped, as are rows
beyond the watermark. On ordered input the results equal the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tripwave.functions.exprs import gravity_projection
from tripwave.functions.recurrence import CausalFilter, lowpass
from tripwave.operators.fusion import cooldown_walk
from tripwave.params import BANDPASS_A, BANDPASS_B, EARTH_RADIUS_M, Clustering, Detection
from tripwave.sources.stage import new_folder


def ingest(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def unique_samples(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """One row per (trip, event time) within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key, at])


def sliding_features(stream: DataFrame, key: str, at: str, delay: str, size: str, hop: str) -> DataFrame:
    """Epoch-aligned sliding-window features; a window is emitted once, when the watermark passes its end."""
    base = stream.withColumn("_g", F.sqrt(sum((F.coalesce(c, F.lit(0.0)) ** 2 for c in ("gx", "gy", "gz")), F.lit(0.0))))

    def rms(c: str) -> Column:
        return F.sqrt(F.avg(F.col(c) * F.col(c)))

    def step(c: str) -> Column:
        # The rows of one window: bounded by its length.
        rows = F.array_sort(F.collect_list(F.struct(at, c)))
        later = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        gaps = F.zip_with(later, rows, lambda b, a: F.abs(b[c] - a[c]))
        return F.try_divide(F.aggregate(F.slice(gaps, 1, F.greatest(F.size(rows) - 1, F.lit(1))), F.lit(0.0),
                                        lambda acc, x: acc + F.coalesce(x, F.lit(0.0))), F.size(rows) - 1)

    windows = base.withWatermark(at, delay).groupBy(key, F.window(at, size, hop).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("mag_mean"), F.stddev_pop("magnitude").alias("mag_std"),
        F.max("magnitude").alias("mag_max"), rms("magnitude").alias("mag_rms"), step("magnitude").alias("mag_jrk"),
        F.avg("a_vertical").alias("vert_mean"), F.stddev_pop("a_vertical").alias("vert_std"),
        F.max("a_vertical").alias("vert_max"), F.min("a_vertical").alias("vert_min"), rms("a_vertical").alias("vert_rms"),
        F.avg("lat").alias("lat_mean"), F.avg("lon").alias("lon_mean"), F.avg("speed").alias("speed_mean"),
        F.avg("_g").alias("gyro_mag_mean"), F.max("_g").alias("gyro_mag_max"), step("_g").alias("gyro_mag_jrk"),
        *[F.stddev_pop(F.coalesce(f"g{c}", F.lit(0.0))).alias(f"gyro_{c}_std") for c in "xyz"])
    out = windows.where("n >= 3")
    return out.select(key, F.unix_micros("_w.start").alias("window_start"), F.unix_micros("_w.end").alias("window_end"),
                      *[c for c in out.columns if c not in (key, "_w", "n")])


def sessions(stream: DataFrame, key: str, at: str, delay: str, gap: str) -> DataFrame:
    """Contiguous recordings: rows closer than ``gap`` belong together."""
    parts = stream.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("_s")).agg(
        F.count(F.lit(1)).alias("segment_rows"), F.max(at).alias("_end"))
    return parts.select(key, F.unix_micros("_s.start").alias("segment"), F.unix_micros("_end").alias("segment_end"), "segment_rows")


def _ordered(batches: Iterator[pd.DataFrame], order: list[str], after: float | None) -> pd.DataFrame:
    rows = pd.concat(list(batches)).sort_values(order)
    return rows if after is None else rows[rows[order[0]] > after]


def cooldown(stream: DataFrame, key: str, order: list[str], prob: str, threshold: float, quiet: int, at: str | None = None,
             delay: str | None = None, units_per_ms: int = 1) -> DataFrame:
    """First-trigger cooldown; the state of a trip is the time of its last trigger.

    With an event-time column ``at`` and a watermark ``delay`` the state is freed once the watermark is past the cooldown,
    when it can hold back no row any more. ``units_per_ms`` are the units of ``quiet`` and ``order[0]``.
    """
    cols = [key, *order, prob]
    schema = T.StructType([stream.schema[c] for c in cols])

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        times = rows[order[0]].to_numpy()
        first = int(np.searchsorted(times, state.get[0] + quiet, side="right")) if state.exists else 0
        picked = cooldown_walk(times, first, quiet)
        if picked:
            state.update((int(times[picked[-1]]),))
        if at is not None:
            newest = rows[at].max().value // 1_000_000
            state.setTimeoutTimestamp(max(int(newest), state.getCurrentWatermarkMs()) + quiet // units_per_ms + 1)
        yield rows.iloc[picked][cols]

    hot = stream.where(F.col(prob) >= threshold)
    hot = hot.select(*cols) if at is None else hot.withWatermark(at, delay).select(*cols, at)
    timeout = GroupStateTimeout.NoTimeout if at is None else GroupStateTimeout.EventTimeTimeout
    return hot.groupBy(key).applyInPandasWithState(step, schema, "last bigint", "append", timeout)


def causal_filters(stream: DataFrame, key: str, order: list[str], value: str, cutoff_hz: float = 20.0,
                   sample_hz: float = 100.0) -> DataFrame:
    """Band-passed and low-passed value; a trip's state is four and two filter cells and its last time."""
    cols = [key, *order, value]
    schema = T.StructType([*[stream.schema[c] for c in cols], T.StructField("bandpass", T.DoubleType()), T.StructField("lowpass", T.DoubleType())])
    low, high = lowpass(cutoff_hz, sample_hz), CausalFilter(BANDPASS_B, BANDPASS_A)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, band, smooth = state.get if state.exists else (None, [0.0] * 4, None)
        rows = _ordered(batches, order, last)
        if len(rows):
            x = rows[value].to_numpy(float)
            rows["bandpass"], band = high.run(x, np.array(band))
            if low is None:
                rows["lowpass"], smooth = x, np.zeros(2)
            else:
                rows["lowpass"], smooth = low.run(x, low.steady() * x[0] if smooth is None else np.array(smooth))
            state.update((int(rows[order[0]].iloc[-1]), band.tolist(), smooth.tolist()))
        yield rows[schema.names]

    return stream.select(*cols).groupBy(key).applyInPandasWithState(
        step, schema, "last bigint, band array<double>, smooth array<double>", "append", GroupStateTimeout.NoTimeout)


class Fusion(StatefulProcessor):
    """The online detector up to its thresholds, for one trip at a time.

    State: the last ``window_rows`` signal and gyroscope values as a list, and one value with the last time, the cells
    of the two filters and of the four averages. A trip that gets no rows for ``ttl_ms`` is forgotten.
    """

    RING = "signal double, gyro double"
    CELLS = "last bigint, band array<double>, smooth array<double>, averages array<double>"

    def __init__(self, key: str, order: list[str], gyro: str, p: Detection, low: CausalFilter | None, ttl_ms: int | None) -> None:
        self.key, self.order, self.gyro, self.p, self.ttl = key, order, gyro, p, ttl_ms
        self.low, self.high = low, CausalFilter(BANDPASS_B, BANDPASS_A)
        self.average = CausalFilter([p.alpha, 0.0], [1.0, p.alpha - 1.0])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.RING, self.ttl)
        self.cells = handle.getValueState("cells", self.CELLS, self.ttl)

    def _smoothed(self, x: np.ndarray, cell: float | None, first: float) -> tuple[np.ndarray, float]:
        """Moving average from its cell; a new one starts so that the first value is ``first``."""
        start = (1 - self.p.alpha) * x[0] + first - x[0] if cell is None else cell
        y, end = self.average.run(x, np.array([start]))
        return y, float(end[0])

    def _trailing(self, past: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The last ``window_rows`` values at each row; unknown before the first row."""
        n = self.p.window_rows
        padded = np.concatenate([np.full(n - 1 - len(past), np.nan), past, x])
        return np.lib.stride_tricks.sliding_window_view(padded, n)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        p = self.p
        last, band, smooth, averages = self.cells.get() if self.cells.exists() else (None, [0.0] * 4, None, [None] * 4)
        rows = _ordered(rows, self.order, last)
        if not len(rows):
            return
        vertical, band = self.high.run(rows["raw_vertical"].to_numpy(float), np.array(band))
        flat = rows["raw_horizontal"].to_numpy(float)
        if self.low is None:
            horizontal, smooth = flat, np.zeros(2)
        else:
            horizontal, smooth = self.low.run(flat, self.low.steady() * flat[0] if smooth is None else np.array(smooth))
        past = np.array([tuple(r) for r in self.ring.get()] if self.ring.exists() else [], float).reshape(-1, 2)
        turn = np.nan_to_num(rows[self.gyro].to_numpy(float))
        near = self._trailing(past[:, 0], vertical)
        known = np.isfinite(near)
        n = known.sum(axis=1)
        off = np.where(known, near - (np.where(known, near, 0.0).sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
        energy = np.where(n > 1, np.sqrt((off * off).sum(axis=1) / np.maximum(n - 1, 1)), 0.0)
        gyro = np.nanmean(self._trailing(past[:, 1], turn), axis=1)
        base, averages_0 = self._smoothed(energy, averages[0], energy[0])
        dev, averages_1 = self._smoothed(np.abs(energy - base), averages[1], 0.0)
        gyro_base, averages_2 = self._smoothed(gyro, averages[2], gyro[0])
        gyro_dev, averages_3 = self._smoothed(np.abs(gyro - gyro_base), averages[3], 0.0)
        threshold, gyro_threshold = base + p.multiplier * dev, gyro_base + p.multiplier * gyro_dev
        self.cells.update((int(rows[self.order[0]].iloc[-1]), band.tolist(), smooth.tolist(), [averages_0, averages_1, averages_2, averages_3]))
        kept = np.concatenate([past, np.column_stack([vertical, turn])])[1 - p.window_rows:]
        self.ring.put([tuple(r) for r in kept.tolist()])
        yield rows[[self.key, *self.order]].assign(
            a_vertical=vertical, a_horizontal=horizontal, a_linear_mag=np.sqrt(vertical ** 2 + horizontal ** 2), energy=energy, threshold=threshold,
            gyro_energy_now=gyro, gyro_threshold=gyro_threshold,
            active=(energy > threshold) | (gyro > gyro_threshold) | (gyro > p.gyro_trigger))

    def close(self) -> None:
        pass


def fused_thresholds(stream: DataFrame, key: str, order: list[str], gyro: str, p: Detection = Detection(), cutoff_hz: float = 20.0,
                     sample_hz: float = 100.0, ttl_ms: int | None = 6 * 3_600_000) -> DataFrame:
    """Raw samples in; filtered vertical and horizontal acceleration, energy, thresholds and the active flag out.

    One stage of the online detector with its state per trip, freed ``ttl_ms`` after the trip's last rows (None: never). Equal to
    ``fusion.causal_filters`` and ``peaks.adaptive_energy`` over ordered input, whatever the micro-batches. Needs the RocksDB
    state store (see ``drain``).
    """
    lin, grav = (tuple(F.col(f"{c}{a}") for a in "xyz") for c in ("lin_a", "grav_"))
    vertical, horizontal = gravity_projection(lin, grav)
    rows = stream.select(key, *order, F.col(gyro).cast("double").alias(gyro), vertical.alias("raw_vertical"), horizontal.alias("raw_horizontal"))
    out = T.StructType([*[rows.schema[c] for c in (key, *order)], *[T.StructField(c, T.DoubleType()) for c in (
        "a_vertical", "a_horizontal", "a_linear_mag", "energy", "threshold", "gyro_energy_now", "gyro_threshold")],
        T.StructField("active", T.BooleanType())])
    step = Fusion(key, order, gyro, p, lowpass(cutoff_hz, sample_hz), ttl_ms)
    return rows.groupBy(key).transformWithStateInPandas(step, out, "Append", "None" if ttl_ms is None else "ProcessingTime")


def _distance_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def candidates(stream: DataFrame, key: str, at: str, order: list[str], signal: str, gyro: str, delay: str,
               p: Detection = Detection(), c: Clustering = Clustering(), idle_ms: int = 60_000) -> DataFrame:
    """Clustered peaks as they close: energy, EMA thresholds, regions and clusters carried as state per trip.

    A region closes after more than ``min_dist_rows`` inactive rows, a cluster with
    the first peak that is too late or too far, both when the trip is idle.
    """
    cols = [key, at, *order, signal, gyro, "lat", "lon", "speed"]
    out = T.StructType([stream.schema[key]] + [T.StructField(n, t) for n, t in (
        ("first", T.LongType()), ("last", T.LongType()), ("time", T.LongType()), ("lat", T.DoubleType()), ("lon", T.DoubleType()),
        ("peak_vertical", T.DoubleType()), ("peak_gyro_mag", T.DoubleType()), ("speed_sum", T.DoubleType()), ("n_peaks", T.LongType()))])
    keep, names = 1 - p.alpha, out.names[1:]
    layout = "idx bigint, last bigint, ring array<double>, gring array<double>, ema array<double>, region array<double>, cluster array<double>"

    # region: [last active idx, best |v| inside, v, time, lat, lon, gyro, speed, then the same seven for rows since the last active one]
    def better(now: list[float], best: list[float]) -> list[float]:
        return now if not best or abs(now[0]) > abs(best[0]) else best

    def join(cluster: list[float], peak: list[float], done: list[list[float]]) -> list[float]:
        v, t, lat, lon, g, speed = peak
        # cluster: [first, last, last lat, last lon, best time, best lat, best lon, best v, max gyro, speed sum, n]
        if cluster and t - cluster[1] <= c.max_dt and _distance_m(cluster[2], cluster[3], lat, lon) <= c.max_dist_m:
            first, best = cluster[0], cluster[4:8]
            best = [t, lat, lon, v] if abs(v) > abs(best[3]) else best
            return [first, t, lat, lon, *best, max(cluster[8], g), cluster[9] + speed, cluster[10] + 1]
        if cluster:
            done.append(cluster)
        return [t, t, lat, lon, t, lat, lon, v, g, speed, 1.0]

    def frame(trip: object, done: list[list[float]]) -> pd.DataFrame:
        rows = [(trip, int(x[0]), int(x[1]), int(x[4]), x[5], x[6], x[7], x[8], x[9], int(x[10])) for x in done]
        return pd.DataFrame(rows, columns=out.names)

    def step(trip: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, last, ring, gring, ema, region, cluster = state.get if state.exists else (0, None, [], [], [], [], [])
        ring, gring, ema, region, cluster = list(ring), list(gring), list(ema), list(region), list(cluster)
        done: list[list[float]] = []
        if state.hasTimedOut:
            if region and idx >= 3:
                cluster = join(cluster, region[1:7], done)
            if cluster:
                done.append(cluster)
            state.update((idx, last, ring, gring, ema, [], []))
            yield frame(trip[0], done)
            return
        rows = _ordered(batches, order, last)
        for t, v, g, lat, lon, speed in rows[[order[0], signal, gyro, "lat", "lon", "speed"]].itertuples(index=False):
            ring, gring = (ring + [float(v)])[-p.window_rows:], (gring + [float(g)])[-p.window_rows:]
            energy = float(np.std(ring, ddof=1)) if len(ring) > 1 else 0.0
            turn = float(np.mean(gring))
            if not ema:
                ema = [energy, 0.0, turn, 0.0]
            else:
                base, gbase = p.alpha * energy + keep * ema[0], p.alpha * turn + keep * ema[2]
                ema = [base, p.alpha * abs(energy - base) + keep * ema[1], gbase, p.alpha * abs(turn - gbase) + keep * ema[3]]
            active = energy > ema[0] + p.multiplier * ema[1] or turn > ema[2] + p.multiplier * ema[3] or turn > p.gyro_trigger
            if region and idx - region[0] > p.min_dist_rows:
                cluster, region = join(cluster, region[1:7], done), []
            now = [float(v), float(t), float(lat), float(lon), float(g), float(speed)]
            if active:
                inside, pending = region[1:7], region[7:]
                best = better(pending, inside) if pending else inside
                region = [float(idx), *better(now, best)]
            elif region:
                region = [*region[:7], *better(now, region[7:])]
            idx, last = idx + 1, int(t)
        state.update((idx, last, ring, gring, ema, region, cluster))
        if len(rows):
            # Event-time timeout: the trip is over once the watermark is idle_ms past its last row.
            newest = int(rows[at].max().value // 1_000_000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield frame(trip[0], done)

    return stream.withWatermark(at, delay).select(*cols).groupBy(key).applyInPandasWithState(
        step, out, layout, "append", GroupStateTimeout.EventTimeTimeout)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as list and value states need, and run no batches without data,
    which a time to live would ask for without end."""
    wanted = {STATE_STORE: ROCKS_DB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write_available(stream: DataFrame, path: str, state: str) -> None:
    """Run a stream over everything available into a file sink, going on from the checkpoint ``state`` if there is one."""
    query = (stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", path)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def drain(stream: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Run a stream over everything available into a file sink in the shared folder, and read the result."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    write_available(stream, path, new_folder(spark, f"{name}-state"))
    return spark.read.schema(schema or stream.schema).parquet(path)


def drain_batches(stream: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``foreachBatch`` sink: each batch goes to its own folder, so a retried batch replaces itself."""
    spark = stream.sparkSession
    path, state = new_folder(spark, name), new_folder(spark, f"{name}-state")

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", state).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")
