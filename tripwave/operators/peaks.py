"""Abnormal-motion detection: energy, adaptive thresholds, regions, peaks, clusters, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripwave.functions.exprs import haversine, holds, severity_level, to_g
from tripwave.operators.ordered import Axis, block_start, islands, join_per_key, materialize, row_index, with_blocks
from tripwave.operators.timeseries import MAX_SPAN, ema, sample_rate
from tripwave.params import Clustering, Detection


def adaptive_energy(df: DataFrame, ax: Axis, signal: str, gyro: str | None, p: Detection = Detection(),
                    block_rows: int = 50_000, numbered: bool = False, min_dist: DataFrame | None = None) -> DataFrame:
    """Trailing energy, EMA thresholds, the active flag and the in-region flag of every row.

    One exchange: the stream is cut into equal row blocks with enough warm-up for
    the chained averages, and all windows share the block's order. Blocks are kept
    short enough for the weights of the averages. ``min_dist`` gives trips a peak distance
    in rows of their own (keys and ``min_dist``); the others go by ``p.min_dist_rows``.
    """
    rows = df if numbered else row_index(df, ax)
    longest, apart = p.min_dist_rows, F.lit(p.min_dist_rows)
    if min_dist is not None:
        longest = max(longest, min_dist.agg(F.max("min_dist")).first()[0] or 0)
        rows = join_per_key(rows, min_dist.select(*ax.keys, F.col("min_dist").alias("_apart")), ax.keys, ["idx"], "left")
        apart = F.coalesce("_apart", apart)
    warm = int(45 / p.alpha) + p.window_rows
    size = max(1, min(block_rows, int(MAX_SPAN / p.alpha) - warm - longest))
    blocks = with_blocks(rows, "idx", size, before=warm, after=longest)
    w = Window.partitionBy(*ax.keys, "_block").orderBy("idx")
    tail = w.rowsBetween(-(p.window_rows - 1), 0)
    out = blocks.withColumn("_start", block_start(size, warm))
    start, idx = F.col("_start"), F.col("idx")
    out = out.withColumn("energy", F.coalesce(F.stddev_samp(signal).over(tail), F.lit(0.0)))
    out = out.withColumn("baseline", ema(F.col("energy"), idx, start, p.alpha, w))
    out = out.withColumn("_dev", F.abs(F.col("energy") - F.col("baseline")))
    out = out.withColumn("threshold", F.col("baseline") + p.multiplier * ema(F.col("_dev"), idx, start, p.alpha, w))
    active = F.col("energy") > F.col("threshold")
    if gyro:
        out = out.withColumn("gyro_energy_now", F.coalesce(F.avg(F.coalesce(F.col(gyro), F.lit(0.0))).over(tail), F.lit(0.0)))
        out = out.withColumn("_gbase", ema(F.col("gyro_energy_now"), idx, start, p.alpha, w))
        out = out.withColumn("_gdev", F.abs(F.col("gyro_energy_now") - F.col("_gbase")))
        out = out.withColumn("gyro_threshold",
                             F.col("_gbase") + p.multiplier * ema(F.col("_gdev"), idx, start, p.alpha, w))
        active = (active | (F.col("gyro_energy_now") > F.col("gyro_threshold"))
                  | (F.col("gyro_energy_now") > p.gyro_trigger))
    out = out.withColumn("active", holds(active))
    mark = F.when(F.col("active"), idx)
    out = out.withColumn("_last", F.max(mark).over(w.rowsBetween(-longest, 0)))
    out = out.withColumn("_next", F.min(mark).over(w.rowsBetween(0, longest)))
    out = out.withColumn("in_region", holds(F.col("_next") - F.col("_last") <= apart))
    return out.where("_own").drop("_own", "_block", "_start", "_dev", "_gbase", "_gdev", "_last", "_next", "_apart")


def regions(energy: DataFrame, ax: Axis) -> DataFrame:
    """Rows of active regions, inactive rows between close active ones included, with the region's start index.

    The region rows, a small part of the samples, are written once so that the
    two passes over them do not repeat the threshold windows.
    """
    inside = materialize(energy.where("in_region"))
    numbered = Axis(ax.keys, ("idx",), 50_000)
    runs = islands(inside, numbered, ["idx"], lambda now, before: now["idx"] - before["idx"] > 1, "_region")
    return runs.withColumn("region", F.col("_region.idx")).drop("_region")


def region_peaks(region_rows: DataFrame, ax: Axis, signal: str, keep: list[str]) -> DataFrame:
    """The first row with the largest absolute signal in each region; partially aggregated."""
    best = F.struct(F.abs(F.col(signal)), -F.col("idx"))
    found = region_rows.groupBy(*ax.keys, "region").agg(
        F.max_by(F.struct("idx", *keep), best).alias("_peak"),
        F.max("idx").alias("region_end"))
    return found.select(*ax.keys, "region", "region_end", "_peak.*")


def detect_peaks(df: DataFrame, ax: Axis, signal: str, gyro: str | None, keep: list[str],
                 p: Detection = Detection(), block_rows: int = 50_000, min_dist: DataFrame | None = None) -> DataFrame:
    """Region peaks of every trip with at least three rows, with the row energy and threshold.

    ``min_dist`` as in ``adaptive_energy``.
    """
    energy = adaptive_energy(df, ax, signal, gyro, p, block_rows, min_dist=min_dist)
    return _peaks(energy, df, ax, signal, keep)


def _peaks(energy: DataFrame, df: DataFrame, ax: Axis, signal: str, keep: list[str]) -> DataFrame:
    rows = regions(energy, ax)
    found = region_peaks(rows, ax, signal, [*keep, "energy", "threshold"])
    lengths = df.groupBy(*ax.keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    return join_per_key(found, lengths.select(*ax.keys), ax.keys, ["region"], "left_semi")


def detect_peaks_by_rate(df: DataFrame, ax: Axis, signal: str, gyro: str | None, keep: list[str], per_second: float,
                         p: Detection = Detection(), block_rows: int = 50_000) -> DataFrame:
    """``detect_peaks`` with each trip's peak distance from its own sample rate, its ``hz`` and ``min_dist``, and the trip's
    mean thresholds on every peak.

    ``per_second`` is the number of time units in a second. Trips of several rates may share a table.
    """
    rates = materialize(sample_rate(df, ax, per_second, p.min_dist_s, p.fallback_hz).select(*ax.keys, "hz", "min_dist"))
    energy = materialize(adaptive_energy(df, ax, signal, gyro, p, block_rows, min_dist=rates))
    found = _peaks(energy, df, ax, signal, keep)
    per_trip = rates.join(thresholds_per_trip(energy, ax), [*ax.keys], "left")
    return join_per_key(found, per_trip, ax.keys, ["region"])


def thresholds_per_trip(energy: DataFrame, ax: Axis) -> DataFrame:
    cols = [c for c in ("threshold", "gyro_threshold") if c in energy.columns]
    return energy.groupBy(*ax.keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def cluster_peaks(peaks: DataFrame, ax: Axis, lat: str = "lat", lon: str = "lon",
                  p: Clustering = Clustering()) -> DataFrame:
    """Adds ``cluster``, the start time of the chain of peaks close in time and space to the one before."""
    ts = ax.order[0]

    def far(now, before):
        near_t = now[ts] - before[ts] <= p.max_dt
        near_x = haversine(before[lat], before[lon], now[lat], now[lon]) <= p.max_dist_m
        return ~holds(near_t & near_x)

    return islands(peaks, ax, [ts, lat, lon], far, "cluster")


def cluster_events(clustered: DataFrame, ax: Axis) -> DataFrame:
    """One candidate event per cluster; the first largest vertical peak gives time and place."""
    ts = ax.order[0]
    strongest = F.struct(F.abs(F.col("peak_vertical")), *[-F.col(c) for c in ax.order])
    events = clustered.groupBy(*ax.keys, "cluster").agg(
        F.max_by(F.struct(ts, "lat", "lon", "peak_vertical"), strongest).alias("_top"),
        F.max("peak_mag").alias("peak_mag"),
        F.max("peak_gyro_mag").alias("peak_gyro_mag"),
        F.avg("peak_speed").alias("speed_mean"),
        F.count(F.lit(1)).alias("n_peaks"),
    )
    events = events.select(*ax.keys, "cluster", "_top.*", "peak_mag", "peak_gyro_mag", "speed_mean", "n_peaks")
    events = events.withColumn("peak_mag_g", to_g(F.col("peak_mag")))
    events = events.withColumn("peak_vertical_g", to_g(F.col("peak_vertical")))
    return events.withColumn("level", severity_level(F.col("peak_vertical_g"), F.col("peak_gyro_mag")))


def number_events(events: DataFrame, trip_bucket, ax: Axis, start: int = 0, out: str = "event_id") -> DataFrame:
    """Consecutive ids over all trips in trip order, then time order.

    ``trip_bucket`` is a monotone coarsening of the trip key: ids need trip
    totals, bucket totals and in-trip numbers, never one task over all events.
    The events, few against the samples they come from, are written once.
    """
    key = ax.keys[0]
    events = materialize(events)
    numbered = row_index(events, ax, "_in_trip")
    trips = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", trip_bucket)
    in_bucket = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    trips = trips.withColumn("_before", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
    totals = trips.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_base"))
    offsets = trips.join(totals, "_bucket").select(key, (F.col("_before") + F.col("_base")).alias("_offset"))
    done = join_per_key(numbered, offsets, [key], ax.order)
    return done.withColumn(out, F.col("_in_trip") + F.col("_offset") + start).drop("_in_trip", "_offset")
