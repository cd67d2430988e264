"""Stage compositions: samples to scored candidates, labelled feature rows, and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripwave.functions.exprs import score_events
from tripwave.operators import timeseries
from tripwave.operators.features import event_features
from tripwave.operators.fusion import native_fusion
from tripwave.operators.labels import suggest_labels
from tripwave.operators.ordered import Axis, join_per_key, materialize
from tripwave.operators.peaks import cluster_events, cluster_peaks, detect_peaks, number_events
from tripwave.operators.reconcile import near_gap, union_background
from tripwave.operators.windows import event_tensors, in_segments, skipped_tensors, window_features
from tripwave.params import Clustering, Detection, EventWindow, Resampling, Tensor


def peak_rows(samples: DataFrame, ax: Axis, signal: str, gyro: str, p: Detection, block_rows: int = 50_000) -> DataFrame:
    """Detected peaks with the columns the clusterer needs."""
    keep = list(dict.fromkeys([*ax.order, "lat", "lon", signal, "a_vertical", "magnitude", gyro, "speed"]))
    found = detect_peaks(samples, ax, signal, gyro, keep, p, block_rows)
    return found.select(
        *ax.keys, *ax.order, "lat", "lon", F.col("a_vertical").alias("peak_vertical"),
        F.col("magnitude").alias("peak_mag"), F.col(gyro).cast("double").alias("peak_gyro_mag"),
        F.col("speed").alias("peak_speed"))


def scored_candidates(samples: DataFrame, ax: Axis, signal: str = "a_linear_mag", gyro: str = "gyro_mag",
                      detection: Detection = Detection(), clustering: Clustering = Clustering(),
                      window: EventWindow = EventWindow(), trip_bucket: Column | None = None) -> DataFrame:
    """Fused samples to numbered, suggested and scored candidate events.

    The few peaks and events are written once each; clustering, features and scores
    read those tables instead of repeating the detection.
    """
    key, ts = ax.keys[0], ax.order[0]
    found = materialize(peak_rows(samples, ax, signal, gyro, detection))
    events = cluster_events(cluster_peaks(found, ax, p=clustering), ax)
    bucket = trip_bucket if trip_bucket is not None else F.substring(key, 1, 2)
    events = number_events(events.drop("cluster"), bucket, Axis(ax.keys, (ts,), ax.chunk_len), out="candidate_id")
    events = events.withColumn("at", F.col(ts)).drop(ts)
    rows = event_features(samples, events, ax, "candidate_id", "at", window)
    rows = rows.withColumn("event_duration", F.col("duration_above_threshold")).withColumn("vert_jrk", F.col("max_jerk"))
    return score_events(suggest_labels(rows))


def trip_candidates(raw: DataFrame, ax: Axis, numeric: list[str], p: Resampling = Resampling()) -> tuple[DataFrame, DataFrame]:
    """Raw trips to (scored candidates, sliding-window features); invalid trips are left out whole."""
    key, ts = ax.keys[0], ax.order[0]
    unique = timeseries.dedupe_samples(raw, key, ts, "file_pos") if "file_pos" in raw.columns else raw
    unique = materialize(unique)  # text files are parsed once, the guards below read single columns
    gaps = timeseries.gap_quarantine(unique, ax, p.max_gap)
    nulls = timeseries.null_ratio_guard(
        unique, key, ["lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z"], p.max_null_ratio)
    rejected = gaps.where("rejected").select(key).unionByName(nulls.where("rejected").select(key))
    valid = join_per_key(unique, rejected, [key], [ts], "left_anti")
    fused = native_fusion(valid, ax, numeric, p=p)
    short = timeseries.min_length_guard(fused, key, p.min_rows).where("too_short").select(key)
    fused = join_per_key(fused, short, [key], [ts], "left_anti")
    fused = materialize(fused.withColumn("gyro_mag", F.sqrt(sum(
        (F.coalesce(c, F.lit(0.0)) ** 2 for c in ("gx", "gy", "gz")), F.lit(0.0)))))
    grid = Axis(ax.keys, (ts,), ax.chunk_len)
    return scored_candidates(fused, grid), window_features(fused, grid, 2_000, 1_000)


def labelled_feature_rows(raw: DataFrame, events: DataFrame, truth: DataFrame, background: DataFrame | None, ax: Axis,
                          numeric: list[str], p: Resampling = Resampling(), compat_snr: bool = False,
                          window: EventWindow = EventWindow()) -> DataFrame:
    """Labelled events and background rows with features re-extracted from fused segments.

    Samples are cut at recording holes; only segments holding a labelled event are fused.
    """
    key, ts = ax.keys[0], ax.order[0]
    labelled = events.join(truth.select("event_id", "label"), "event_id")
    if background is not None:
        labelled = union_background(labelled, background)
    cut = materialize(timeseries.segments(raw, ax, p.max_gap))
    bounds = timeseries.segment_bounds(cut, key, ts)
    placed = materialize(in_segments(labelled, bounds, key, "at", ax.chunk_len).where(F.col("segment").isNotNull()))
    wanted = join_per_key(cut, placed.select(key, "segment").distinct(), [key, "segment"], [ts], "left_semi")
    by_segment = Axis((key, "segment"), ax.order, ax.chunk_len)
    # written: the features read their samples twice, and one plan of filters and features holds the driver's memory
    fused = materialize(native_fusion(wanted, by_segment, numeric, p=p))
    one_key = fused.withColumn("_stream", F.concat_ws("#", key, "segment"))
    rows = placed.withColumn("_stream", F.concat_ws("#", key, "segment")).drop("segment", "segment_rows")
    return event_features(one_key, rows, Axis(("_stream",), (ts,), ax.chunk_len), p=window,
                          compat_snr=compat_snr).drop("_stream")


def tensor_set(raw: DataFrame, labelled: DataFrame, ax: Axis, p: Resampling = Resampling(),
               t: Tensor = Tensor()) -> tuple[DataFrame, DataFrame]:
    """(event tensors, skipped events with reasons) from resampled recordings, split at holes."""
    key, ts = ax.keys[0], ax.order[0]
    cut = materialize(timeseries.segments(raw, ax, p.max_gap))
    grid = materialize(timeseries.resample(cut, (key, "segment"), ts, list(t.channels), ["ax", "ay", "az"], ax.chunk_len, p=p))
    bounds = timeseries.segment_bounds(cut, key, ts).drop("segment_rows")
    sizes = grid.groupBy(key, "segment").agg(F.count(F.lit(1)).alias("segment_rows"))
    bounds = bounds.join(sizes, [key, "segment"], "left").na.fill(0, ["segment_rows"])
    placed = materialize(in_segments(labelled, bounds, key, "at", ax.chunk_len))
    gapped = near_gap(labelled, timeseries.large_gaps(cut, ax, p.max_gap), ax, "at", t.half + t.gap_guard)
    usable = placed.where(F.col("segment_rows") >= t.rows).join(gapped.select("event_id"), "event_id", "left_anti")
    stream = F.concat_ws("#", key, "segment")
    tensors = event_tensors(grid.withColumn("_stream", stream), usable.withColumn("_stream", stream),
                            "_stream", ts, "event_id", "at", t, ax.chunk_len)
    done = tensors.drop("_stream").join(labelled, "event_id")
    return done, skipped_tensors(labelled, tensors, placed, gapped, "event_id", t)
