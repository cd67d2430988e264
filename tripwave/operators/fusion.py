"""Causal filters and native sensor fusion over trips of any length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tripwave.functions.exprs import gravity_projection, magnitude
from tripwave.functions.recurrence import CausalFilter, lowpass as lowpass_filter
from tripwave.operators.ordered import (CHUNK, Axis, asof, bundle_groups, bundled, join_per_key, materialize, previous,
                                        row_index, with_blocks)
from tripwave.operators.timeseries import fill_rows, resample
from tripwave.params import BANDPASS_A, BANDPASS_B, Resampling

# The slowest band-pass pole is 0.956898: 700 rows of warm-up leave less than 1e-13.
WARM_ROWS = 700


def causal_filters(df: DataFrame, ax: Axis, bandpass: dict[str, str], lowpass: dict[str, str],
                   cutoff_hz: float = 20.0, sample_hz: float = 100.0, block_rows: int = 50_000,
                   numbered: bool = False) -> DataFrame:
    """Adds band-passed and low-passed columns ({output: input}).

    Rows are cut into equal blocks with warm-up rows, so a task sees a bounded
    array whatever the trip length. Only a trip's true first row starts from the
    operator's own initial state (zero, or steady state for the low-pass).
    """
    rows = df if numbered else row_index(df, ax)
    blocks = with_blocks(rows, "idx", block_rows, before=WARM_ROWS)
    added = [*bandpass, *lowpass]
    schema = T.StructType([f for f in blocks.schema.fields]
                          + [T.StructField(c, T.DoubleType()) for c in added])
    low, band = lowpass_filter(cutoff_hz, sample_hz), CausalFilter(BANDPASS_B, BANDPASS_A)

    def run(blocks: pa.Table) -> pa.Table:
        blocks, groups = bundle_groups(blocks, group, "idx")
        for out, src in (*bandpass.items(), *lowpass.items()):
            y = blocks.column(src).to_numpy().astype(float)
            for at in groups:
                x = y[at]
                if out in bandpass:
                    y[at] = band.run(x, band.rest())[0]
                elif low is not None:
                    y[at] = low.run(x, low.steady() * x[0])[0]
            blocks = blocks.append_column(out, pa.array(y))
        return blocks.filter(blocks.column("_own")).drop_columns("_bundle")

    group = [*ax.keys, "_block"]
    done = bundled(blocks, group, df.count()).groupBy("_bundle").applyInArrow(run, schema)
    return done.drop("_own", "_block")


def native_fusion(df: DataFrame, ax: Axis, numeric: list[str], other: list[str] = [],
                  p: Resampling = Resampling(), block_rows: int = 50_000) -> DataFrame:
    """Resampled trip with vertical, horizontal and linear magnitude from the phone's own fusion columns.

    Missing-value guards, gap splitting and quarantine are separate operators; the
    caller passes trips or segments that passed them. The filled samples and the
    grid are written once each: every step reads its input twice (rows and chunk
    summaries), and unwritten steps would multiply those reads.
    """
    native = ["lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z"]
    missing = [c for c in native if c not in df.columns]
    if missing:
        raise ValueError(f"missing native fusion columns: {', '.join(missing)}")
    ts = ax.order[0]
    missing_any = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in native])
    filled = df
    if not df.where(missing_any).isEmpty():
        filled = materialize(fill_rows(row_index(df, ax), ax, "idx", native).drop("idx"))
    grid = materialize(resample(filled, ax.keys, ts, numeric, ["ax", "ay", "az"], ax.chunk_len, other, p))
    lin = tuple(F.col(c) for c in native[:3])
    grav = tuple(F.col(c) for c in native[3:])
    vertical, horizontal = gravity_projection(lin, grav)
    raw = grid.withColumn("_vertical", vertical).withColumn("_horizontal", horizontal)
    if "magnitude" not in raw.columns:
        raw = raw.withColumn("magnitude", magnitude(F.col("ax"), F.col("ay"), F.col("az")))
    fused = causal_filters(raw, Axis(ax.keys, (ts,), ax.chunk_len), {"a_vertical": "_vertical"},
                           {"a_horizontal": "_horizontal"}, block_rows=block_rows)
    fused = fused.withColumn("a_linear_mag", magnitude(F.col("a_vertical"), F.col("a_horizontal")))
    return fused.drop("_vertical", "_horizontal")


def next_triggers(at: np.ndarray, cooldown: int) -> np.ndarray:
    """For each of the sorted times the place of the first one more than ``cooldown`` later; past the end if none is."""
    return np.searchsorted(at, at + cooldown, side="right")


def cooldown_walk(at: np.ndarray, first: int, cooldown: int) -> list[int]:
    """Places of the triggers among sorted times, from the place ``first`` on."""
    picked, i = [], first
    while i < len(at):
        picked.append(i)
        i = int(np.searchsorted(at, at[i] + cooldown, side="right"))
    return picked


def cooldown_triggers(df: DataFrame, ax: Axis, prob: str, threshold: float = 0.35, cooldown: int = 2_000) -> DataFrame:
    """First point at or above the threshold, then nothing until more than ``cooldown`` has passed.

    A point after a quiet spell longer than the cooldown always triggers. Between such heads a hot run may be
    endless, so no task walks it: every chunk tells for each point at which the chain of triggers may
    enter it at which one the chain leaves it, the exits find their next entry by an as-of lookup, and pointer
    doubling from the heads over these entries (a few per chunk) marks those that the chain passes. Then every chunk
    is walked from its first marked point. Times are integers; of points at one time only the first can trigger.
    """
    ts = ax.order[0]
    rest = [*ax.order[1:], prob]
    hot = ax.cut(df.where(F.col(prob) >= threshold).select(*ax.keys, *ax.order, prob, *([] if ax.chunk_len else [CHUNK])))
    points = hot.groupBy(F.struct(*ax.keys).alias("_k"), ts).agg(F.min(F.struct(CHUNK, *rest)).alias("_p"))
    points = points.select("_k", ts, "_p.*").withColumn("_cell", F.col(CHUNK))
    marked = previous(points, Axis(("_k",), (ts,), None), {"_before": ts})
    head = F.col("_before").isNull() | (F.col(ts) - F.col("_before") > cooldown)
    marked = materialize(marked.withColumn("_head", head).drop("_before"))

    key = marked.schema["_k"].dataType.simpleString()
    time = marked.schema[ts].dataType.simpleString()

    def entries(points: pa.Table) -> pa.Table:
        points, groups = bundle_groups(points, cell, ts)
        times, heads = points.column(ts).to_numpy(), points.column("_head").to_numpy()
        may, exits = np.zeros(len(times), bool), np.zeros_like(times)
        for g in groups:
            at = times[g]
            leap = next_triggers(at, cooldown)
            last = np.where(leap < len(at), leap, np.arange(len(at)))
            while True:  # the last trigger of the chain from each point, by doubling
                further = last[last]
                if (further == last).all():
                    break
                last = further
            may[g], exits[g] = heads[g] | (np.arange(len(at)) <= leap[0]), at[last]
        out = points.filter(pa.array(may)).select(["_k", ts, "_head"])
        return out.append_column("exit", pa.array(exits[may]))

    cell = ["_k", "_cell"]
    n_points = marked.count()
    nodes = materialize(bundled(marked, cell, n_points).groupBy("_bundle").applyInArrow(entries, f"_k {key}, {ts} {time}, _head boolean, exit {time}"))
    reach = Axis(("_k",), ("_at",), ax.chunk_len or max(1, 1_000 * cooldown))
    jumps = asof(nodes.where(F.col("exit").isNotNull()), nodes.withColumns({"_next": F.col(ts), "_into_head": F.col("_head")}), reach,
                 -(F.col("exit") + cooldown) - 1, -F.col(ts), ["_next", "_into_head"], "_hit")
    # a head is marked anyway
    jumps = materialize(jumps.where("_hit is not null and not _hit._into_head").select("_k", F.col(ts).alias("_from"), F.col("_hit._next").alias("_to")))
    passed = nodes.where("_head").select("_k", F.col(ts).alias("_from"))
    while True:
        new = passed.join(jumps, ["_k", "_from"]).select("_k", F.col("_to").alias("_from")).distinct()
        new = materialize(new.join(passed, ["_k", "_from"], "left_anti"))
        if new.isEmpty():
            break
        passed = materialize(passed.unionByName(new))
        onward = jumps.select("_k", F.col("_from").alias("_to"), F.col("_to").alias("_then"))
        jumps = materialize(jumps.join(onward, ["_k", "_to"]).select("_k", "_from", F.col("_then").alias("_to")))

    flags = passed.select("_k", F.col("_from").alias(ts), F.lit(True).alias("_passed"))
    rows = marked.join(flags, ["_k", ts], "left")
    kept = ["_k", ts, *rest]
    schema = T.StructType([rows.schema[c] for c in kept])

    def walk(points: pa.Table) -> pa.Table:
        points, groups = bundle_groups(points, cell, ts)
        times, passed, picked = points.column(ts).to_numpy(), points.column("_passed").is_valid().to_numpy(), []
        for g in groups:
            first = np.flatnonzero(passed[g])
            if len(first):
                picked += [g.start + i for i in cooldown_walk(times[g], int(first[0]), cooldown)]
        return points.take(pa.array(picked, pa.int64())).select(kept)

    out = bundled(rows, cell, n_points).groupBy("_bundle").applyInArrow(walk, schema)
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in ax.keys], *ax.order, prob)


def welch_bands(df: DataFrame, ax: Axis, value: str, bands: dict[str, tuple[float, float, bool]],
                sample_hz: float = 100.0, segment_rows: int = 1024) -> DataFrame:
    """Mean spectral density per trip and band: Hann segments, half overlap, constant detrend.

    ``bands`` gives (low, high, low end included). Each segment is one bounded
    array and yields one number per band; averaging over segments is a plain
    aggregate. Trips shorter than a segment use one segment of their own length.
    """
    rows = row_index(df.where(F.col(value).isNotNull()).select(*ax.keys, *ax.order, value), ax)
    hop = segment_rows // 2
    lengths = rows.groupBy(*ax.keys).agg((F.max("idx") + 1).alias("_n"))
    last = F.floor(F.col("idx") / hop)
    cut = rows.withColumn("_seg", F.explode(F.sequence(F.greatest(F.lit(0), last - 1), last)))
    arrays = cut.groupBy(*ax.keys, "_seg").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("x")))).alias("_rows"))
    arrays = join_per_key(arrays, lengths, ax.keys, ["_seg"])
    whole = (F.size("_rows") == segment_rows) | ((F.col("_seg") == 0) & (F.col("_n") < segment_rows))
    names = list(bands)

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def density(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch:
                x = np.asarray(x, float)
                n = len(x)
                hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
                power = np.abs(np.fft.rfft((x - x.mean()) * hann)) ** 2 / (sample_hz * (hann ** 2).sum())
                power[1:(-1 if n % 2 == 0 else None)] *= 2
                hz = np.fft.rfftfreq(n, 1 / sample_hz)
                out.append([power[((hz >= lo) if closed else (hz > lo)) & (hz <= hi)].mean()
                            for lo, hi, closed in bands.values()])
            yield pd.DataFrame(out, columns=names)

    scored = arrays.where(whole).withColumn("_d", density(F.transform("_rows", lambda r: r["x"])))
    return scored.groupBy(*ax.keys).agg(*[F.avg(f"_d.{n}").alias(n) for n in names])
