"""Cleaning, gaps, resampling, fills and rolling statistics of sample streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwave.operators.ordered import Axis, block_start, exact_quantiles, fill, islands, previous, row_index, with_blocks
from tripwave.params import Resampling


def dedupe_samples(df: DataFrame, key: str, ts: str, first_by: str) -> DataFrame:
    """One row per (trip, timestamp): the earliest by ``first_by``. Partially aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in (key, ts)]
    kept = df.groupBy(key, ts).agg(F.min_by(F.struct(*rest), first_by).alias("_row"))
    return kept.select(key, ts, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def large_gaps(df: DataFrame, ax: Axis, max_gap: int = Resampling.max_gap) -> DataFrame:
    """Recording holes: previous sample, next sample and length."""
    ts = ax.order[0]
    gaps = previous(df.select(*ax.keys, *ax.order), ax, {"gap_start": ts})
    gaps = gaps.withColumn("gap_len", F.col(ts) - F.col("gap_start")).where(F.col("gap_len") > max_gap)
    return gaps.select(*ax.keys, "gap_start", F.col(ts).alias("gap_end"), "gap_len")


def segments(df: DataFrame, ax: Axis, max_gap: int = Resampling.max_gap) -> DataFrame:
    """Adds ``segment``, the start time of the contiguous recording the row belongs to."""
    ts = ax.order[0]
    cut = islands(df, ax, [ts], lambda now, before: now[ts] - before[ts] > max_gap, "_segment")
    return cut.withColumn("segment", F.col(f"_segment.{ts}")).drop("_segment")


def segment_bounds(segmented: DataFrame, key: str, ts: str) -> DataFrame:
    return segmented.groupBy(key, "segment").agg(
        F.max(ts).alias("segment_end"), F.count(F.lit(1)).alias("segment_rows"))


def gap_quarantine(df: DataFrame, ax: Axis, max_gap: int = Resampling.max_gap) -> DataFrame:
    """Largest hole per trip, and whether it makes a whole-trip run invalid."""
    ts = ax.order[0]
    steps = previous(df.select(*ax.keys, *ax.order), ax, {"_before": ts})
    worst = steps.groupBy(*ax.keys).agg(F.max(F.col(ts) - F.col("_before")).alias("max_gap"))
    return worst.withColumn("rejected", F.coalesce(F.col("max_gap") > max_gap, F.lit(False)))


def null_ratio_guard(df: DataFrame, key: str, cols: Sequence[str], limit: float = Resampling.max_null_ratio) -> DataFrame:
    """Trips whose share of missing values in any of ``cols`` exceeds ``limit``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"missing_{c}") for c in cols])
    worst = [F.col(f"missing_{c}") for c in cols]
    top = F.greatest(*worst) if len(worst) > 1 else worst[0]
    return counts.withColumn("rejected", top > F.col("n") * limit)


def min_length_guard(df: DataFrame, key: str, min_rows: int = Resampling.min_rows) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("too_short", F.col("n") < min_rows)


def bounded_fill(pos: Column, back: Column, ahead: Column, linear: int, hold: int, lead: int = 0) -> Column:
    """Value at ``pos`` from the last known and next known (pos, val) structs.

    Inside a hole: ``linear`` steps towards the next value, then ``hold`` repeats
    of the last interpolated one, then NULL. Without a next value the last one is
    held. ``lead`` steps before the next value take that value if still empty.
    """
    step = pos - back["pos"]
    slope = F.coalesce((ahead["val"] - back["val"]) / (ahead["pos"] - back["pos"]), F.lit(0.0))
    filled = F.when(step <= linear + hold, back["val"] + slope * F.least(step, F.lit(linear)))
    if lead:
        filled = F.coalesce(filled, F.when(ahead["pos"] - pos <= lead, ahead["val"]))
    return filled


def bin_mean(df: DataFrame, keys: Sequence[str], ts: str, numeric: Sequence[str], other: Mapping[str, str] | None = None,
             p: Resampling = Resampling(), first_by: Sequence[str] = ()) -> DataFrame:
    """Mean per time bin; for non-numeric columns the first non-NULL value."""
    binned = df.withColumn("bin", F.floor(F.col(ts) / p.bin_len))
    order = F.struct(*(first_by or (ts,)))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in (other or {})]
    return binned.groupBy(*keys, "bin").agg(*[F.avg(c).alias(c) for c in numeric], *firsts)


def resample(df: DataFrame, keys: Sequence[str], ts: str, numeric: Sequence[str], required: Sequence[str],
             chunk_len: int, other: Sequence[str] = (), p: Resampling = Resampling(),
             drop_unfilled: bool = True) -> DataFrame:
    """Regular grid of ``p.bin_len``: bin means, bounded linear fill, bounded hold.

    Only bins that can receive a value are generated: after each observed bin at
    most ``linear_limit + fill_limit`` of a hole. Bins beyond that would be NULL
    in every column and be dropped anyway, so a long hole costs nothing.
    """
    binned = bin_mean(df, keys, ts, numeric, {c: c for c in other}, p)
    ax = Axis(tuple(keys), ("bin",), max(1, chunk_len // p.bin_len))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("bin").alias("pos"), F.col(c).alias("val")))
             for c in (*numeric, *other)}
    linked = fill(binned, ax, back={f"_b_{c}": e for c, e in known.items()},
                  ahead={**{f"_a_{c}": known[c] for c in numeric}, "_next": F.col("bin")})
    reach = F.least(F.coalesce(F.col("_next") - F.col("bin") - 1, F.lit(0)), F.lit(p.linear_limit + p.fill_limit))
    grid = linked.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), reach)))
    pos = F.col("bin") + F.col("_step")
    out = grid.select(
        *keys, pos.alias("bin"), (pos * p.bin_len).alias(ts), (F.col("_step") == 0).alias("observed"),
        *[bounded_fill(pos, F.col(f"_b_{c}"), F.col(f"_a_{c}"), p.linear_limit, p.fill_limit).alias(c)
          for c in numeric],
        *[F.when(pos - F.col(f"_b_{c}.pos") <= p.fill_limit, F.col(f"_b_{c}.val")).alias(c) for c in other],
    )
    return out.na.drop(subset=list(required)) if drop_unfilled else out


def fill_rows(df: DataFrame, ax: Axis, idx: str, cols: Sequence[str], linear: int = 5, hold: int = 5,
              lead: int = 5) -> DataFrame:
    """Bounded fill in row space: interpolate, hold, then take the following value."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("pos"), F.col(c).alias("val"))) for c in cols}
    linked = fill(df, ax, back={f"_b_{c}": e for c, e in known.items()}, ahead={f"_a_{c}": e for c, e in known.items()})
    out = linked
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), bounded_fill(
            F.col(idx), F.col(f"_b_{c}"), F.col(f"_a_{c}"), linear, hold, lead)))
    return out.drop(*[f"{p}{c}" for c in cols for p in ("_b_", "_a_")])


def sample_rate(df: DataFrame, ax: Axis, per_second: float, min_dist_s: float = 0.2, fallback_hz: float = 50.0) -> DataFrame:
    """Rows per second from the median step, and the minimum peak distance in rows."""
    ts = ax.order[0]
    steps = previous(df.select(*ax.keys, *ax.order), ax, {"_before": ts})
    steps = steps.select(*ax.keys, (F.col(ts) - F.col("_before")).alias("step"))
    median = exact_quantiles(steps, list(ax.keys), "step", {"median_step": 0.5})
    hz = F.when(F.col("median_step") > 0, per_second / F.col("median_step")).otherwise(F.lit(fallback_hz))
    return median.withColumn("hz", hz).withColumn(
        "min_dist", F.greatest(F.lit(1), F.floor(F.lit(min_dist_s) * F.col("hz"))).cast("bigint"))


def trailing(df: DataFrame, ax: Axis, rows: int, measures: Mapping[str, Column], block_rows: int = 50_000) -> DataFrame:
    """Aggregates over the last ``rows`` rows, any trip length: equal blocks with ``rows - 1`` warm-up rows."""
    numbered = row_index(df, ax)
    blocks = with_blocks(numbered, "idx", block_rows, before=rows - 1)
    w = Window.partitionBy(*ax.keys, "_block").orderBy("idx").rowsBetween(-(rows - 1), 0)
    out = blocks.select("*", *[m.over(w).alias(n) for n, m in measures.items()])
    return out.where("_own").drop("_own", "_block")


# Rows times alpha that an EMA block may span: its largest weight is then e^600, well inside a double.
MAX_SPAN = 600


def ema(value: Column, idx: Column, start: Column, alpha: float, window) -> Column:
    """Exponential moving average without bias adjustment, as one windowed running sum.

    ``window`` orders the rows of a block by ``idx`` and ``start`` is the block's
    first index. Weights grow by 1/(1-alpha) per row, so a block may hold about
    ``MAX_SPAN / alpha`` rows; ``ema_window`` and ``ema_stream`` cut longer ones.
    """
    keep = 1.0 - alpha
    offset = (idx - start).cast("double")
    weight = F.when(idx == start, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(keep), -offset)
    return F.pow(F.lit(keep), offset) * F.sum(weight * value).over(
        window.rowsBetween(Window.unboundedPreceding, 0))


def ema_window(df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float, out: str) -> DataFrame:
    """EMA per key over rows numbered from 0 by ``idx``, for any number of rows.

    Weights start again in every block of ``MAX_SPAN / alpha`` rows; there the value that the
    block before ended with is carried in, and what lies before that has no weight left.
    """
    block, keep = max(1, int(MAX_SPAN / alpha)), 1.0 - alpha
    rows = df.withColumn("_b", F.floor(F.col(idx) / block))
    start = F.col("_b") * block
    own = Window.partitionBy(*keys, "_b").orderBy(idx)
    rows = rows.withColumn("_own", ema(F.col(value), F.col(idx), start, alpha, own))
    rows = rows.withColumn("_first", F.first(value).over(own))
    earlier = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.last(F.when(F.col(idx) % block == block - 1, F.col("_own")), ignorenulls=True).over(earlier)
    carried = F.pow(F.lit(keep), F.col(idx) - start + 1) * (ended - F.col("_first"))
    return rows.withColumn(out, F.col("_own") + F.when(F.col("_b") > 0, carried).otherwise(0.0)).drop("_b", "_own", "_first")


def ema_stream(df: DataFrame, ax: Axis, value: str, alpha: float, out: str = "ema", block_rows: int = 50_000) -> DataFrame:
    """EMA of a whole stream in blocks; the warm-up makes the forgotten start weigh less than 1e-17."""
    warm = int(40 / alpha) + 1
    block = max(1, min(block_rows, int(MAX_SPAN / alpha) - warm))
    blocks = with_blocks(row_index(df, ax), "idx", block, before=warm)
    blocks = blocks.withColumn("_start", block_start(block, warm))
    w = Window.partitionBy(*ax.keys, "_block").orderBy("idx")
    res = blocks.withColumn(out, ema(F.col(value), F.col("idx"), F.col("_start"), alpha, w))
    return res.where("_own").drop("_own", "_block", "_start")


def jerk(df: DataFrame, ax: Axis, cols: Sequence[str], hz: float) -> DataFrame:
    """First differences times the sample rate, and their magnitude."""
    steps = previous(df, ax, {f"_p_{c}": c for c in cols})
    for c in cols:
        steps = steps.withColumn(f"jerk_{c}", (F.col(c) - F.col(f"_p_{c}")) * hz)
    squares = sum((F.col(f"jerk_{c}") * F.col(f"jerk_{c}") for c in cols), F.lit(0.0))
    return steps.withColumn("jerk_3d", F.sqrt(squares)).drop(*[f"_p_{c}" for c in cols])
