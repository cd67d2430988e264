"""Joins between events, labels, trips and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripwave.functions.exprs import haversine
from tripwave.operators.ordered import Axis, asof, fill, join_per_key, running_max
from tripwave.operators.windows import range_join

# Which label wins when two land on one event.
LABEL_PRIORITY = {"Pothole": 3, "Speed Bump": 2, "Non-Event": 1, "Unsure": 0, "": -1}


def label_priority(label: Column) -> Column:
    ranks = F.create_map(*[x for k, v in LABEL_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(ranks, F.coalesce(label, F.lit(""))), F.lit(-1))


def first_match(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Left rows with the first ``right`` row per key; the right side is reduced before the join."""
    cols = [c for c in right.columns if c != on]
    first = right.groupBy(on).agg(F.min_by(F.struct(*cols), order).alias("_first")).select(on, "_first.*")
    return left.join(first, on)


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``."""
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(key, "_row.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` whose key is untouched, plus all of ``changes``."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def nearest_in_time(labels: DataFrame, events: DataFrame, key: str, label: str, label_at: str, event: str,
                    event_at: str, tolerance: int) -> DataFrame:
    """The event closest in time to each label within the tolerance, the earlier number on a tie."""
    pairs = range_join(events.select(key, event, event_at), labels.select(key, label, label_at),
                       key, event_at, label_at, tolerance, tolerance)
    gap = F.abs(F.col(event_at) - F.col(label_at))
    best = pairs.groupBy(key, label).agg(F.min_by(F.struct(event, gap.alias("dt")), F.struct(gap, event)).alias("_b"))
    return best.select(key, label, "_b.*")


def mutual_nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_at: str, right_id: str, right_at: str,
                   tolerance: int) -> DataFrame:
    """Rows of two streams that are each other's closest in time within the tolerance, with ``dt``: one partner each way.

    Of equally close ones the smaller id is meant on both sides.
    """
    there = nearest_in_time(left, right, key, left_id, left_at, right_id, right_at, tolerance)
    back = nearest_in_time(right, left, key, right_id, right_at, left_id, left_at, tolerance)
    return there.join(back.drop("dt"), [key, left_id, right_id])


def resolve_collisions(matched: DataFrame, key: str, event: str, label_no: str, label: str, dt: str,
                       chunk_len: int = 1_000) -> DataFrame:
    """One label per event (class priority, then smaller gap, then first), and how often a later one took over."""
    better = F.struct(label_priority(F.col(label)).alias("rank"), (-F.col(dt)).alias("near"))
    ranked = matched.withColumn("_better", better)
    ax = Axis((key, event), (label_no,), chunk_len)
    seen = running_max(ranked, ax, "_top", F.col("_better"))
    took = F.col("_top").isNotNull() & (F.col("_better") > F.col("_top"))
    return seen.groupBy(key, event).agg(
        F.max_by(label, F.struct(F.col("_better"), -F.col(label_no))).alias(label),
        F.count(F.lit(1)).alias("n_labels"), F.count_if(took).alias("collisions"))


def migration_counts(labels: DataFrame, matched: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Labels, mapped events, lost labels and resolved collisions per trip."""
    total = labels.groupBy(key).agg(F.count(F.lit(1)).alias("total_labels"))
    hit = matched.groupBy(key).agg(F.count(F.lit(1)).alias("_hit"))
    done = resolved.groupBy(key).agg(F.count(F.lit(1)).alias("mapped"), F.sum("collisions").alias("collisions"))
    out = total.join(hit, key, "left").join(done, key, "left").na.fill(0)
    return out.withColumn("lost", F.col("total_labels") - F.col("_hit")).drop("_hit")


def nearest_in_space(left: DataFrame, right: DataFrame, left_id: str, right_id: str, within_m: float = 10.0,
                     by: Sequence[str] = ()) -> DataFrame:
    """The closest ``right`` point within ``within_m`` of each ``left`` point, the smaller id on a tie.

    Points are searched on a geographic grid, finest cells first: a point matched
    within a cell's width is settled there, so crowded places never pair up whole
    coarse cells. Points at equal coordinates count once on either side. Right points
    within a cell of longitude 180 are searched from both sides of it.
    """
    at_right = right.groupBy(*by, F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).agg(
        F.min(right_id).alias(right_id))
    todo = left.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*by, "lat", "lon").distinct()
    found = None
    # One degree of latitude is at least 110,574 m; a degree of longitude shrinks with its cosine.
    for metres in (within_m / 64, within_m / 8, within_m):
        step = metres / 110_574.0

        def row_cell(lat: Column) -> Column:
            return F.floor(lat / step)

        def cells_per_degree(row: Column) -> Column:
            widest = F.greatest(F.abs(row), F.abs(row + 1)) * step
            return F.greatest(F.cos(F.radians(F.least(widest, F.lit(89.9)))), F.lit(1e-3)) / step

        def col_cell(lon: Column, row: Column) -> Column:
            return F.floor(lon * cells_per_degree(row))

        placed = at_right.withColumn("_r", row_cell(F.col("rlat")))
        edge = (180 - F.abs("rlon")) * cells_per_degree(F.col("_r")) <= 2
        turned = F.col("rlon") - 360 * F.signum("rlon")
        placed = placed.withColumn("rlon", F.explode(F.when(edge, F.array("rlon", turned)).otherwise(F.array("rlon"))))
        placed = placed.withColumn("_c", col_cell(F.col("rlon"), F.col("_r")))
        seek = todo.withColumn("_r", F.explode(F.array(*[row_cell(F.col("lat")) + d for d in (-1, 0, 1)])))
        seek = seek.withColumn("_c", F.explode(F.array(*[col_cell(F.col("lon"), F.col("_r")) + d for d in (-1, 0, 1)])))
        dist = haversine(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
        near = seek.join(placed, [*by, "_r", "_c"]).withColumn("distance_m", dist).where(F.col("distance_m") <= metres)
        best = near.groupBy(*by, "lat", "lon").agg(
            F.min_by(F.struct(right_id, "distance_m"), F.struct("distance_m", right_id)).alias("_b"))
        best = best.select(*by, "lat", "lon", "_b.*")
        found = best if found is None else found.unionByName(best)
        todo = todo.join(best, [*by, "lat", "lon"], "left_anti")
    return left.select(left_id, *by, "lat", "lon").join(found, [*by, "lat", "lon"])


def near_gap(events: DataFrame, gaps: DataFrame, ax: Axis, at: str, buffer: int) -> DataFrame:
    """Events within ``buffer`` of a recording gap, with the distance to its closer end.

    Gaps of a trip are disjoint and ordered, so the last gap starting before the
    buffered event is the only one to look at: an as-of lookup, not a range scan.
    """
    seen = asof(events, gaps, Axis(ax.keys[:1], (at,), ax.chunk_len), F.col(at) + buffer, F.col("gap_start"),
                ["gap_start", "gap_end"], "_gap")
    hit = seen.where(F.col("_gap.gap_end") >= F.col(at) - buffer)
    away = F.least(F.abs(F.col(at) - F.col("_gap.gap_start")), F.abs(F.col(at) - F.col("_gap.gap_end")))
    return hit.withColumn("gap_distance", away).drop("_gap")


def away_from_events(candidates: DataFrame, events: DataFrame, key: str, at: str, event_at: str, min_distance: int,
                     chunk_len: int) -> DataFrame:
    """Candidates at least ``min_distance`` from every event of their trip."""
    marks = events.select(key, F.col(event_at).alias("_pos"), F.lit(0).alias("_side"))
    seeks = candidates.select(key, F.col(at).alias("_pos"), F.lit(1).alias("_side"),
                              F.struct(*[F.col(c) for c in candidates.columns]).alias("_row"))
    both = marks.unionByName(seeks, allowMissingColumns=True)
    mark = F.when(F.col("_side") == 0, F.col("_pos"))
    near = fill(both, Axis((key,), ("_pos", "_side"), chunk_len), back={"_before": mark}, ahead={"_after": mark})
    clear = ((F.coalesce(F.col("_pos") - F.col("_before") >= min_distance, F.lit(True)))
             & (F.coalesce(F.col("_after") - F.col("_pos") >= min_distance, F.lit(True))))
    return near.where((F.col("_side") == 1) & clear).select("_row.*")


def moving(candidates: DataFrame, samples: DataFrame, key: str, ts: str, at: str, candidate: str, half: int,
           min_speed: float = 2.0) -> DataFrame:
    """Candidates whose mean speed over the window around them exceeds ``min_speed``."""
    pairs = range_join(samples.select(key, ts, "speed"), candidates, key, ts, at, half, half)
    speeds = pairs.groupBy(*candidates.columns).agg(F.avg("speed").alias("speed_mean"))
    return speeds.where(F.col("speed_mean") > min_speed)


def lookup(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for keys that are not found."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def align(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Rows of two result tables for the same events."""
    return a.join(b, on)


def keep_trips(df: DataFrame, trips: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    return join_per_key(df, trips.select(key), [key], spread, "left_semi")


def union_background(events: DataFrame, background: DataFrame) -> DataFrame:
    """Labelled events and background rows under one schema; ids become text because background ids are text."""
    a = events.withColumn("event_id", F.col("event_id").cast("string"))
    b = background.withColumn("event_id", F.col("event_id").cast("string"))
    return a.unionByName(b, allowMissingColumns=True)


def missing_ids(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key), key, "left_anti")


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
