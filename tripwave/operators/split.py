"""Trip-isolated splits, folds, weights and scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwave.functions.exprs import array_sum, bind
from tripwave.operators.aggregates import attach_one
from tripwave.operators.ordered import Axis, range_chunks, row_index


def trip_counts(df: DataFrame, key: str, label: str, classes: Sequence[object]) -> DataFrame:
    """One row per trip with its class counts as an array in class order."""
    return df.groupBy(key).agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("counts"))


def _walk(trips: DataFrame, order: list[Column], schema: str,
          assign: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Run a greedy assignment over the per-trip table.

    Each choice depends on all earlier ones, so the trips (a few numbers each, not
    their rows) pass one task as a sorted stream of Arrow batches.
    """
    return trips.repartition(1).sortWithinPartitions(*order).mapInPandas(assign, schema)


def group_split(df: DataFrame, key: str, label: str, classes: Sequence[object], minority: Sequence[object],
                train_ratio: float = 0.8) -> DataFrame:
    """Trip -> train/test: a trip joins train if that brings the class shares closer to ``train_ratio``."""
    if not 0.0 < train_ratio < 1.0:
        raise ValueError("train_ratio must be between 0 and 1")
    trips = trip_counts(df, key, label, classes)
    totals = trips.agg(*[F.sum(F.col("counts")[i]) for i in range(len(classes))]).first()
    if totals is None or totals[0] is None:
        raise ValueError("no rows to split")
    whole = np.array([float(t) for t in totals]) + 1e-9
    rare = sum((F.col("counts")[i] for i, c in enumerate(classes) if c in minority), F.lit(0))
    key_type = dict(df.dtypes)[key]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = np.zeros(len(whole))
        for batch in batches:
            side = []
            for counts in batch["counts"]:
                gain = np.asarray(counts, float)
                better = (((taken + gain) / whole - train_ratio) ** 2).sum() < ((taken / whole - train_ratio) ** 2).sum()
                side.append("train" if better else "test")
                taken = taken + gain if better else taken
            yield pd.DataFrame({key: batch[key], "side": side})

    return _walk(trips.withColumn("_rare", rare), [F.desc("_rare"), F.asc(key)], f"{key} {key_type}, side string", assign)


def checked_split(split: DataFrame) -> DataFrame:
    """The split itself, after making sure both sides have a trip."""
    sides = split.agg(F.count_if(F.col("side") == "train"), F.count_if(F.col("side") == "test")).first()
    if not sides[0] or not sides[1]:
        raise ValueError("one side of the split is empty")
    return split


def group_kfold(df: DataFrame, key: str, label: str, classes: Sequence[object], folds: int = 4, seed: int = 42,
                tie: Column | None = None) -> DataFrame:
    """Trip -> fold, most uneven trips first, each to the fold that keeps class shares most even.

    Ties between trips are ordered by ``tie`` (a seeded hash by default), ties between folds by size, then number.
    """
    trips = trip_counts(df, key, label, classes)
    totals = trips.agg(*[F.sum(F.col("counts")[i]) for i in range(len(classes))]).first()
    whole = np.maximum(np.array([float(t or 0) for t in totals]), 1.0)
    spread = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda a, c: a + c * c) / len(classes)
                    - F.pow(array_sum(F.col("counts")) / len(classes), F.lit(2.0)))
    key_type = dict(df.dtypes)[key]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((folds, len(whole)))
        for batch in batches:
            chosen = []
            for counts in batch["counts"]:
                gain = np.asarray(counts, float)
                options = []
                for f in range(folds):
                    held[f] += gain
                    options.append((round((held / whole).std(axis=0).mean(), 12), held[f].sum(), f))
                    held[f] -= gain
                best = min(options)[2]
                held[best] += gain
                chosen.append(best)
            yield pd.DataFrame({key: batch[key], "fold": chosen})

    order = [F.desc("_spread"), F.asc("_tie"), F.asc(key)]
    tie = F.xxhash64(F.col(key), F.lit(seed)) if tie is None else tie
    trips = trips.withColumn("_spread", F.round(spread, 9)).withColumn("_tie", tie)
    return _walk(trips, order, f"{key} {key_type}, fold int", assign)


def group_holdout(df: DataFrame, key: str, share: float, order: Column) -> DataFrame:
    """The first ``ceil(share * n)`` trips in hash order."""
    trips = range_chunks(df.select(key).distinct().withColumn("_o", order), ["_o", key])
    numbered = row_index(trips, Axis((), ("_o", key), None), "_i")
    n = trips.agg(F.ceil(F.count(F.lit(1)) * share).alias("_k"))
    return attach_one(numbered, n).where(F.col("_i") < F.col("_k")).select(key)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (classes * class size); class sizes are aggregated first and joined back.

    They are one row per class and broadcast: a shuffled join would send each class to one task.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()  # over one row per class
    weights = sizes.select(label, (F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def inject_missing(train: DataFrame, pool: DataFrame, label: str, order: str) -> DataFrame:
    """Adds the first pool row of every class the training part lacks."""
    cols = pool.columns
    first = pool.groupBy(label).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    absent = first.join(train.select(label).distinct(), label, "left_anti").select("_r.*")
    return train.unionByName(absent.select(*train.columns))


def label_index(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """Zero-based index of the label in alphabetical order."""
    names = df.select(label).distinct().where(F.col(label).isNotNull())
    order = names.agg(F.array_sort(F.collect_list(label)).alias("_names"))  # one entry per class
    found = attach_one(df, order)
    return found.withColumn(out, (F.array_position("_names", F.col(label)) - 1).cast("int")).drop("_names")


def scaler(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Mean and population std per channel over all rows and positions; tiny stds become 1."""
    parts = []
    for c in arrays:
        sums = [F.sum(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)), F.sum(F.size(c)),
                F.sum(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x * x))]
        mean = sums[0] / sums[1]
        std = F.sqrt(F.greatest(F.lit(0.0), sums[2] / sums[1] - mean * mean))
        parts += [mean.alias(f"{c}_mean"), F.when(std < 1e-6, F.lit(1.0)).otherwise(std).alias(f"{c}_std")]
    return df.agg(*parts)


def apply_scaler(df: DataFrame, params: DataFrame, arrays: Sequence[str]) -> DataFrame:
    out = attach_one(df, params)
    for c in arrays:
        out = out.withColumn(c, _scaled(c))
    return out.select(*df.columns)


def _scaled(c: str) -> Column:
    mean, std = F.col(f"{c}_mean"), F.col(f"{c}_std")
    return F.transform(F.col(c), lambda x: (x - mean) / std)


def instance_scale(channel: Column, eps: float = 1e-8) -> Column:
    """Each row's own z-score with the population std."""
    n = F.size(channel)
    spread = bind(array_sum(channel) / n, lambda mean: F.struct(
        mean.alias("mean"), F.sqrt(array_sum(F.transform(channel, lambda x: (x - mean) * (x - mean))) / n).alias("std")))
    return bind(spread, lambda s: F.transform(channel, lambda x: (x - s["mean"]) / (s["std"] + eps)))


def feature_columns(df: DataFrame, banned: Sequence[str]) -> list[str]:
    """Numeric columns that are neither metadata nor banned."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if t in numeric and c not in banned]


def model_rows(df: DataFrame, label: str, banned: Sequence[str]) -> DataFrame:
    """Rows with a label and no missing feature, feature columns and label only kept with the trip keys."""
    feats = feature_columns(df, [*banned, label])
    return df.na.drop(subset=[*feats, label])
