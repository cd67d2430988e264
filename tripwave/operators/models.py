"""Classifiers on feature tables with pyspark.ml: trip-isolated folds, calibration, search, ablations."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from tripwave.functions.exprs import array_sum, best_class, bind
from tripwave.operators.aggregates import correlation_pairs
from tripwave.operators.evaluation import classification_report, pr_areas
from tripwave.operators.ordered import join_per_key, materialize
from tripwave.operators.split import balanced_weights, inject_missing

# Default boosting parameters when no tuned set is given.
BOOSTED_DEFAULTS = {"maxIter": 100, "maxDepth": 4, "minInstancesPerNode": 1, "stepSize": 0.1,
                    "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"}

# Search space (low, high, kind) of the boosted model.
SEARCH_SPACE = {"maxIter": (50, 300, "int"), "maxDepth": (3, 9, "int"), "minInstancesPerNode": (1, 10, "int"),
                "stepSize": (0.01, 0.3, "log"), "subsamplingRate": (0.5, 1.0, "float")}


# Rows that a task holds while a ranking forest is trained.
ROWS_A_TASK = 500_000


@dataclass(frozen=True)
class Task:
    """Column roles of a training table; labels are class indexes 0..k-1."""

    features: tuple[str, ...]
    label: str = "label_idx"
    trip: str = "trip_id"
    ident: str = "event_id"
    classes: int = 3
    seed: int = 42
    params: Mapping[str, object] = field(default_factory=dict)


Scorer = Callable[[DataFrame], DataFrame]


def assemble(df: DataFrame, features: Sequence[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def weighted(df: DataFrame, task: Task) -> DataFrame:
    return assemble(balanced_weights(df, task.label), task.features)


def fit_forest(rows: DataFrame, task: Task) -> Scorer:
    """Random forest on assembled, weighted rows; the scorer adds a ``proba`` array to assembled rows."""
    model = RandomForestClassifier(featuresCol="_features", labelCol=task.label, weightCol="weight", probabilityCol="_p",
                                   rawPredictionCol="_raw", predictionCol="_pred", seed=task.seed,
                                   **{"numTrees": 50, "maxDepth": 5, **task.params}).fit(rows)
    return lambda new: model.transform(new).withColumn("proba", vector_to_array("_p")).drop("_p", "_raw", "_pred")


def train_forest(df: DataFrame, task: Task) -> Scorer:
    """Random forest with balanced row weights; the scorer adds a ``proba`` array."""
    fitted = fit_forest(weighted(df, task), task)
    return lambda rows: fitted(assemble(rows, task.features)).drop("_features")


def normalised(parts: Column) -> Column:
    """Array scaled to sum one; all-zero rows become uniform."""
    return bind(array_sum(parts), lambda total: F.transform(parts, lambda x: F.when(total > 0, x / total).otherwise(
        F.lit(1.0) / F.size(parts))))


def fit_boosted(rows: DataFrame, task: Task) -> Scorer:
    """One boosted binary model per class on assembled, weighted rows; probabilities are renormalised."""
    params = {**BOOSTED_DEFAULTS, **task.params}
    fitted = []
    for c in range(task.classes):
        binary = rows.withColumn("_y", (F.col(task.label) == c).cast("double"))
        fitted.append(GBTClassifier(featuresCol="_features", labelCol="_y", weightCol="weight", seed=task.seed, **params).fit(binary))

    def score(new: DataFrame) -> DataFrame:
        out = new
        for c, model in enumerate(fitted):
            out = model.setProbabilityCol(f"_p{c}").setRawPredictionCol(f"_r{c}").setPredictionCol(f"_d{c}").transform(out)
        parts = F.array(*[vector_to_array(f"_p{c}")[1] for c in range(task.classes)])
        return out.withColumn("proba", normalised(parts)).drop(*[f"_{x}{c}" for x in "prd" for c in range(task.classes)])

    return score


def train_boosted(df: DataFrame, task: Task) -> Scorer:
    """``fit_boosted`` on balanced weights of a table that is written once for all classes."""
    fitted = fit_boosted(materialize(weighted(df, task)), task)
    return lambda rows: fitted(assemble(rows, task.features)).drop("_features")


TRAINERS = {"forest": train_forest, "boosted": train_boosted}
FITTERS = {"forest": fit_forest, "boosted": fit_boosted}


def out_of_fold(df: DataFrame, folds: DataFrame, task: Task, train: Callable[[DataFrame, Task], Scorer]) -> DataFrame:
    """Every row scored by a model that never saw its trip; absent classes get one row from the whole table."""
    rows = materialize(join_per_key(df, folds, [task.trip], [task.ident]))
    out = None
    for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):  # at most k fold numbers
        part = inject_missing(rows.where(F.col("fold") != f), rows, task.label, task.ident)
        scored = train(part, task)(rows.where(F.col("fold") == f))
        out = scored if out is None else out.unionByName(scored)
    return out.withColumn("pred", best_class(F.col("proba")))


def calibrate(oof: DataFrame, task: Task) -> Scorer:
    """Isotonic map per class learned on out-of-fold scores; outputs are clipped at the ends and renormalised."""
    fitted = []
    for c in range(task.classes):
        rows = oof.select(F.col("proba")[c].alias("_x"), (F.col(task.label) == c).cast("double").alias("_y"))
        fitted.append(IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol=f"_c{c}").fit(rows))

    def score(df: DataFrame) -> DataFrame:
        out = df
        for c, model in enumerate(fitted):
            out = model.transform(out.withColumn("_x", F.col("proba")[c])).drop("_x")
        parts = F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"_c{c}"))) for c in range(task.classes)])
        return out.withColumn("calibrated", normalised(parts)).drop(*[f"_c{c}" for c in range(task.classes)])

    return score


def importances(df: DataFrame, task: Task) -> list[tuple[str, float]]:
    """Features by falling forest importance; ties in column order."""
    rows = df.select(task.label, *task.features)
    parts = -(-rows.count() // ROWS_A_TASK)
    if parts > 1:  # a task keeps its rows for every pass over the trees, so it must not hold a whole file split
        rows = rows.repartition(parts)
    model = RandomForestClassifier(featuresCol="_features", labelCol=task.label, weightCol="weight", seed=task.seed,
                                   **{"numTrees": 50, "maxDepth": 4, **task.params}).fit(weighted(rows, task))
    ranked = sorted(enumerate(model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    return [(task.features[i], float(w)) for i, w in ranked]


def importance_table(df: DataFrame, task: Task, top: int = 15) -> DataFrame:
    rows = [(i + 1, name, weight) for i, (name, weight) in enumerate(importances(df, task)[:top])]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, importance double")


def prune_features(df: DataFrame, features: Sequence[str], ranking: Sequence[str], limit: float = 0.75, top: int = 25) -> DataFrame:
    """Ranked features, each kept unless correlated beyond ``limit`` with a better one that was kept.

    Only the k x k correlations reach the driver.
    """
    r = {(x["feature_a"], x["feature_b"]): abs(x["r"]) for x in correlation_pairs(df, features).collect()}
    kept: list[str] = []
    rows = []
    for name in ranking:
        clash = next((k for k in kept if max(r.get((name, k), 0.0), r.get((k, name), 0.0)) > limit), None)
        if clash is None:
            kept.append(name)
        rows.append((name, clash is None and kept.index(name) < top, clash,
                     None if clash is None else max(r.get((name, clash), 0.0), r.get((clash, name), 0.0))))
    place = {f: i for i, f in enumerate(features)}
    rows = [(place[n], n, s, c, v) for n, s, c, v in rows]
    return df.sparkSession.createDataFrame(sorted(rows), "position int, feature string, selected boolean, redundant_with string, correlation double")


def select_features(df: DataFrame, task: Task, limit: float = 0.75, top: int = 25) -> DataFrame:
    """``prune_features`` ranked by the importances of a forest over all features of the task, with ``importance``."""
    ranked = importances(df, task)
    weights = df.sparkSession.createDataFrame(ranked, "feature string, importance double")
    return prune_features(df, task.features, [name for name, _ in ranked], limit, top).join(weights, "feature")


def fold_scores(oof: DataFrame, task: Task, positive: int = 1) -> DataFrame:
    """PR-AUC of the positive class per fold; folds without positives are left out."""
    rows = oof.withColumn("_s", F.col("proba")[positive])
    return pr_areas(rows, F.col(task.label) == positive, "_s", ["fold"]).where(F.col("pr_auc").isNotNull())


def draw(space: Mapping[str, tuple], rng: random.Random) -> dict[str, object]:
    out = {}
    for name, (low, high, kind) in space.items():
        out[name] = (rng.randint(low, high) if kind == "int" else
                     low * (high / low) ** rng.random() if kind == "log" else low + (high - low) * rng.random())
    return out


def search(df: DataFrame, folds: DataFrame, task: Task, trials: int, space: Mapping[str, tuple] = SEARCH_SPACE,
           trainer: str = "boosted", at_once: int = 4) -> DataFrame:
    """Seeded random search with successive halving: ``trial``, ``value`` (mean PR-AUC of the positive class over its folds),
    ``folds`` and ``params``; trials that went furthest first, best first.

    The table is assembled and weighted once for each fold and written; trials read it and write nothing.
    ``at_once`` trials run side by side. After every fold the weaker half of the trials is stopped.
    """
    rng = random.Random(task.seed)
    params = [draw(space, rng) for _ in range(trials)]
    rows = materialize(join_per_key(df, folds, [task.trip], [task.ident]))
    columns = [task.ident, task.label, "weight", "_features"]
    scores: dict[int, list[float]] = {n: [] for n in range(trials)}
    alive = list(range(trials))
    for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):  # at most k fold numbers
        part = inject_missing(rows.where(F.col("fold") != f), rows, task.label, task.ident)
        known = materialize(weighted(part, task).select(*columns))
        held = materialize(assemble(rows.where(F.col("fold") == f), task.features).select("fold", task.ident, task.label, "_features"))

        def run(n: int) -> float:
            trial = Task(**{**task.__dict__, "params": {**task.params, **params[n]}})
            found = fold_scores(FITTERS[trainer](known, trial)(held), task).agg(F.coalesce(F.avg("pr_auc"), F.lit(0.0))).first()
            return float(found[0])

        with ThreadPoolExecutor(at_once) as pool:
            for n, value in zip(alive, pool.map(run, alive)):
                scores[n].append(value)
        alive = sorted(alive, key=lambda n: (-sum(scores[n]) / len(scores[n]), n))[:(len(alive) + 1) // 2]
    done = sorted(((n, sum(v) / len(v), len(v), {k: str(x) for k, x in params[n].items()}) for n, v in scores.items() if v),
                  key=lambda r: (-r[2], -r[1], r[0]))
    return df.sparkSession.createDataFrame(done, "trial int, value double, folds int, params map<string,string>").coalesce(1)


def ablate_features(df: DataFrame, folds: DataFrame, task: Task, ranking: Sequence[str], sizes: Sequence[int | None],
                    trainer: str = "forest") -> DataFrame:
    """Macro and per-class F1 of out-of-fold predictions for the first n ranked features."""
    names = {c: str(c) for c in range(task.classes)}
    out = None
    for n in sizes:
        used = tuple(ranking[:n] if n else ranking)
        oof = out_of_fold(df, folds, Task(**{**task.__dict__, "features": used}), TRAINERS[trainer])
        report = classification_report(oof, task.label, "pred", names).select(
            F.lit(len(used)).alias("n_features"), "label", "f1")
        out = report if out is None else out.unionByName(report)
    return out


def ablate_data(df: DataFrame, folds: DataFrame, task: Task, steps: Mapping[str, Callable[[DataFrame], DataFrame]],
                trainer: str = "forest", at_once: int = 4) -> DataFrame:
    """Macro F1 for every on/off combination of training-set steps (2^n configurations).

    Combinations that begin alike share the tables of these steps; ``at_once`` of them run side by side.
    """
    names = {c: str(c) for c in range(task.classes)}
    rows = materialize(join_per_key(df, folds, [task.trip], [task.ident]))
    fold_ids = sorted(r[0] for r in folds.select("fold").distinct().collect())
    scored: dict[tuple[bool, ...], DataFrame] = {}

    def run(f: int, part: DataFrame) -> DataFrame:
        done = TRAINERS[trainer](part, task)(rows.where(F.col("fold") == f))
        return materialize(done.select(task.label, best_class(F.col("proba")).alias("pred")))

    with ThreadPoolExecutor(at_once) as pool:
        for f in fold_ids:
            parts = {(): materialize(inject_missing(rows.where(F.col("fold") != f), rows, task.label, task.ident))}
            for step in steps.values():
                on = pool.map(lambda part, step=step: materialize(step(part)), parts.values())
                parts = {(*begun, switch): part for begun, off, made in zip(list(parts), list(parts.values()), on)
                         for switch, part in ((False, off), (True, made))}
            for config, done in zip(parts, pool.map(lambda part, f=f: run(f, part), parts.values())):
                scored[config] = scored[config].unionByName(done) if config in scored else done
    out = None
    for config in itertools.product((False, True), repeat=len(steps)):
        macro = classification_report(scored[config], task.label, "pred", names).where("label = 'macro avg'")
        row = macro.select(*[F.lit(v).alias(k) for k, v in zip(steps, config)], F.col("f1").alias("macro_f1"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("macro_f1"))


def vote(scored: Sequence[DataFrame], ident: str) -> DataFrame:
    """Mean of the models' class probabilities."""
    out = scored[0].select(ident, F.col("proba").alias("_p0"))
    for i, s in enumerate(scored[1:], 1):
        out = out.join(s.select(ident, F.col("proba").alias(f"_p{i}")), ident)
    total = F.col("_p0")
    for i in range(1, len(scored)):
        total = F.zip_with(total, F.col(f"_p{i}"), lambda a, b: a + b)
    return out.select(ident, F.transform(total, lambda x: x / len(scored)).alias("proba"))


def train_suggester(df: DataFrame, task: Task) -> Scorer | None:
    """Forest and boosted soft vote for label suggestions; None under five rows or two classes."""
    if df.count() < 5 or df.select(task.label).distinct().count() < 2:
        return None
    forest, boosted = train_forest(df, task), train_boosted(df, Task(**{**task.__dict__, "params": {"maxIter": 50, "maxDepth": 3}}))
    return lambda rows: rows.join(vote([forest(rows), boosted(rows)], task.ident), task.ident)


def fit_pipeline(df: DataFrame, task: Task) -> PipelineModel:
    """Assembler and forest as one fitted pipeline."""
    stages = [VectorAssembler(inputCols=list(task.features), outputCol="_features"),
              RandomForestClassifier(featuresCol="_features", labelCol=task.label, weightCol="weight", probabilityCol="_p",
                                     seed=task.seed, **{"numTrees": 50, "maxDepth": 5, **task.params})]
    return Pipeline(stages=stages).fit(balanced_weights(df, task.label))


def save_pipeline(df: DataFrame, task: Task, path: str) -> str:
    """Assembler and forest as one saved pipeline model."""
    fit_pipeline(df, task).write().save(path)
    return path


def score_with(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the ``proba`` array of a fitted pipeline."""
    out = model.transform(rows).withColumn("proba", vector_to_array("_p"))
    return out.drop("_features", "_p", "rawPrediction", "prediction")


def batch_score(rows: DataFrame, path: str) -> DataFrame:
    """Rows scored with a saved pipeline; works on streams as well."""
    return score_with(PipelineModel.load(path), rows)
