"""Prediction tables: decisions, confusion, reports, PR curves, audits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripwave.functions.exprs import best_class, ratio
from tripwave.operators.aggregates import attach_one
from tripwave.operators.ordered import CHUNK, Axis, join_per_key, materialize, previous, range_chunks, row_index, running


def threshold_decision(proba: Column, pothole: float, bump: float) -> Column:
    """Class index: both thresholds met -> the larger, one -> that one, none -> 0."""
    p, b = proba[1], proba[2]
    hit_p, hit_b = p >= pothole, b >= bump
    return F.when(hit_p & (~hit_b | (p >= b)), 1).when(hit_b, 2).otherwise(0)


def priority_decision(proba: Column, pothole: float = 0.4507, bump: float = 0.7622) -> Column:
    """Class index with the pothole threshold tested first."""
    return F.when(proba[1] >= pothole, 1).when(proba[2] >= bump, 2).otherwise(0)


def soft_vote(first: Column, second: Column, weight: float = 0.3) -> Column:
    return F.zip_with(first, second, lambda a, b: weight * a + (1 - weight) * b)


def confusion_matrix(df: DataFrame, y: str, pred: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """All class pairs with counts and row percentages; one pass, zero cells included."""
    cells = [F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted"),
                      F.count_if((F.col(y) == a) & (F.col(pred) == b)).alias("n"),
                      F.count_if(F.col(y) == a).alias("_row")) for a in classes for b in classes]
    out = df.groupBy(*by).agg(F.array(*cells).alias("_c")).select(*by, F.explode("_c").alias("_c")).select(*by, "_c.*")
    return out.withColumn("row_pct", ratio(F.col("n") * 100.0, F.col("_row"))).drop("_row")


def classification_report(df: DataFrame, y: str, pred: str, classes: Mapping[int, str], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support per class, then accuracy, macro and weighted averages."""
    def sums(c: int) -> Column:
        return F.struct(
            F.lit(classes[c]).alias("label"), F.count_if((F.col(y) == c) & (F.col(pred) == c)).alias("tp"),
            F.count_if(F.col(pred) == c).alias("called"), F.count_if(F.col(y) == c).alias("support"))

    counts = df.groupBy(*by).agg(F.array(*[sums(c) for c in classes]).alias("_s"), F.count(F.lit(1)).alias("_n"),
                                 F.count_if(F.col(y) == F.col(pred)).alias("_right"))

    def scores(s: Column) -> Column:
        p, r = ratio(s["tp"], s["called"]), ratio(s["tp"], s["support"])
        return F.struct(s["label"].alias("label"), p.alias("precision"), r.alias("recall"),
                        ratio(2 * p * r, p + r).alias("f1"), s["support"].alias("support"))

    rows = counts.withColumn("_m", F.transform("_s", scores))

    def mean(field: str, weight: Callable[[Column], Column], total: Column) -> Column:
        return F.aggregate("_m", F.lit(0.0), lambda acc, m: acc + m[field] * weight(m)) / total

    def average(name: str, weight: Callable[[Column], Column], total: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), *[mean(f, weight, total).alias(f) for f in ("precision", "recall", "f1")],
                        F.col("_n").alias("support"))

    acc = ratio(F.col("_right"), F.col("_n"))
    extra = F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("_n").alias("support")),
        average("macro avg", lambda m: F.lit(1.0), F.lit(float(len(classes)))),
        average("weighted avg", lambda m: m["support"].cast("double"), F.col("_n")))
    return rows.select(*by, F.explode(F.concat("_m", extra)).alias("_r")).select(*by, "_r.*")


def comparison(report: DataFrame, model: str, models: Sequence[str]) -> DataFrame:
    """One row per label, precision/recall/F1/support of each model side by side."""
    return report.groupBy("label").agg(*[
        F.max(F.when(F.col(model) == m, F.col(f))).alias(f"{m}_{f}")
        for m in models for f in ("precision", "recall", "f1", "support")])


def pr_curve(df: DataFrame, positive: Column, score: str, by: Sequence[str] = (), keep_chunk: bool = False) -> DataFrame:
    """Precision and recall at every distinct score, highest score first.

    Scores are counted before the shuffle; running counts go over range chunks,
    so a class with a third of all rows is spread like any other.
    """
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(positive).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    ranged = range_chunks(counts.withColumn("_neg", -F.col("threshold")), [*by, "_neg"])
    ax = Axis(tuple(by), ("_neg",), None)
    curve = running(ranged, ax, {"tp": F.col("_pos"), "called": F.col("_cnt")}, keep_chunk=True)
    totals = ranged.groupBy(*by).agg(F.sum("_pos").alias("_p"))
    joined = join_per_key(curve, totals, by, ["threshold"]) if by else attach_one(curve, totals)
    out = joined.select(
        *by, "threshold", "_neg", CHUNK, "tp", "called", (F.col("tp") / F.col("called")).alias("precision"),
        ratio(F.col("tp"), F.col("_p"), None).alias("recall"))
    return out if keep_chunk else out.drop("_neg", CHUNK)


def pr_areas(df: DataFrame, positive: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area and step-wise average precision of each PR curve, end point (recall 0, precision 1) included."""
    curve = pr_curve(df, positive, score, by, keep_chunk=True)
    steps = previous(curve, Axis(tuple(by), ("_neg",), None), {"_r": "recall", "_p": "precision"})
    width = F.col("recall") - F.coalesce("_r", F.lit(0.0))
    return steps.groupBy(*by).agg(
        F.sum(width * (F.col("precision") + F.coalesce("_p", F.lit(1.0))) / 2).alias("pr_auc"),
        F.sum(width * F.col("precision")).alias("average_precision"))


def cv_folds(df: DataFrame, fold: str, y: str, pred: str, score: str, positive: int = 1) -> DataFrame:
    """F1 and PR-AUC of the positive class per fold; folds without positives are left out."""
    is_pos = F.col(y) == positive
    f = df.groupBy(fold).agg(
        F.count_if(is_pos).alias("positives"),
        ratio(2.0 * F.count_if(is_pos & (F.col(pred) == positive)),
              F.count_if(is_pos) + F.count_if(F.col(pred) == positive)).alias("f1")).where("positives > 0")
    return f.join(pr_areas(df, is_pos, score, [fold]).select(fold, "pr_auc"), fold)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Means over folds and the robust score, mean F1 minus its population std."""
    return folds.agg(
        F.count(F.lit(1)).alias("folds"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
        F.avg("pr_auc").alias("pr_auc_mean"), (F.avg("f1") - F.stddev_pop("f1")).alias("robust"))


def outcome(y: Column, pred: Column, positive: int = 1, negative: int = 0) -> Column:
    """TP, FP (a clean negative called positive), FN, TN; other confusions are NULL."""
    return (F.when((y == positive) & (pred == positive), "TP").when((y == negative) & (pred == positive), "FP")
            .when((y == positive) & (pred != positive), "FN").when((y == negative) & (pred == negative), "TN"))


def error_summary(df: DataFrame, outcome_col: str, prob: Column, borderline: float = 0.6) -> DataFrame:
    """Probability distribution and borderline counts per outcome."""
    rows = df.where(F.col(outcome_col).isNotNull()).withColumn("_p", prob)
    return rows.groupBy(outcome_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_p"), F.stddev_pop("_p").alias("std_p"),
        F.min("_p").alias("min_p"), F.max("_p").alias("max_p"),
        F.count_if(F.col("_p") < borderline).alias("borderline"), F.count_if(F.col("_p") >= borderline).alias("confident"))


def precision_recall(df: DataFrame, outcome_col: str) -> DataFrame:
    n = {o: F.count_if(F.col(outcome_col) == o) for o in ("TP", "FP", "FN")}
    return df.agg(*[c.alias(o.lower()) for o, c in n.items()],
                  (n["TP"] / (n["TP"] + n["FP"] + 1e-9)).alias("precision"),
                  (n["TP"] / (n["TP"] + n["FN"] + 1e-9)).alias("recall"))


def calibration_check(df: DataFrame, y: str, pred: str, proba: str, positive: int = 1) -> DataFrame:
    """Raw probability of correctly called positives and the shares under 0.5 and 0.3."""
    p = F.col(proba)[positive]
    hits = df.where((F.col(y) == positive) & (F.col(pred) == positive)).select(p.alias("_p"))
    n = F.count(F.lit(1))
    return hits.agg(n.alias("n"), F.avg("_p").alias("mean_p"),
                    ratio(F.count_if(F.col("_p") < 0.5), n).alias("share_under_50"),
                    ratio(F.count_if(F.col("_p") < 0.3), n).alias("share_under_30"))


def hard_negatives(df: DataFrame, y: str, proba: str, confidence: float = 0.50) -> DataFrame:
    """Non-events called an anomaly with more than ``confidence``."""
    rows = df.withColumn("pred_class", best_class(F.col(proba))).withColumn("confidence", F.array_max(proba))
    return rows.where((F.col(y) == 0) & (F.col("pred_class") > 0) & (F.col("confidence") > confidence))


def focal_loss(df: DataFrame, y: str, proba: str, gamma: float = 2.0, weights: Sequence[float] | None = None) -> DataFrame:
    """Mean cross-entropy and focal loss; with class weights the focal mean is weighted."""
    p = F.element_at(F.col(proba), F.col(y) + 1)
    ce = -F.log(p)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col(y) + 1) if weights else F.lit(1.0)
    return df.agg(F.avg(ce).alias("log_loss"),
                  (F.sum(w * F.pow(1 - p, F.lit(gamma)) * ce) / F.sum(w)).alias("focal_loss"))


def minority_f1(y: str, pred: str) -> Column:
    def f1(c: int) -> Column:
        return ratio(2.0 * F.count_if((F.col(y) == c) & (F.col(pred) == c)),
                     F.count_if(F.col(y) == c) + F.count_if(F.col(pred) == c))

    return (f1(1) + f1(2)) / 2


def permutation_importance(df: DataFrame, ident: str, y: str, channels: Sequence[str],
                           predict: Callable[[DataFrame], DataFrame], shuffle: Column) -> DataFrame:
    """Drop of the mean minority F1 when one channel comes from another row.

    Rows are numbered by id and by ``shuffle``; equal numbers are paired, so the
    permutation is a join. Both orders are cut into ranges, one per shuffle partition, whose sizes give
    the numbers their offsets. ``predict`` adds a ``pred`` column.
    """
    base = range_chunks(df.select(ident, y, *channels), [ident])
    base = row_index(base, Axis((), (ident,), None), "_i")
    mixed = range_chunks(df.select(ident, shuffle.alias("_s"), *[F.col(c).alias(f"_x_{c}") for c in channels]), ["_s", ident])
    mixed = row_index(mixed, Axis((), ("_s", ident), None), "_i").drop(ident, "_s")
    pairs = materialize(base.join(mixed, "_i"))
    # every row once for the baseline and once for each channel, so that one pass scores them all
    each = pairs.withColumn("channel", F.explode(F.array(F.lit("baseline"), *[F.lit(c) for c in channels])))
    swapped = {c: F.when(F.col("channel") == c, F.col(f"_x_{c}")).otherwise(F.col(c)) for c in channels}
    return predict(each.withColumns(swapped)).groupBy("channel").agg(minority_f1(y, "pred").alias("f1"))


def importance_drop(scores: DataFrame) -> DataFrame:
    """Channels by falling F1 drop against the ``baseline`` row."""
    base = scores.where("channel = 'baseline'").select(F.col("f1").alias("_base"))
    out = attach_one(scores.where("channel <> 'baseline'"), base).select("channel", F.col("f1").alias("new_f1"), (F.col("_base") - F.col("f1")).alias("f1_drop"))
    return out.orderBy(F.desc("f1_drop"), "channel")


def run_comparison(df: DataFrame, run: str, positive: Column, score: str, classes: Sequence[str] = ()) -> DataFrame:
    """PR areas per run (and class) side by side."""
    return pr_areas(df, positive, score, [run, *classes])
