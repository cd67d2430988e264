"""Model operators on a small separable table: invariants, not scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwave.operators import models, split
from tripwave.operators.evaluation import pr_areas, pr_curve


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    y = rng.choice(3, 240, p=[.7, .2, .1])
    x = rng.normal(size=(240, 3)) + np.outer(y, [2.0, 0.0, -1.0])
    df = pd.DataFrame({"event_id": range(240), "trip_id": [f"t{i % 8}" for i in range(240)], "label_idx": y.astype("int32"),
                       "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "a2": x[:, 0] * 3 + 1})
    return spark.createDataFrame(df).cache()


TASK = models.Task(features=("a", "b", "c"), params={"numTrees": 6, "maxDepth": 3})
BOOST = models.Task(features=("a", "b", "c"), params={"maxIter": 2, "maxDepth": 2})


@pytest.mark.parametrize("trainer, task", [("forest", TASK), ("boosted", BOOST)])
def test_out_of_fold(table, trainer, task):
    folds = split.group_kfold(table, "trip_id", "label_idx", (0, 1, 2), 2)
    oof = models.out_of_fold(table, folds, task, models.TRAINERS[trainer]).cache()
    rows = oof.toPandas()
    assert len(rows) == 240 and rows.event_id.is_unique
    assert rows.groupby("trip_id").fold.nunique().max() == 1
    np.testing.assert_allclose([sum(p) for p in rows.proba], 1)
    assert (rows.pred == rows.label_idx).mean() > .6
    done = models.calibrate(oof, task)(oof).toPandas()
    np.testing.assert_allclose([sum(p) for p in done.calibrated], 1)


def test_prune(table):
    got = {r.feature: r for r in models.prune_features(table, ["a", "b", "c", "a2"], ["a2", "a", "c", "b"], .75, 2).collect()}
    assert got["a2"].selected and not got["a"].selected and got["a"].redundant_with == "a2"
    assert got["a"].correlation == pytest.approx(1) and got["c"].selected and not got["b"].selected


def test_importance_and_suggester(table):
    ranked = [r.feature for r in models.importance_table(table, TASK, 3).orderBy("rank").collect()]
    assert ranked[0] == "a"
    assert models.train_suggester(table.limit(3), TASK) is None
    out = models.vote([models.train_forest(table, TASK)(table)] * 2, "event_id")
    assert out.select(F.size("proba")).distinct().collect() == [(3,)]


def test_pr_against_definition(spark):
    rng = np.random.default_rng(6)
    s, y = rng.integers(0, 40, 300) / 40, rng.random(300) < .3
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    points = []
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        points.append((t, y[hit].sum() / hit.sum(), y[hit].sum() / y.sum()))
    got = pr_curve(df, F.col("y"), "s").orderBy(F.desc("threshold")).collect()
    np.testing.assert_allclose([(r.threshold, r.precision, r.recall) for r in got], points)
    p, r = np.array([1.0] + [x[1] for x in points]), np.array([0.0] + [x[2] for x in points])
    area = pr_areas(df, F.col("y"), "s").first()
    assert area.pr_auc == pytest.approx((np.diff(r) * (p[1:] + p[:-1]) / 2).sum())
    assert area.average_precision == pytest.approx((np.diff(r) * p[1:]).sum())
