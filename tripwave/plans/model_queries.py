"""Queries that train, calibrate, search and ablate models on the vector table, or resample it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwave.functions.exprs import best_class
from tripwave.operators import models, sampling, split
from tripwave.plans.registry import query, r6, rounded
from tripwave.plans.views import LI_FEATURES, VEC_SQL, li, vec
from tripwave.sources import stage

DIMS = tuple(f"f{i}" for i in range(64))
SMALL = {"numTrees": 20, "maxDepth": 5}
BOOST = {"maxIter": 10, "maxDepth": 3}


FOREST_SPACE = {"numTrees": (10, 30, "int"), "maxDepth": (2, 6, "int"), "subsamplingRate": (0.5, 1.0, "float")}
BOOSTED_SPACE = {**models.SEARCH_SPACE, "maxIter": (4, 10, "int"), "maxDepth": (2, 4, "int")}


def _table(spark, folder):
    v = vec(spark, folder)
    return v.select(F.col("vec_id").alias("event_id"), "trip_id", F.col("cls").alias("label_idx"),
                    *[F.col("x")[i].alias(f) for i, f in enumerate(DIMS)])


def _task(**params):
    return models.Task(features=DIMS, params=params)


def _folds(rows, k=3):
    return split.group_kfold(rows, "trip_id", "label_idx", (0, 1, 2), k)


@query("train_oof")
def train_oof(spark, folder):
    """Boosted models, trip-isolated folds, out-of-fold probabilities."""
    rows = _table(spark, folder)
    oof = models.out_of_fold(rows, _folds(rows, 2), _task(**BOOST), models.train_boosted)
    return oof.select("event_id", "trip_id", "fold", "label_idx", "pred", F.transform("proba", lambda p: r6(p)).alias("proba"))


@query("forest_vote")
def forest_vote(spark, folder):
    """Soft vote of a forest and boosted models."""
    rows = _table(spark, folder)
    out = models.vote([models.train_forest(rows, _task(**SMALL))(rows), models.train_boosted(rows, _task(**BOOST))(rows)], "event_id")
    return out.select("event_id", best_class(F.col("proba")).alias("pred"), r6(F.array_max("proba")).alias("confidence"))


@query("isotonic")
def isotonic(spark, folder):
    """Calibrated probabilities from out-of-fold forest scores."""
    rows = _table(spark, folder)
    oof = models.out_of_fold(rows, _folds(rows), _task(**SMALL), models.train_forest)
    out = models.calibrate(oof, _task())(oof)
    return out.select("event_id", F.transform("calibrated", lambda p: r6(p)).alias("calibrated"))


@query("search")
def search(spark, folder):
    rows = _table(spark, folder)
    return models.search(rows, _folds(rows, 2), _task(), 6, FOREST_SPACE, "forest").withColumn("value", r6("value"))


@query("search_boosted")
def search_boosted(spark, folder):
    """Boosted trials, the weaker half of which is stopped after the first fold."""
    rows = _table(spark, folder)
    return models.search(rows, _folds(rows, 2), _task(), 4, BOOSTED_SPACE).withColumn("value", r6("value"))


@query("ablate_features")
def ablate_features(spark, folder):
    rows = _table(spark, folder)
    ranking = [f for f, _ in models.importances(rows, _task(**SMALL))]
    return rounded(models.ablate_features(rows, _folds(rows, 2), _task(**SMALL), ranking, [None, 16, 4]), "f1")


@query("ablate_data")
def ablate_data(spark, folder):
    """All eight on/off combinations of undersampling, augmentation and oversampling."""
    rows = _table(spark, folder)

    def fewer(d):
        return sampling.undersample(d.withColumn("key", F.xxhash64("event_id")), "label_idx", 0, ["key"], 0.4).drop("key")

    def noisy_copies(d):
        copies = d.where("label_idx > 0").withColumn("_x", F.array(*DIMS))
        made = sampling.augment(copies, "event_id", ["_x"], len(DIMS), warp_prob=0.0, drop_prob=0.0)
        return d.unionByName(made.withColumns({f: F.col("_x")[i] for i, f in enumerate(DIMS)}).select(*d.columns))

    def balanced(d):
        out = sampling.smote(d.withColumn("_x", F.array(*DIMS)), "event_id", "label_idx", "_x")
        return out.select("event_id", "label_idx", *[F.col("_x")[i].alias(f) for i, f in enumerate(DIMS)])

    steps = {"undersample": fewer, "augment": noisy_copies, "smote": balanced}
    return rounded(models.ablate_data(rows, _folds(rows, 2), _task(numTrees=4, maxDepth=3), steps), "macro_f1")


@query("importance_top")
def importance_top(spark, folder):
    return rounded(models.importance_table(_table(spark, folder), _task(**SMALL), 5), "importance")


@query("batch_score")
def batch_score(spark, folder, path=None):
    """Pipeline saved, loaded again, applied to all rows; ``path`` names one that is saved already."""
    rows = _table(spark, folder)
    path = path or models.save_pipeline(rows, _task(**SMALL), stage.new_folder(spark, "model"))
    out = models.batch_score(rows, path)
    return out.select("event_id", best_class(F.col("proba")).alias("pred"), r6(F.array_max("proba")).alias("confidence"))


PRUNED = [*LI_FEATURES, "qty2", "net", "tax2", "unit"]


def pruning_rows(spark, folder):
    """Line items with four derived, correlated features; the label is the return flag's index."""
    q, p, d, t = (F.col(c) for c in LI_FEATURES)
    return li(spark, folder).withColumns({"qty2": q * q, "net": p * (1 - d), "tax2": t * t, "unit": p / q}).withColumn(
        "label_idx", F.array_position(F.array(*[F.lit(x) for x in "ANR"]), F.col("cls")).cast("int") - 1)


@query("prune_features")
def prune_features(spark, folder):
    """Greedy pruning ranked by forest importance."""
    task = models.Task(features=tuple(PRUNED), params=SMALL)
    return rounded(models.select_features(pruning_rows(spark, folder), task, 0.75, 4), "correlation", "importance")


NEAR_SQL = f"""{VEC_SQL}, near AS (
  SELECT a.vec_id, a.cls, b.vec_id AS other, b.x AS y, list_distance(a.x, b.x) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
  FROM vec a JOIN vec b ON a.cls = b.cls AND a.vec_id <> b.vec_id)"""


@query("neighbours", f"WITH {NEAR_SQL} SELECT cls, vec_id, rank, other, r6(distance) AS distance FROM near WHERE rank <= 5")
def neighbours(spark, folder):
    """The five nearest rows of every row among those of its class, over whole vectors."""
    v = vec(spark, folder)
    out = None
    for cls in (0, 1, 2):
        one = sampling.neighbours(v.where(F.col("cls") == cls), "vec_id", "x", 5).select(
            F.lit(cls).cast("int").alias("cls"), "vec_id", "rank", "other", r6("distance").alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


def _unit_sql(seed: int) -> str:
    key = f"md5(vec_id::VARCHAR || ':' || copy::VARCHAR || ':{seed}')"
    return f"('0x' || substr({key}, 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


SMOTE_SQL = f"""{NEAR_SQL}, sizes AS (SELECT cls, count(*) AS n FROM vec GROUP BY cls),
goal AS (SELECT cls, n, (SELECT max(n) FROM sizes) - n AS missing, (SELECT least(5, min(n) - 1) FROM sizes) AS k FROM sizes),
placed AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id) - 1 AS i FROM vec),
wanted AS (SELECT vec_id, cls, x, k, unnest(range(1, (missing // n + CASE WHEN i < missing % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy
  FROM placed JOIN goal USING (cls)),
drawn AS (SELECT *, floor({_unit_sql(43)} * k) + 1 AS rank, {_unit_sql(44)} AS u FROM wanted),
made AS (SELECT 'syn_' || d.vec_id::VARCHAR || '_' || copy::VARCHAR AS vec_id, d.cls, true AS synthetic, x, y, u
  FROM drawn d JOIN near n ON n.vec_id = d.vec_id AND n.rank = d.rank),
flat AS (
  SELECT vec_id::VARCHAR AS vec_id, cls, false AS synthetic, unnest(range(64)) AS i, unnest(x) AS v FROM vec
  UNION ALL
  SELECT vec_id, cls, synthetic, unnest(range(64)), unnest(list_transform(range(1, 65), lambda j: x[j] + u * (y[j] - x[j]))) FROM made)"""


@query("smote", f"WITH {SMOTE_SQL} SELECT vec_id, cls, synthetic, i, r6(v) AS v FROM flat")
def smote(spark, folder):
    """Smaller classes brought to the size of the largest by interpolation between exact neighbours."""
    out = sampling.smote(vec(spark, folder).select("vec_id", "cls", "x"), "vec_id", "cls", "x")
    return out.select("vec_id", "cls", "synthetic", F.posexplode("x").alias("i", "v")).select(
        "vec_id", "cls", "synthetic", F.col("i").cast("bigint").alias("i"), r6("v").alias("v"))


def _draw_sql(name: str, more: str = "", at: int = 1) -> str:
    key = f"md5(vec_id::VARCHAR || ':{name}'{more} || ':42')"
    return f"(('0x' || substr({key}, {at}, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def _augmented_sql(c: int, part: str) -> str:
    """Values of channel ``c`` at the 24 samples, from the crop in ``part``."""
    more = f" || ':{c}:' || (j - 1)::VARCHAR"
    normal = f"sqrt(-2 * ln(1 - {_draw_sql('noise', more)})) * cos(2 * pi() * {_draw_sql('noise', more, 17)})"
    moved = f"({part}[lo(src[j]) + 1] + (src[j] - lo(src[j])) * ({part}[least(lo(src[j]) + 2, 24)] - {part}[lo(src[j]) + 1]))"
    gain = f"(0.85 + {_draw_sql('scale', f" || ':{c}'")} * 0.3)"
    return f"""list_transform(range(1, 25), lambda j: CASE WHEN {_draw_sql('drop')} < 0.1 AND floor({_draw_sql('dropped')} * 2) = {c} THEN 0.0
      ELSE ({moved} + 0.02 * {normal}) * {gain} END)""".replace("lo(src[j])", "floor(src[j])::INT")


AUGMENT_SQL = f"""{VEC_SQL},
k AS (SELECT *, floor({_draw_sql('crop')} * 9)::INT AS cut_at, {_draw_sql('warp')} < 0.8 AS warped,
  list_transform(range(0, 6), lambda n: CASE WHEN n IN (0, 5) THEN 0.0 ELSE ({_draw_sql('knot', " || ':' || n::VARCHAR")} * 2 - 1) * 2.4 END) AS off FROM vec),
w AS (SELECT *, x[cut_at + 1:cut_at + 24] AS a, x[cut_at + 33:cut_at + 56] AS b, list_transform(range(0, 24), lambda j: CASE WHEN warped THEN greatest(0.0, least(23.0,
  j + off[least(4, floor(j * 5 / 23.0))::INT + 1] + (j * 5 / 23.0 - least(4, floor(j * 5 / 23.0))) * (off[least(4, floor(j * 5 / 23.0))::INT + 2] - off[least(4, floor(j * 5 / 23.0))::INT + 1])))
  ELSE j::DOUBLE END) AS src FROM k),
made AS (SELECT vec_id, {_augmented_sql(0, 'a')} AS a, {_augmented_sql(1, 'b')} AS b FROM w)"""


@query("augment_windows", f"WITH {AUGMENT_SQL} SELECT vec_id, unnest(range(24)) AS i, r6(unnest(a)) AS a, r6(unnest(b)) AS b FROM made")
def augment_windows(spark, folder):
    """Seeded crop, warp, noise, scale and channel drop of two-channel windows; every value compared."""
    v = vec(spark, folder).select("vec_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))
    out = sampling.augment(v, "vec_id", ["a", "b"], 24)
    flat = out.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "_v"))
    return flat.select("vec_id", F.col("i").cast("bigint").alias("i"), r6("_v.a").alias("a"), r6("_v.b").alias("b"))


@query("smote_counts", f"""WITH {VEC_SQL}, s AS (SELECT cls, count(*) AS n FROM vec GROUP BY cls)
SELECT cls, n AS original, (SELECT max(n) FROM s) AS total FROM s""")
def smote_counts(spark, folder):
    out = sampling.smote(vec(spark, folder).select("vec_id", "cls", "x"), "vec_id", "cls", "x")
    return out.groupBy("cls").agg(F.count_if(~F.col("synthetic")).alias("original"), F.count(F.lit(1)).alias("total"))
