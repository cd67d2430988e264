"""What must hold of trained, random or iterative results whatever the model: facts that SQL derives from the tables.

Each query runs one of the queries without SQL over its whole table and states per row
what follows from the input alone: every id once, folds by trip, distributions that sum
to one, decisions that agree with their scores, reruns and reloads that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from tripwave.functions.exprs import best_class
from tripwave.operators import models
from tripwave.operators.aggregates import correlation_pairs
from tripwave.plans import model_queries, report_queries, stream_queries
from tripwave.plans.registry import query
from tripwave.plans.views import LI_SQL, VEC_SQL
from tripwave.sources import stage


def _about(value: Column, wanted: float, off: float = 1e-5) -> Column:
    return F.coalesce(F.abs(value - wanted) <= off, F.lit(False))


@query("train_oof_facts", f"""WITH {VEC_SQL} SELECT vec_id AS event_id, trip_id, cls AS label_idx, 1::BIGINT AS times,
  true AS one_fold, true AS sums_to_one, true AS decided_by_score FROM vec""")
def train_oof_facts(spark, folder):
    """Every row scored once, all rows of a trip in one fold, probabilities summing to one, the decision their largest."""
    rows = model_queries.train_oof(spark, folder)
    folds = rows.groupBy("trip_id").agg(F.count_distinct("fold").alias("_folds"))
    each = rows.groupBy("event_id", "trip_id", "label_idx").agg(
        F.count(F.lit(1)).alias("times"), F.first("proba").alias("_p"), F.first("pred").alias("_pred"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    return each.join(folds, "trip_id").select(
        "event_id", "trip_id", "label_idx", "times", (F.col("_folds") == 1).alias("one_fold"),
        _about(total, 1.0).alias("sums_to_one"), (F.get("_p", F.col("_pred")) >= F.array_max("_p") - 1e-5).alias("decided_by_score"))


@query("forest_vote_facts", f"WITH {VEC_SQL} SELECT vec_id AS event_id, true AS known_class, true AS confident FROM vec")
def forest_vote_facts(spark, folder):
    """A vote for every row, for one of three classes, with at least a third of the weight."""
    return model_queries.forest_vote(spark, folder).select(
        "event_id", F.col("pred").isin(0, 1, 2).alias("known_class"), F.col("confidence").between(0.333, 1.0).alias("confident"))


@query("isotonic_facts", f"WITH {VEC_SQL} SELECT vec_id AS event_id, 3 AS classes, true AS sums_to_one, true AS in_range FROM vec")
def isotonic_facts(spark, folder):
    c = F.col("calibrated")
    return model_queries.isotonic(spark, folder).select(
        "event_id", F.size(c).alias("classes"), _about(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 1.0).alias("sums_to_one"),
        F.forall(c, lambda x: x.between(0.0, 1.0)).alias("in_range"))


def _search_facts(found, space):
    """Every trial once, the best of those that went furthest first, parameters inside their space."""
    found = found.withColumn("_at", F.monotonically_increasing_id())
    before = F.lag("value").over(Window.partitionBy("folds").orderBy("_at"))  # one row per trial
    inside = F.lit(True)
    for name, (low, high, _) in space.items():
        inside = inside & F.col("params")[name].cast("double").between(low, high)
    return found.select("trial", F.col("value").between(0.0, 1.0).alias("in_range"), (F.col("folds") >= 1).alias("scored"),
                        F.coalesce(before >= F.col("value"), F.lit(True)).alias("best_first"), inside.alias("drawn_inside"))


@query("search_facts", "SELECT unnest(range(6))::INTEGER AS trial, true AS in_range, true AS scored, true AS best_first, true AS drawn_inside")
def search_facts(spark, folder):
    return _search_facts(model_queries.search(spark, folder), model_queries.FOREST_SPACE)


@query("search_boosted_facts", "SELECT unnest(range(4))::INTEGER AS trial, true AS in_range, true AS scored, true AS best_first, true AS drawn_inside")
def search_boosted_facts(spark, folder):
    return _search_facts(model_queries.search_boosted(spark, folder), model_queries.BOOSTED_SPACE)


@query("ablate_data_facts", """SELECT a AS undersample, b AS augment, c AS smote, true AS in_range
FROM (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(b), (VALUES (true), (false)) z(c)""")
def ablate_data_facts(spark, folder):
    """Every on/off combination once, with a score."""
    return model_queries.ablate_data(spark, folder).select("undersample", "augment", "smote", F.col("macro_f1").between(0.0, 1.0).alias("in_range"))


@query("ablate_features_facts", f"""WITH {VEC_SQL} SELECT n AS n_features, cls::VARCHAR AS label, true AS in_range
FROM (SELECT DISTINCT cls FROM vec) c, (VALUES (4), (16), (64)) t(n)""")
def ablate_features_facts(spark, folder):
    """A score of every class for every number of features."""
    return model_queries.ablate_features(spark, folder).where("label in ('0', '1', '2')").select(
        "n_features", "label", F.col("f1").between(0.0, 1.0).alias("in_range"))


@query("importance_top_facts", "SELECT unnest(range(1, 6))::INTEGER AS rank, true AS known, true AS falling")
def importance_top_facts(spark, folder):
    """Five different features, their importance falling with the rank."""
    rows = model_queries.importance_top(spark, folder)
    before = F.lag("importance").over(Window.partitionBy(F.lit(0)).orderBy("rank"))  # five rows
    return rows.select("rank", F.col("feature").isin(*model_queries.DIMS).alias("known"),
                       F.coalesce(before >= F.col("importance"), F.lit(True)).alias("falling"))


@query("batch_score_facts", f"WITH {VEC_SQL} SELECT vec_id AS event_id, true AS same_pred, true AS same_confidence FROM vec")
def batch_score_facts(spark, folder):
    """A pipeline that was saved and loaded decides like before; fitted once, as two fits over shuffled rows may differ."""
    rows = model_queries._table(spark, folder)
    model = models.fit_pipeline(rows, model_queries._task(**model_queries.SMALL))
    model.write().save(path := stage.new_folder(spark, "model"))
    direct = models.score_with(model, rows).select("event_id", best_class(F.col("proba")).alias("_pred"), F.array_max("proba").alias("_best"))
    both = model_queries.batch_score(spark, folder, path).join(direct, "event_id")
    return both.select("event_id", (F.col("pred") == F.col("_pred")).alias("same_pred"),
                       _about(F.col("confidence") - F.col("_best"), 0.0).alias("same_confidence"))


@query("stream_scoring_facts", f"WITH {VEC_SQL} SELECT vec_id AS event_id, 1::BIGINT AS times, true AS same_pred FROM vec")
def stream_scoring_facts(spark, folder):
    """Rows scored as a stream come once and as in a batch by the same saved pipeline."""
    path = models.save_pipeline(model_queries._table(spark, folder), model_queries._task(**model_queries.SMALL), stage.new_folder(spark, "model"))
    batch = model_queries.batch_score(spark, folder, path).select("event_id", F.col("pred").alias("_pred"))
    live = stream_queries.stream_scoring(spark, folder, path).groupBy("event_id").agg(F.count(F.lit(1)).alias("times"), F.max("pred").alias("pred"))
    return live.join(batch, "event_id").select("event_id", "times", (F.col("pred") == F.col("_pred")).alias("same_pred"))


@query("pca2_facts", f"""WITH {LI_SQL} SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS eigenvalue FROM li""")
def pca2_facts(spark, folder):
    """Components that are centred, uncorrelated and ordered; the first one's variance is an eigenvalue of the correlations."""
    import numpy as np

    rows = report_queries.pca2(spark, folder)
    feats = report_queries.LI_FEATURES
    table = report_queries.li(spark, folder)
    corr = table.select(*[F.corr(a, b).alias(f"{a}|{b}") for a in feats for b in feats]).first()  # k x k numbers
    top = float(np.linalg.eigvalsh(np.array(list(corr)).reshape(len(feats), -1))[-1])
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (_about(F.avg("pc1"), 0.0, 1e-4) & _about(F.avg("pc2"), 0.0, 1e-4)).alias("centred"),
        _about(F.corr("pc1", "pc2"), 0.0, 1e-4).alias("uncorrelated"), (F.var_samp("pc1") >= F.var_samp("pc2")).alias("ordered"),
        _about(F.var_samp("pc1"), top, 1e-3).alias("eigenvalue"))


@query("prune_features_facts", f"""WITH f(feature) AS (VALUES {', '.join(f"('{x}')" for x in model_queries.PRUNED)}),
w AS (SELECT *, l_quantity * l_quantity AS qty2, l_extendedprice * (1 - l_discount) AS net, l_tax * l_tax AS tax2, l_extendedprice / l_quantity AS unit FROM lineitem),
c AS (SELECT {', '.join(f'abs(corr({a}, {b})) AS "{a}|{b}"' for a in model_queries.PRUNED for b in model_queries.PRUNED if a < b)} FROM w),
strong AS (SELECT split_part(name, '|', 1) AS a, split_part(name, '|', 2) AS b FROM (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE r) WHERE r > 0.75)
SELECT feature, list_sort(coalesce((SELECT list(CASE WHEN a = feature THEN b ELSE a END) FROM strong WHERE feature IN (a, b)), [])) AS partners,
  true AS dropped_for_a_partner, true AS partner_is_stronger, true AS kept_ones_are_apart FROM f""")
def prune_features_facts(spark, folder):
    """A feature is dropped only for a kept partner of at least its importance that correlates with it beyond the limit,
    and no two kept features correlate so; the partners of each feature are SQL's."""
    rows = model_queries.prune_features(spark, folder)
    pairs = correlation_pairs(model_queries.pruning_rows(spark, folder), model_queries.PRUNED).where(F.abs("r") > 0.75)
    both = pairs.select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("_other")).unionByName(
        pairs.select(F.col("feature_b").alias("feature"), F.col("feature_a").alias("_other")))
    kept = rows.where("redundant_with is null").select(F.col("feature").alias("_other"), F.col("importance").alias("_weight"))
    near = both.join(kept, "_other", "left").groupBy("feature").agg(
        F.array_sort(F.collect_list("_other")).alias("partners"), F.collect_list(F.when(F.col("_weight").isNotNull(), F.col("_other"))).alias("_kept"))
    strength = kept.withColumnsRenamed({"_other": "redundant_with"})
    out = rows.join(near, "feature", "left").join(strength, "redundant_with", "left")
    none = F.array().cast("array<string>")
    dropped = F.col("redundant_with").isNotNull()
    return out.select(
        "feature", F.coalesce("partners", none).alias("partners"),
        F.coalesce(~dropped | F.array_contains("_kept", F.col("redundant_with")), F.lit(False)).alias("dropped_for_a_partner"),
        F.coalesce(~dropped | (F.col("_weight") >= F.col("importance")), F.lit(False)).alias("partner_is_stronger"),
        (dropped | (F.size(F.coalesce("_kept", none)) == 0)).alias("kept_ones_are_apart"))
