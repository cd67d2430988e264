"""Small tests of the findings of round 3; each failed before its change."""

import random

import duckdb
from oracle import DATA, compare
from pyspark.sql import functions as F

from tripwave.operators import models, ordered, split
from tripwave.plans import source_queries
from tripwave.plans.catalog import QUERIES, SQL


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_tables_are_never_broadcast(spark):
    big = spark.range(2_000).withColumn("trip", F.col("id") % 50)
    small = spark.range(0, 50, 2).select(F.col("id").alias("trip"), (F.col("id") * 10).alias("x"))
    for how, n in (("inner", 1_000), ("left", 2_000), ("left_semi", 1_000), ("left_anti", 1_000)):
        out = ordered.join_per_key(big, small, ["trip"], ["id"], how)
        assert out.count() == n and "Broadcast" not in plan(out)


def test_salts_do_not_grow_with_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1_000)
    try:
        out = ordered.join_per_key(spark.range(10).withColumn("trip", F.lit(1)), spark.range(3).withColumnRenamed("id", "trip"), ["trip"], ["id"])
        assert f"sequence(0, {ordered.MAX_SALTS - 1}" in out._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def events_folder(spark, rows, tmp_path):
    cols = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*[c.split()[0] for c in cols.split(", ")]).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_work_list_is_not_broadcast(spark, tmp_path):
    folder = events_folder(spark, [(i, "2024-01-01 00:00:11", i % 7, "view", i / 3, '{"k": 5}') for i in range(50)], tmp_path)
    out = source_queries.worklist_sink(spark, folder)
    assert out.count() == 50 and "BroadcastHashJoin" not in plan(out)


def test_event_numbers_that_repeat_in_a_day(spark, tmp_path):
    """Ids a hundred thousand apart have one number; one document cannot hold both."""
    rows = [(i + copy * 100_000, f"2024-01-01 0{i}:00:00", 1, "purchase", 3.0, '{"k": 5}') for i in range(5) for copy in range(3)]
    got = source_queries.json_map_explode(spark, events_folder(spark, rows, tmp_path)).collect()
    assert sorted(r["event_no"] for r in got) == sorted(i for i in range(5) for _ in range(3))


def test_windows_that_begin_level(spark, tmp_path):
    """Two first rows of one height: whether the second is above its threshold hangs on how the averages round."""
    rng, rows = random.Random(5), []
    for trip in range(300):
        level = round(rng.uniform(60, 300), 2)
        for i, v in enumerate((level, level, 51.0, 52.0, 50.5)):
            rows.append((trip * 5 + i, f"2024-01-0{1 + i // 2} {6 * (i % 2) + 1:02d}:00:00", trip, "purchase" if i == 2 else "view", v, '{"k": 5}'))
    folder = events_folder(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert compare(QUERIES["event_run_duration"](spark, folder), con, SQL["event_run_duration"]) == ""


def test_class_weights_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(split.balanced_weights(spark.range(100).withColumn("y", F.col("id") % 3), "y"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_facts_fit_one_model(spark, monkeypatch):
    """Two fits may differ, so what is compared comes from one."""
    fits, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, rows: fits.append(1) or fit(self, rows))
    monkeypatch.setattr(models, "train_forest", None)
    for name in ("batch_score_facts", "stream_scoring_facts"):
        fits.clear()
        rows = QUERIES[name](spark, f"{DATA}/sf0.001").collect()
        assert len(fits) == 1 and all(r["same_pred"] for r in rows)


def test_tensors_of_dense_windows(spark, tmp_path):
    """Six copies of every event at its own time: windows six times as full, and holes that end at rows of one time."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT event_id + k * 100000 AS event_id, ts, user_id, event_type, value, props
        FROM '{DATA}/sf0.001/events.parquet', range(6) t(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert compare(QUERIES["event_tensor"](spark, str(tmp_path)), con, SQL["event_tensor"]) == ""
    assert compare(QUERIES["tensor_reasons"](spark, str(tmp_path)), con, SQL["tensor_reasons"]) == ""


def test_training_features_read_written_samples(spark):
    """The filters are no part of the plan that computes the features."""
    out = QUERIES["training_features"](spark, f"{DATA}/sf0.001")
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().analyzed().toString()
