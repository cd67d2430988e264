"""Queries that write table data in a source's file format and read it back through the reader."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tripwave.operators import split
from tripwave.operators.reconcile import upsert
from tripwave.plans.registry import query, r6, rounded
from tripwave.plans.views import (HOUR_US, MARKED_SQL, SENSOR_SQL, SIG_SQL, VEC_SQL, marked, sensor, sig, vec)
from tripwave.sources import logs, stage, trips
from tripwave.sources.tables import read_table


@query("scan_with_key", f"""WITH {SENSOR_SQL} SELECT trip_id % 8 AS shard, count(*) AS n, r6(sum(lin_az)) AS lin_az, r6(sum(gx)) AS gx, max(ts_us // 1000) AS last_ms
FROM sensor GROUP BY 1""")
def scan_with_key(spark, folder):
    """Samples written as CSV shards, scanned with a fixed schema, keyed by file path."""
    s = sensor(spark, folder)
    cols = ["ax", "ay", "az"]
    out = s.select(F.floor(F.col("ts_us") / 1000).cast("double").alias("timestamp"), *[F.lit(0.0).alias(c) for c in cols],
                   *[c for c in trips.SAMPLE_SCHEMA.fieldNames() if c not in ("timestamp", *cols)], (F.col("trip_id") % 8).alias("shard"))
    path = stage.new_folder(spark, "csv")
    out.write.partitionBy("shard").csv(path, header=True)
    rows = trips.read_trip_csv(spark, f"{path}/shard=*")
    keyed = rows.withColumn("shard", F.regexp_extract("trip_folder", r"shard=(\d+)", 1).cast("bigint"))
    return rounded(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("lin_az").alias("lin_az"), F.sum("gx").alias("gx"),
                                              F.max("ts_ms").alias("last_ms")), "lin_az", "gx")


@query("scan_mixed_layouts", f"""WITH {SENSOR_SQL}, n AS (SELECT *, event_type || ', "' || g::VARCHAR || '", end' AS note FROM sensor)
SELECT trip_id % 3 AS layout, count(*) AS n, r6(sum(CASE WHEN trip_id % 3 = 2 THEN lin_az * 2 ELSE lin_az + grav_z END)) AS az, r6(sum(gx)) AS gx,
  CASE WHEN trip_id % 3 = 1 THEN count(*) END AS n_notes, CASE WHEN trip_id % 3 = 1 THEN sum(length(note))::BIGINT END AS note_chars,
  CASE WHEN trip_id % 3 = 1 THEN max(note) END AS last_note, max(ts_us // 1000) AS last_ms FROM n GROUP BY 1""")
def scan_mixed_layouts(spark, folder):
    """CSVs of three layouts in one folder: other column orders, no ax, ay, az, a text column in front whose cells
    hold commas and quotes, and accelerations under other names."""
    s = sensor(spark, folder).withColumn("timestamp", F.floor(F.col("ts_us") / 1000).cast("double"))
    s = s.withColumn("note", F.concat("event_type", F.lit(', "'), F.col("g").cast("string"), F.lit('", end')))
    path = stage.new_folder(spark, "layouts")
    names = [c for c in trips.SAMPLE_SCHEMA.fieldNames() if c not in ("ax", "ay", "az")]
    other = [c for c in names if not c.startswith(("lin_", "grav_"))]
    doubled = [(F.col(f"lin_a{a}") * 2).alias(f"accel_{a}") for a in "xyz"]
    for layout, columns in ((0, names), (1, ["note", *reversed(names)]), (2, [*doubled, *other])):
        part = s.where(F.col("trip_id") % 3 == layout).select(*columns)
        part.write.csv(f"{path}/layout={layout}", header=True, escape='"')
    schema = T.StructType([*trips.SAMPLE_SCHEMA.fields, T.StructField("note", T.StringType())])
    rows = trips.read_trip_csv(spark, f"{path}/layout=*", schema)
    rows = rows.withColumn("layout", F.regexp_extract("trip_folder", r"layout=(\d+)", 1).cast("bigint"))
    return rounded(rows.groupBy("layout").agg(
        F.count(F.lit(1)).alias("n"), F.sum("az").alias("az"), F.sum("gx").alias("gx"),
        F.when(F.count("note") > 0, F.count("note")).alias("n_notes"), F.sum(F.length("note")).alias("note_chars"),
        F.max("note").alias("last_note"), F.max("ts_ms").alias("last_ms")), "az", "gx")


@query("scan_checked", f"""WITH {SENSOR_SQL} SELECT count(*) AS n, r6(sum(speed)) AS speed, r6(sum(v / 1000)) AS prob FROM sensor WHERE event_type <> 'error'""")
def scan_checked(spark, folder):
    """Field-test CSV with both probabilities; rows without a position are dropped on read."""
    s = sensor(spark, folder)
    lost = F.when(F.col("event_type") != "error", F.col("lat"))
    out = s.select(F.floor(F.col("ts_us") / 1000).alias("timestamp"), lost.alias("lat"), "lon", "speed",
                   (F.col("v") / 1000).alias("prob_pothole"), F.lit(0.0).alias("prob_speedbump"))
    path = stage.new_folder(spark, "field")
    out.write.csv(path, header=True)
    return rounded(trips.read_field_test(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed"), F.sum("prob_pothole").alias("prob")), "speed", "prob")


@query("json_map_explode", f"""WITH {SIG_SQL}, {MARKED_SQL} SELECT trip_id::VARCHAR AS trip_id, (ev % 100000)::INTEGER AS event_no, label,
  CASE WHEN trip_id % 4 > 0 THEN r6(m.at / 1e6) END AS time_s FROM marked m""")
def json_map_explode(spark, folder):
    """Label documents with event maps (every fourth trip in the older form without times), exploded."""
    m = marked(spark, folder).withColumn("no", (F.col("ev") % 100000).cast("string"))
    # a document holds a number once
    docs = m.groupBy("trip_id", F.floor(F.col("at") / (24 * HOUR_US)).alias("day"), F.floor(F.col("ev") / 100000).alias("round")).agg(
        F.map_from_entries(F.collect_list(F.struct("no", "label"))).alias("labels"),
        F.map_from_entries(F.collect_list(F.struct("no", F.col("at") / 1e6))).alias("times"))
    docs = docs.select(F.lit(0).alias("trip_index"), F.col("trip_id").cast("string").alias("trip_id"), F.lit("").alias("labeled_at"),
                       F.lit("").alias("notes"), F.when(F.col("trip_id") % 4 > 0, F.col("times")).alias("event_mapping"), "labels")
    path = stage.new_folder(spark, "labels")
    docs.write.json(path)
    return trips.read_labels(spark, path, multi_line=False).select("trip_id", "event_no", "label", r6("time_s").alias("time_s"))


@query("meta_pairing", """SELECT CASE WHEN user_id % 3 = 0 THEN 'Road_' || user_id::VARCHAR || '.csv' ELSE 'trip-' || user_id::VARCHAR END AS trip_id, count(*) AS n FROM events GROUP BY 1""")
def meta_pairing(spark, folder):
    """Metadata documents read back and paired with samples by base name; unpaired files keep their own name."""
    e = read_table(spark, folder, "events")
    name = F.concat(F.lit("Road_"), F.col("user_id").cast("string"))
    meta = e.where("user_id % 3 > 0").groupBy("user_id").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("startTime"))
    path = stage.new_folder(spark, "meta")
    meta.select(F.concat(F.lit("trip-"), F.col("user_id").cast("string")).alias("tripId"), "startTime", name.alias("trip_file")).write.json(path)
    docs = spark.read.schema(T.StructType([*trips.META_SCHEMA.fields, T.StructField("trip_file", T.StringType())])).json(path)
    return trips.pair_meta(e.select(name.alias("trip_file"), "event_id"), docs, ["event_id"]).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))


@query("stage_roundtrip", f"""WITH {SIG_SQL} SELECT event_id, trip_id, v, cls FROM sig""")
def stage_roundtrip(spark, folder):
    """Stage table written by key hash as Parquet, then as CSV, and read with its schema."""
    s = sig(spark, folder).select("event_id", "trip_id", "v", "cls")
    back = stage.read_stage(spark, stage.write_stage(s, stage.new_folder(spark, "stage"), "trip_id", 8)).select(*s.columns)
    path = stage.write_stage(back, stage.new_folder(spark, "stage-csv"), fmt="csv")
    return stage.read_stage(spark, path, back.schema, "csv")


@query("tensor_sink", f"""WITH {VEC_SQL} SELECT vec_id, cls AS y, trip_id AS group_id, unnest(range(64)) % 32 AS i, unnest(range(64)) // 32 AS channel,
  r6(unnest(embedding)::DOUBLE) AS v FROM vec""")
def tensor_sink(spark, folder):
    """Two float channels per row with label, group and id, written and read back as Parquet; every element compared."""
    x = F.col("x").cast("array<float>")
    v = vec(spark, folder).select("vec_id", F.col("cls").alias("y"), F.col("trip_id").alias("group_id"),
                                  F.slice(x, 1, 32).alias("x0"), F.slice(x, 33, 32).alias("x1"))
    back = stage.read_stage(spark, stage.write_stage(v, stage.new_folder(spark, "tensors"), "vec_id", 4))
    flat = back.select("vec_id", "y", "group_id", F.posexplode(F.array("x0", "x1")).alias("channel", "_x"))
    flat = flat.select("vec_id", "y", "group_id", "channel", F.posexplode("_x").alias("i", "v"))
    return flat.select("vec_id", "y", "group_id", F.col("i").cast("bigint").alias("i"), F.col("channel").cast("bigint").alias("channel"),
                       r6(F.col("v").cast("double")).alias("v"))


@query("worklist_sink", f"""WITH {SIG_SQL} SELECT event_id, lat, lon, v AS score, '' AS label, '' AS notes,
  'https://www.google.com/maps?q=' || g::VARCHAR || ',' || (event_id % 10)::VARCHAR AS maps_link FROM sig""")
def worklist_sink(spark, folder):
    """Work list in the fixed column order, best score first, with map links."""
    s = sig(spark, folder)
    rows = stage.worklist_rows(s.select("event_id", F.col("v").alias("score"), F.col("g").alias("lat"), (F.col("event_id") % 10).alias("lon")))
    path = stage.write_stage(rows, stage.new_folder(spark, "worklist"))
    # merged: the file's size says little of a list that is mostly empty columns
    back = stage.read_stage(spark, path).hint("merge")
    return back.join(s.select("event_id", F.col("lat").alias("y"), F.col("lon").alias("x")), "event_id").select(
        "event_id", F.col("y").alias("lat"), F.col("x").alias("lon"), "score", "label", "notes", "maps_link")


@query("empty_schema_sink", """SELECT count(*) AS n, 44::BIGINT AS n_columns FROM events WHERE value < -1""")
def empty_schema_sink(spark, folder):
    """A work list without rows is still a file with the whole schema."""
    none = read_table(spark, folder, "events").where("value < -1").limit(1)
    empty = stage.empty_worklist(spark)
    rows = empty.unionByName(none.select(F.col("event_id").cast("string").alias("event_id")), allowMissingColumns=True)
    back = stage.read_stage(spark, stage.write_stage(rows, stage.new_folder(spark, "empty")))
    return back.agg(F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(back.columns)).cast("bigint"))


@query("params_broadcast", f"""WITH {VEC_SQL}, u AS (SELECT unnest(x) AS e FROM vec), s AS (SELECT avg(e) AS m, stddev_pop(e) AS d FROM u)
SELECT vec_id, unnest(range(64)) AS i, r6(unnest(list_transform(x, lambda e: (e - m) / d))) AS z FROM vec JOIN s ON true""")
def params_broadcast(spark, folder):
    """Scaler parameters saved as JSON, loaded and applied."""
    v = vec(spark, folder).select("vec_id", "x")
    fitted = split.scaler(v, ["x"])
    path = stage.save_params(fitted, stage.new_folder(spark, "params"))
    out = split.apply_scaler(v, stage.load_params(spark, path, fitted.schema), ["x"])
    return out.select("vec_id", F.posexplode("x").alias("i", "z")).select("vec_id", F.col("i").cast("bigint").alias("i"), r6("z").alias("z"))


LOG_SQL = """lg AS (SELECT doc_id, (doc_id % 8)::INTEGER AS run, (doc_id % 24 // 8 + 1)::INTEGER AS fold, (doc_id // 24 + 1)::INTEGER AS epoch,
   (n_chars % 1000) / 1000.0 AS a, (n_chars % 777) / 1000.0 AS b, CASE WHEN doc_id % 5 > 0 THEN (n_chars % 99) / 100.0 END AS f FROM documents)"""


@query("log_epochs", f"""WITH {LOG_SQL} SELECT run, fold, epoch, round(a, 4) AS train_loss, round(b, 4) AS val_loss, round(f, 4) AS val_f1 FROM lg""")
def log_epochs(spark, folder):
    """Training logs, one file per run, written as text and parsed back."""
    n, d = F.col("n_chars"), F.col("doc_id")
    rows = read_table(spark, folder, "documents").select(
        (d % 8).cast("int").alias("run"), (F.floor(d % 24 / 8) + 1).cast("int").alias("fold"), (F.floor(d / 24) + 1).cast("int").alias("epoch"),
        (n % 1000 / 1000).alias("a"), (n % 777 / 1000).alias("b"), F.when(d % 5 > 0, n % 99 / 100).alias("f"))
    tail = F.when(F.col("f").isNotNull(), F.format_string(" | Val Macro F1: %.4f", "f")).otherwise("")
    line = F.concat(F.lit("17:41:17 -   "), F.format_string("[Epoch %02d/50] Train Loss: %.4f | Val Loss: %.4f", "epoch", "a", "b"), tail)
    epochs = rows.select("run", "fold", "epoch", line.alias("line"))
    heads = rows.select("run", "fold").distinct().select("run", "fold", F.lit(0).alias("epoch"), F.format_string("17:39:39 - === Fold %d ===", "fold").alias("line"))
    path = stage.new_folder(spark, "logs")
    ordered = epochs.unionByName(heads).repartition("run").sortWithinPartitions("run", "fold", "epoch")
    ordered.select("run", "line").write.partitionBy("run").text(path)
    back = logs.read_epochs(spark, path)
    run = F.regexp_extract("file", r"run=(\d+)", 1).cast("int")
    return back.select(run.alias("run"), "fold", "epoch", "train_loss", "val_loss", "val_f1")


@query("log_trials", """SELECT (doc_id)::INTEGER AS trial, round((n_chars % 1000) / 1000.0, 4) AS value, (n_chars % 9)::VARCHAR AS max_depth, lang FROM documents""")
def log_trials(spark, folder):
    """Tuning logs with parameter dictionaries, parsed back."""
    n = F.col("n_chars")
    rows = read_table(spark, folder, "documents")
    line = F.format_string("[I 2026-01-01] Trial %d finished with value: %.4f and parameters: {'max_depth': %d, 'lang': '%s'}. Best is trial 0.",
                           "doc_id", n % 1000 / 1000, n % 9, "lang")
    path = stage.new_folder(spark, "trials")
    rows.select(line.alias("line")).write.text(path)
    return logs.read_trials(spark, path).select("trial", "value", F.col("params")["max_depth"].alias("max_depth"), F.col("params")["lang"].alias("lang"))


@query("sensitivity_table", """WITH r AS (SELECT (doc_id % 6) AS k, avg(n_chars % 1000) / 1000 AS f1, avg(n_chars % 77) / 100 AS loss FROM documents GROUP BY 1)
SELECT k::DOUBLE AS batch_size, r6(f1) AS val_macro_f1, r6(loss) AS val_loss, r6(f1 / 2) AS pothole_f1 FROM r""")
def sensitivity_table(spark, folder):
    """Sweep results written as JSON, read back and ranked."""
    n = F.col("n_chars")
    runs = read_table(spark, folder, "documents").groupBy((F.col("doc_id") % 6).alias("batch_size")).agg(
        (F.avg(n % 1000) / 1000).alias("val_macro_f1"), (F.avg(n % 77) / 100).alias("val_loss"))
    score = F.struct(F.lit(0.5).alias("precision"), F.lit(0.5).alias("recall"), (F.col("val_macro_f1") / 2).alias("f1_score"))
    runs = runs.withColumn("class_metrics", F.create_map(F.lit("Pothole"), score))
    path = stage.new_folder(spark, "sweep")
    runs.repartition("batch_size").write.option("maxRecordsPerFile", 1).json(path)
    table = logs.sensitivity(logs.read_sweep(spark, path, "batch_size"), "batch_size")
    return rounded(table.select("batch_size", "val_macro_f1", "val_loss", F.col("class_f1")["Pothole"].alias("pothole_f1")), "val_macro_f1", "val_loss", "pothole_f1")


@query("label_versions", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels""")
def label_versions(spark, folder):
    """Label upsert written as a new version beside the old one."""
    base = stage.new_folder(spark, "truth")
    stage.write_version(read_table(spark, folder, "labels").select("doc_id", "quality"), base, 1)
    now = stage.read_version(spark, base, 1)
    changes = now.where("doc_id % 5 = 0").withColumn("quality", 1 - F.col("quality"))
    stage.write_version(upsert(now, changes, "doc_id"), base, 2)
    return stage.read_version(spark, base, 2)
