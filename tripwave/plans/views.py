"""Views that give the driver's tables the shape of trips, labels, vectors and line items.

The matching SQL stands next to each view, so that a query and its check start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwave.operators.ordered import Axis, fitted_chunk_len
from tripwave.sources.tables import read_table

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def sig(spark: SparkSession, folder: str) -> DataFrame:
    return sig_columns(read_table(spark, folder, "events"))


def sig_columns(events: DataFrame) -> DataFrame:
    """Events as trip samples: one trip per user, microsecond clock (session time zone UTC)."""
    g = F.get_json_object("props", "$.k").cast("int")
    return (
        events.select(
            F.col("user_id").alias("trip_id"),
            "event_id",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            F.col("value").alias("v"),
            g.alias("g"),
            "event_type",
        )
        .withColumn("t", F.col("ts_us") / 1e6)
        .withColumn("lat", -7 + F.col("g") * 1e-4)
        .withColumn("lon", 110 + (F.col("event_id") % 10) * 1e-4)
        .withColumn("speed", (F.col("g") % 20).cast("double"))
        .withColumn("cls", F.when(F.col("event_type") == "purchase", "Pothole")
                    .when(F.col("event_type") == "signup", "Speed Bump").otherwise("Non-Event"))
    )


SIG_SQL = """sig AS (
  SELECT user_id AS trip_id, event_id, epoch_us(ts) AS ts_us, value AS v,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS g, event_type,
         epoch_us(ts) / 1e6 AS t,
         -7 + CAST(json_extract_string(props, '$.k') AS INTEGER) * 1e-4 AS lat,
         110 + (event_id % 10) * 1e-4 AS lon,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS DOUBLE) AS speed,
         CASE event_type WHEN 'purchase' THEN 'Pothole' WHEN 'signup' THEN 'Speed Bump' ELSE 'Non-Event' END AS cls
  FROM events)"""


def sig_axis(samples: DataFrame) -> Axis:
    """Order of ``sig`` rows; chunks of five days, shorter where the data is denser."""
    return Axis(("trip_id",), ("ts_us", "event_id"), fitted_chunk_len(samples, "ts_us", 5 * DAY_US))


def lab(spark: SparkSession, folder: str) -> DataFrame:
    """Document labels as predictions of a model."""
    labels = read_table(spark, folder, "labels")
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    return (
        labels.join(docs, "doc_id")
        .withColumn("score", (F.col("n_chars") % 1000) / 1000.0)
        .withColumn("y", F.col("quality"))
        .withColumn("y3", F.col("quality") + F.col("toxic"))
        .withColumn("p", F.array(1 - F.col("score"), F.col("score") * 0.6, F.col("score") * 0.4))
        .withColumn("pred", F.when(F.col("score") < 0.34, 0).when(F.col("score") < 0.67, 1).otherwise(2))
    )


LAB_SQL = """lab AS (
  SELECT l.doc_id, l.quality, l.toxic, d.source, d.lang, d.n_chars,
         (d.n_chars % 1000) / 1000.0 AS score, l.quality AS y, l.quality + l.toxic AS y3,
         [1 - (d.n_chars % 1000) / 1000.0, (d.n_chars % 1000) / 1000.0 * 0.6, (d.n_chars % 1000) / 1000.0 * 0.4] AS p,
         CASE WHEN (d.n_chars % 1000) / 1000.0 < 0.34 THEN 0 WHEN (d.n_chars % 1000) / 1000.0 < 0.67 THEN 1 ELSE 2 END AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def vec(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as one-channel windows."""
    return (
        read_table(spark, folder, "embeddings")
        .withColumn("x", F.col("embedding").cast("array<double>"))
        .withColumn("cls", F.col("label") % 3)
        .withColumn("trip_id", F.col("vec_id") % 20)
    )


VEC_SQL = """vec AS (
  SELECT vec_id, embedding, label, embedding::DOUBLE[] AS x, label % 3 AS cls, vec_id % 20 AS trip_id
  FROM embeddings)"""


def li(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as labelled feature rows: trip = supplier, class = return flag."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("trip_id"), F.col("l_returnflag").alias("cls"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


LI_SQL = """li AS (
  SELECT l_suppkey AS trip_id, l_returnflag AS cls, l_orderkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""

LI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def sensor(spark: SparkSession, folder: str) -> DataFrame:
    return sensor_columns(sig(spark, folder))


def sensor_columns(samples: DataFrame) -> DataFrame:
    """``sig`` with accelerometer, gravity and gyroscope columns derived from its values."""
    g, e = F.col("g"), F.col("event_id")
    return samples.select(
        "*", F.col("v").alias("magnitude"), (F.col("v") - 50).alias("a_vertical"), (g / 10.0).alias("a_horizontal"),
        (g % 7).cast("double").alias("gx"), (g % 11).cast("double").alias("gy"), (g % 13).cast("double").alias("gz"),
        (g / 10.0).alias("lin_ax"), (e % 17).cast("double").alias("lin_ay"), (F.col("v") / 10).alias("lin_az"),
        (e % 3).cast("double").alias("grav_x"), (e % 5).cast("double").alias("grav_y"), (g % 3).cast("double").alias("grav_z"))


SENSOR_SQL = f"""{SIG_SQL},
sensor AS (SELECT *, v AS magnitude, v - 50 AS a_vertical, g / 10.0 AS a_horizontal,
  (g % 7)::DOUBLE AS gx, (g % 11)::DOUBLE AS gy, (g % 13)::DOUBLE AS gz,
  g / 10.0 AS lin_ax, (event_id % 17)::DOUBLE AS lin_ay, v / 10 AS lin_az,
  (event_id % 3)::DOUBLE AS grav_x, (event_id % 5)::DOUBLE AS grav_y, (g % 3)::DOUBLE AS grav_z FROM sig)"""


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """The anomaly rows of ``sig`` as labelled events."""
    return sig(spark, folder).where(F.col("cls") != "Non-Event").select(
        "trip_id", F.col("event_id").alias("ev"), F.col("ts_us").alias("at"), F.col("cls").alias("label"))


MARKED_SQL = """marked AS (SELECT trip_id, event_id AS ev, ts_us AS at, cls AS label FROM sig WHERE cls <> 'Non-Event')"""
