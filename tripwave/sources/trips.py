"""Trip samples, trip metadata, label documents and field tests."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tripwave.functions.exprs import clean_nans
from tripwave.operators.ordered import join_per_key

_AXES = ("ax", "ay", "az", "gx", "gy", "gz", "lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z",
         "lat", "lon", "speed")

SAMPLE_SCHEMA = T.StructType([T.StructField("timestamp", T.DoubleType())] + [T.StructField(c, T.DoubleType()) for c in _AXES])

META_SCHEMA = T.StructType([
    T.StructField("tripId", T.StringType()), T.StructField("userId", T.StringType()),
    T.StructField("startTime", T.LongType()), T.StructField("startTimeReadable", T.StringType()),
    T.StructField("endTime", T.LongType()), T.StructField("duration", T.LongType()),
    T.StructField("distance", T.DoubleType())])

LABEL_SCHEMA = T.StructType([
    T.StructField("trip_index", T.IntegerType()), T.StructField("trip_id", T.StringType()),
    T.StructField("labeled_at", T.StringType()), T.StructField("notes", T.StringType()),
    T.StructField("event_mapping", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType()))])


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing required columns: {', '.join(missing)}")
    return df


def with_accelerometer(df: DataFrame) -> DataFrame:
    """ax, ay, az from the file, else linear + gravity, else ``accel_*``; gyroscope columns must exist."""
    cols = set(df.columns)
    if not {"ax", "ay", "az"} <= cols:
        if {"lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z"} <= cols:
            df = df.withColumns({f"a{a}": F.col(f"lin_a{a}") + F.col(f"grav_{a}") for a in "xyz"})
        elif {"accel_x", "accel_y", "accel_z"} <= cols:
            df = df.withColumns({f"a{a}": F.col(f"accel_{a}") for a in "xyz"})
        else:
            raise ValueError("missing accelerometer columns: cannot derive ax, ay, az")
    return require_columns(df, ("gx", "gy", "gz"), "gyroscope")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def header_classes(spark: SparkSession, folder: str) -> dict[tuple[str, ...], list[str]]:
    """The CSV files of a folder by the column names of their first line that is not blank.

    Every split of a file is a task of its own, and a task ends after its first lines, so headers cost no
    scan. The file names reach the driver, as they do for any read; a file without a line is in no class.
    """
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))  # one split per task
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    lines = probe.read.text(folder, pathGlobFilter="*.csv").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, value in zip(*[c.to_pylist() for c in batch.columns]):
                if block:
                    return
                if value.strip("\ufeff \t\r"):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([value])], names=["path", "head"])
                    return

    out: dict[tuple[str, ...], list[str]] = {}
    for row in lines.mapInArrow(first, "path string, head string").collect():
        names = tuple(name.strip() for name in next(csv.reader([row["head"].strip("\ufeff\r")])))
        out.setdefault(names, []).append(re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(row["path"])))
    return out


def read_by_header(spark: SparkSession, folder: str, multi_line: bool = False) -> list[DataFrame]:
    """One table of text columns per distinct header among the CSV files of a folder, each with its file's columns.

    Cells may hold commas and doubled quotes inside quotes, with ``multi_line`` also line ends; blanks around a
    cell are dropped, an empty cell is NULL, as is a cell that a short row lacks. ``_path``, ``_block`` and ``_line`` tell where a row stands.
    """
    out = []
    for names, paths in sorted(header_classes(spark, folder).items()):
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.schema(schema).csv(sorted(paths), header=True, quote='"', escape='"', multiLine=multi_line,
                                            ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        cells = {name: f"_c{i}" for i, name in reversed(list(enumerate(names))) if name}  # of equal names the first
        out.append(raw.select(*[F.nullif(F.trim(cell), F.lit("")).alias(name) for name, cell in cells.items()],
                              F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                              F.monotonically_increasing_id().alias("_line")))
    return out


def _typed(df: DataFrame, fields: Sequence[T.StructField]) -> list[Column]:
    def cell(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType)
        return F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").try_cast(f.dataType)

    return [cell(f).alias(f.name) for f in fields]


def read_trip_csv(spark: SparkSession, folder: str, schema: T.StructType = SAMPLE_SCHEMA, multi_line: bool = False) -> DataFrame:
    """All trip CSVs of a folder; ``trip_file`` is the base name, ``trip_folder`` the folder it
    lies in, ``file_pos`` the order in the file.

    Columns go by the names in each file's own header, in any order. A column of ``schema``
    that a file lacks is NULL there, and others are left out; ``schema`` may name text columns.
    Where ax, ay and az are not known they are the sum of linear acceleration and gravity, else
    ``accel_*``. NaN becomes NULL, the timestamp an integer millisecond; a cell that is no number is NULL.
    """
    more = [T.StructField(f"accel_{a}", T.DoubleType()) for a in "xyz" if f"accel_{a}" not in schema.fieldNames()]
    fields = [*schema.fields, *more]
    path = F.col("_path")
    place = [base_name(path).alias("trip_file"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("trip_folder"),
             F.struct(F.col("_block").alias("block"), F.col("_line").alias("line")).alias("file_pos")]
    keyed = None
    for part in read_by_header(spark, folder, multi_line):
        rows = part.select(*_typed(part, fields), *place)
        keyed = rows if keyed is None else keyed.unionByName(rows)
    if keyed is None:
        shape = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in ("trip_file", "trip_folder")], T.StructField(
            "file_pos", T.StructType([T.StructField("block", T.LongType()), T.StructField("line", T.LongType())]))])
        keyed = spark.createDataFrame([], shape)
    clean = clean_nans(keyed)
    if set(_AXES) <= set(clean.columns):
        clean = clean.withColumns({f"a{a}": F.coalesce(f"a{a}", F.col(f"lin_a{a}") + F.col(f"grav_{a}"), f"accel_{a}") for a in "xyz"})
    return clean.drop(*[f.name for f in more]).withColumn("ts_ms", F.floor("timestamp").cast("bigint"))


def read_trip_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Trip metadata documents, one per file, pretty-printed or on one line."""
    docs = spark.read.schema(META_SCHEMA).json(folder, multiLine=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    return docs.select("*", base_name(path).alias("trip_file"), path.alias("meta_path"))


def pair_meta(samples: DataFrame, meta: DataFrame, spread: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Samples with the trip id of their metadata, the first by path if files share a name, else the file's own name."""
    first = F.struct("meta_path", "tripId") if "meta_path" in meta.columns else F.col("tripId")
    ids = meta.where("tripId is not null").groupBy("trip_file").agg(F.min_by("tripId", first).alias("tripId"))
    joined = join_per_key(samples, ids, ["trip_file"], spread, "left")
    return joined.withColumn("trip_id", F.coalesce("tripId", F.concat("trip_file", F.lit(".csv")))).drop("tripId")


def read_labels(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """One row per labelled event; ``time_s`` is NULL in documents without an event mapping.

    Documents come one per file (``multi_line``) or one per line.
    """
    docs = spark.read.schema(LABEL_SCHEMA).json(folder, multiLine=multi_line, pathGlobFilter="*.json")
    rows = docs.select("trip_id", "labeled_at", "notes", "event_mapping", F.explode("labels").alias("_no", "label"))
    return rows.select("trip_id", F.col("_no").cast("int").alias("event_no"), "label",
                       F.col("event_mapping")[F.col("_no")].alias("time_s"), "labeled_at", "notes")


def read_field_test(spark: SparkSession, folder: str) -> DataFrame:
    """Field-test CSVs with both probabilities; rows without a position are dropped."""
    schema = T.StructType(SAMPLE_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in ("prob_pothole", "prob_speedbump")])
    out = None
    for raw in read_by_header(spark, folder):
        require_columns(raw, ("timestamp", "lat", "lon", "prob_pothole", "prob_speedbump"), "field test")
        known = [f for f in schema.fields if f.name in raw.columns]
        typed = raw.select(*_typed(raw, known), base_name(F.col("_path")).alias("trip_file"))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    if out is None:
        raise ValueError("field test: no files")
    return clean_nans(out).na.drop(subset=["lat", "lon"])
