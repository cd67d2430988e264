"""Training and tuning logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripwave.operators.ordered import Axis, fill

# What the log formats call their parts.
FOLD, EPOCH = "fold", "epoch"
MEASURES = {"train_loss": "train loss", "val_loss": "val loss", "val_f1": "val macro f1"}
TRIAL, VALUE, PARAMETERS = "trial", "finished with value", "and parameters"

#: A number as programs print it: fractions, exponents, infinities, not-a-number.
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?|[-+]?inf(?:inity)?|nan"
#: One ``'name': value`` of a printed dictionary; a value ends at a comma or brace, unless it is quoted.
ENTRY = r"""['"]([^'"]+)['"]\s*:\s*('[^']*'|"[^"]*"|[^,{}]+)"""


def words(text: str) -> str:
    """Pattern of a phrase, any case, any blanks between its words."""
    return r"\s+".join(text.split())


def measure(name: str) -> Column:
    """The number after ``name:`` in a line whose measures are divided by bars; NULL if it is not there."""
    return number(F.regexp_extract("value", rf"(?i)(?:[|\]]|^)\s*{words(name)}\s*:\s*({NUMBER})(?=[\s|]|$)", 1))


def number(text: Column) -> Column:
    return F.when(text != "", text).try_cast("double")


def literal(text: Column) -> Column:
    """A printed value as text: without quotes, None as NULL."""
    text = F.trim(text)
    plain = F.when(text.rlike(r"""^(['"]).*\1$"""), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.when(text != "None", plain)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """(file, fold, epoch, train_loss, val_loss, val_f1); lines before the first fold header are left out."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))

    def counted(pattern: str) -> Column:
        return number(F.regexp_extract("value", rf"(?i){pattern}", 1)).cast("int")

    known = fill(lines, Axis(("file",), ("block", "line"), 1), back={"fold": counted(rf"=\s*{FOLD}\s+([0-9]+)\s*=")})
    rows = known.select("file", "fold", counted(rf"\[\s*{EPOCH}\s+([0-9]+)\s*/").alias("epoch"),
                        *[measure(name).alias(column) for column, name in MEASURES.items()])
    return rows.where("fold is not null and epoch is not null and train_loss is not null and val_loss is not null")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(file, trial, value, params) of finished trials; parameters may wrap over lines, files may be UTF-16.

    A file is one cell while it is read, so it may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    wide = F.expr("hex(substring(content, 2, 1)) = '00' OR hex(substring(content, 1, 2)) = 'FFFE'")
    text = F.when(wide, F.decode("content", "UTF-16LE")).otherwise(F.decode("content", "UTF-8"))
    sentence = (rf"(?i)\b{TRIAL}\s+([0-9]+)\s+{words(VALUE)}\s*:\s*({NUMBER})\s+{words(PARAMETERS)}\s*:\s*"
                r"\{([^{}]*)\}")
    found = files.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(text, F.lit(sentence), F.lit(0))).alias("hit"))
    entries = F.regexp_extract("hit", sentence, 3)
    names, values = (F.regexp_extract_all(entries, F.lit(ENTRY), F.lit(g)) for g in (1, 2))
    return found.select(
        "file", F.regexp_extract("hit", sentence, 1).cast("int").alias("trial"),
        number(F.regexp_extract("hit", sentence, 2)).alias("value"),
        F.map_from_arrays(names, F.transform(values, literal)).alias("params"))


def read_sweep(spark: SparkSession, path: str, param: str) -> DataFrame:
    """One row per swept value and class from a JSON array (or lines) of sweep results."""
    scores = "struct<precision:double,recall:double,f1_score:double>"
    overall = [f"{s}_{m}" for s in ("train", "val", "test") for m in ("loss", "macro_f1", "pothole_f1")]
    schema = f"{param} double, {', '.join(f'{c} double' for c in overall)}, class_metrics map<string,{scores}>"
    runs = spark.read.schema(schema).json(path, multiLine=True)
    return runs.select(param, *overall, F.explode("class_metrics").alias("class", "_m")).select(
        param, *overall, "class", "_m.*")


def sensitivity(runs: DataFrame, param: str) -> DataFrame:
    """Swept values by falling validation macro F1, with the per-class F1 of each."""
    best = [c for c in runs.columns if c.endswith(("_loss", "_macro_f1", "_pothole_f1"))]
    table = runs.groupBy(param).agg(
        *[F.first(c).alias(c) for c in best],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "f1_score")))).alias("class_f1"))
    return table.orderBy(F.desc("val_macro_f1"), param)
