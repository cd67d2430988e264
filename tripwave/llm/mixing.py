"""Mixing sources to target weights, cut at each source's exact budget.

Documents get hash-random keys and are sorted by range inside their source. Sums per
range give prefix sums of words without a task that holds a source; the range in which
a source's budget ends is the only one whose rows are added up one by one. The cut is
kept as a key per source, so whether a document is taken is an expression on its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwave.llm.text import DOCUMENT_COLUMNS, WORD, hash_key, n_words
from tripwave.operators.ordered import CHUNK, Axis, materialize, range_chunks, row_index

SEED = "mix"


def _name(source: Column) -> Column:
    """A source as a key that is never NULL; NULL sorts last, others by code point."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _key(doc_id: Column) -> Column:
    return hash_key(F.lit(SEED), doc_id)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Word targets of sources (``name``, ``source_size``) that share ``share`` of all words.

    Weights repeat over the sources in order. A target stops at ``most`` times the source;
    what is above goes to the others by weight, until none is above.
    """
    ranked = row_index(range_chunks(sizes, ["name"]), Axis((), ("name",), None), "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("name", "source_size", weight.alias("weight"),
                                      (F.col("source_size") * float(most)).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        n, taken, rest = table.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))),
                                   F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (share * total - (taken or 0)) / rest
    level = level or 0.0
    capped = F.col("cap") < F.lit(level) * F.col("weight")
    return table.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.lit(level) * F.col("weight")))


def cuts(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Where each source is cut: one row per source.

    ``sized`` has ``name``, ``key`` and ``size``. The result has ``name``, ``source_size``,
    ``target``, ``epochs`` (whole passes over the source), and the cut of the last pass:
    documents with a smaller key than ``cut_key`` are taken, those with that key give
    ``cut_words`` words each (equal keys share what is left), later ones nothing.
    """
    chunked = range_chunks(sized, ["name", "key"])
    sums = materialize(chunked.groupBy("name", CHUNK).agg(F.sum("size").alias("_in")))
    goal = targets(sums.groupBy("name").agg(F.sum("_in").cast("long").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    goal = materialize(goal.withColumn("_rest", budget - F.col("epochs") * F.col("source_size")))
    upto = F.sum("_in").over(Window.partitionBy("name").orderBy(CHUNK))
    last = sums.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_in")).join(
        goal.select("name", "_rest"), "name").where("_from < _rest and _rest <= _upto")
    rows = chunked.join(last.select("name", CHUNK, "_from", "_rest"), ["name", CHUNK])
    rows = rows.groupBy("name", "key", "_from", "_rest").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_upto", F.col("_from") + F.sum("_sum").over(Window.partitionBy("name").orderBy("key")))
    rows = rows.where("_rest <= _upto and _upto - _sum < _rest")
    cut = rows.select("name", F.col("key").alias("cut_key"),
                      F.floor((F.col("_rest") - F.col("_upto") + F.col("_sum")) / F.col("_n")).alias("cut_words"))
    return goal.join(cut, "name", "left").select("name", "source_size", "target", "epochs", "cut_key", "cut_words")


def _taken() -> Column:
    last = (F.when(F.col("key") < F.col("cut_key"), F.col("size"))
            .when(F.col("key") == F.col("cut_key"), F.least(F.col("size"), F.col("cut_words"))).otherwise(0))
    return (F.col("epochs") * F.col("size") + last).cast("long")


def mix_words(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words that the mix takes of each document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    NULL text has no words and gives nothing; a NULL source is a source, the last one;
    documents with equal ids in a source share the place of the cut; an empty table gives
    no rows. Equal input gives equal results, whatever the partitions.
    """
    sized = materialize(docs.select("doc_id", _name(F.col("source")).alias("name"), _key(F.col("doc_id")).alias("key"),
                                    n_words(F.col("text")).alias("size")))
    plan = materialize(cuts(sized.select("name", "key", "size"), weights, share, most))
    return sized.join(plan, "name").select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                  most: float = 2.0) -> DataFrame:
    """The mix as documents: one row per pass, the cut document shortened to its share of words.

    The plan is made on keys and word counts; texts are read once and never shuffled. Cases as in ``mix_words``: a document
    without words, NULL and empty texts too, gives no row; a text of any length is cut at a word; ties at the cut share it;
    an empty table gives no rows.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    sized = docs.select("*", _name(F.col("source")).alias("name"), _key(F.col("doc_id")).alias("key"),
                        n_words(F.col("text")).alias("size"))
    plan = materialize(cuts(materialize(sized.select("name", "key", "size")), weights, share, most))
    rows = sized.join(plan, "name").withColumn("_taken", _taken()).where("_taken > 0")
    rows = rows.withColumn("_left", F.explode(F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("size")).cast("int") - 1),
        lambda k: F.col("_taken") - k * F.col("size"))))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_left").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_left") < F.col("size"), short).otherwise(F.col("text")))
    n_chars = F.when(F.col("_left") < F.col("size"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(*DOCUMENT_COLUMNS)
