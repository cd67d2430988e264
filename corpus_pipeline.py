"""Documents to training tokens: quality rules, near-duplicates, secrets, source mix, byte-level BPE.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before
kept. Between stages documents are written as Parquet and read again, so a lost executor
costs tasks of one stage, and each stage's statistics come from its own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwave.llm import bpe, jaccard, mixing, quality, secrets
from tripwave.llm.text import DOCUMENT_COLUMNS
from tripwave.operators.ordered import materialize
from tripwave.sources.tables import read_table

#: Near-duplicates share five-word shingles for 80 % of their union or more.
NEAR_DUPLICATES = jaccard.JoinParams(words=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a base rule or a compression band."""
    return quality.kept_documents(docs.select(*DOCUMENT_COLUMNS))


def deduplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return jaccard.one_of_each(docs.select(*DOCUMENT_COLUMNS), NEAR_DUPLICATES)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text; all documents stay."""
    return secrets.redacted(docs.select(*DOCUMENT_COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's budget of words: a document once for every pass, the last one cut to fit."""
    return mixing.mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", deduplicate_stage),
    ("secret scans", secrets_stage),
    ("source mix", mixing_stage),
    ("byte-level BPE", encode_stage),
]

#: Compression ratios, Markov models and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
