"""What several operators share: the word pattern, document columns, and Arrow batches in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A word: anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def n_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*parts: Column) -> Column:
    """Hex md5 of the parts, a random but repeatable key that SQL engines agree on; NULL counts as empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def by_batch(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
             schema: str) -> DataFrame:
    """``df`` through ``step``, one Arrow batch at a time; batches hold few rows so that long texts fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield step(batch.slice(at, ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)


#: Rows that one call of a step sees: a bound on its memory, not on what is read.
ROWS_AT_ONCE = 512
