"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language in every task and sums the counts in Spark; what
reaches the driver is one count per language and bucket. Scoring broadcasts the
log-probability matrix and adds up its rows for a batch of texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripwave.llm.text import ROWS_AT_ONCE

UNKNOWN = "und"
SPACE = 32


@dataclass(frozen=True)
class NgramModel:
    """N-grams of ``orders`` characters in ``2**bits`` buckets.

    The matrix that is broadcast holds ``2**bits`` floats (128 KiB) for each language. ``languages_held`` bounds the count tables
    of a task, ``chars_at_once`` and ``cells_at_once`` its arrays; none of them changes a result.
    """

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    smoothing: float = 0.5
    languages_held: int = 256
    chars_at_once: int = 1_000_000
    cells_at_once: int = 4_000_000

    @property
    def buckets(self) -> int:
        return 1 << self.bits


class Letters:
    """Letters of a lower-case text, with single spaces between words, as code points."""

    def __init__(self) -> None:
        self.is_letter = np.zeros(0x110000, bool)
        for lo, hi in ((0, 0x3400), (0x3400, 0xE000), (0xE000, 0x30000)):
            self.is_letter[lo:hi] = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False
                                                 for c in range(lo, hi)), bool, hi - lo)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        letter = self.is_letter[points]
        points = np.where(letter, points, SPACE).astype(np.uint64)
        keep = letter.copy()
        keep[:-1] |= letter[1:]  # of a run of other characters, the last before a letter
        return points[keep]


def buckets_of(points: np.ndarray, order: int, model: NgramModel) -> np.ndarray:
    """Bucket of the n-gram that begins at each position."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
    for k in range(order):
        h = (h ^ points[k:k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - model.bits)).astype(np.int64)


def gram_counts(text: str, letters: Letters, model: NgramModel) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the words of a text with a space at both ends; None without a letter.

    A long text goes through in slices; the last characters of one are carried into the next, so that a cut is not seen.
    """
    text = text.lower()
    counts, tail, carried = None, np.zeros(0, np.uint64), max(model.orders) - 1

    def add(new: np.ndarray) -> np.ndarray:
        nonlocal counts
        stream = np.concatenate([tail, new])
        counts = np.zeros(model.buckets, np.int64) if counts is None else counts
        for order in model.orders:
            counts += np.bincount(buckets_of(stream[max(0, len(tail) - order + 1):], order, model), minlength=model.buckets)
        return stream[max(0, len(stream) - carried):]

    space = np.array([SPACE], np.uint64)
    for at in range(0, len(text), model.chars_at_once):
        # a space before the slice counts only if the slice begins with a letter
        first = at - 1 if at and not letters.is_letter[ord(text[at - 1])] else at
        points = letters(text[first:at + model.chars_at_once])
        if len(points):
            tail = add(points if counts is not None else np.concatenate([space, points]))
    if counts is not None:
        add(space)
    return counts


def count_grams(labelled: DataFrame, model: NgramModel) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all rows of ``text`` and ``lang``; bucket -1 counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, table in counts.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()),
                                                  pa.array(table[at], pa.int64())], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in counts:
                        if len(counts) >= model.languages_held:
                            yield from flush()
                        counts[lang] = np.zeros(model.buckets + 1, np.int64)
                    counts[lang][0] += 1
                    if (found := gram_counts(text, letters, model)) is not None:
                        counts[lang][1:] += found
        yield from flush()

    counted = labelled.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Trained:
    """Languages in code point order, log priors, and log probabilities by bucket and language."""

    languages: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray


def train(labelled: DataFrame, model: NgramModel = NgramModel()) -> Trained:
    """Fits on every row with a text and a language; a row per language reaches the driver, and its counts."""
    rows = labelled.where("text is not null and lang is not null")
    languages = tuple(sorted(r[0] for r in rows.select("lang").distinct().collect()))
    counts = np.zeros((model.buckets + 1, len(languages)))
    table = count_grams(rows, model).toArrow()
    at = {name: i for i, name in enumerate(languages)}
    column = np.array([at[x] for x in table["lang"].to_pylist()], np.int64)
    counts[table["bucket"].to_numpy().astype(np.int64) + 1, column] = table["n"].to_numpy()
    grams_in = counts[1:] + model.smoothing
    texts = counts[0] + 1
    return Trained(languages, np.log(texts / texts.sum()) if languages else texts,
                   np.log(grams_in / grams_in.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, trained: Trained, model: NgramModel = NgramModel()) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each whole text; nothing but the text is looked at.

    ``score`` is the posterior of the prediction. NULL texts and texts without a letter are
    ``und`` with score 0, as is every text if nothing was learned. Equal likelihoods go to
    the first language by code point. Texts of any length are read whole. Repeated rows are scored one by one; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((trained.languages, trained.prior, trained.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (languages, prior, matrix) = Letters(), shared.value

        def scored(texts: list[str | None]) -> list[tuple[str, float]]:
            """The counts of all texts as one sparse matrix, times the log probabilities, some rows and languages at a time."""
            out = [(UNKNOWN, 0.0)] * len(texts)
            rows = [(i, c) for i, t in enumerate(texts) if languages and (c := gram_counts(t or "", letters, model)) is not None]
            if not rows:
                return out
            places = [np.flatnonzero(c) for _, c in rows]
            totals = np.tile(prior, (len(rows), 1))
            width = max(1, model.cells_at_once // model.buckets)
            for low in range(0, len(languages), width):
                part = slice(low, low + width)
                start = 0
                while start < len(rows):
                    stop, cells = start, 0
                    while stop < len(rows) and (stop == start or cells + len(places[stop]) * width <= model.cells_at_once):
                        cells += len(places[stop]) * min(width, len(languages))
                        stop += 1
                    at = np.concatenate(places[start:stop])
                    n = np.concatenate([c[p] for (_, c), p in zip(rows[start:stop], places[start:stop])])
                    sizes = np.fromiter(map(len, places[start:stop]), np.int64)
                    totals[start:stop, part] += np.add.reduceat(matrix[at, part].astype(np.float64) * n[:, None], np.cumsum(sizes) - sizes)
                    start = stop
            best = totals.argmax(axis=1)
            sure = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            for (i, _), k, p in zip(rows, best.tolist(), sure.tolist()):
                out[i] = languages[k], p
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = scored(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows kept out of training: by a checksum of the id, so that reruns agree."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % folds == fold


def identify_documents(docs: DataFrame, model: NgramModel = NgramModel()) -> DataFrame:
    """Trains on the rows that are not held out, and predicts all; a NULL id counts as empty text, other cases as in ``identify``."""
    trained = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), model)
    return identify(docs, trained, model).withColumn("held_out", held_out(F.col("doc_id")))
