"""Quality rules: word and line statistics, and compression bands.

zstandard ratios of whole documents and of fixed chunks must lie in a band that depends
on the length: below it text is incompressible (noise, encoded data), above it text repeats
itself. The bands come from all documents that pass the word rules: a count of different
(length, ratio) cells by quarter octave of length gives the median and the spread of its
lower half, smoothed over neighbouring lengths, so neither copies nor a cluster of near
copies move a limit. Texts never cross the network.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripwave.llm.text import by_batch
from tripwave.operators.ordered import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    A ratio is out of band if it lies ``above`` or ``below`` so many spreads from the median of its length. A quarter
    octave of length has a median from ``least`` different documents on; lengths without one or a neighbour that has one have no limits.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk_bytes: int = 2048
    max_bad_chunks: float = 0.5
    above: float = 4.0
    below: float = 6.0
    least: int = 20
    least_spread: float = 0.012


#: Quarter octaves of length: up to 2^40 bytes.
OCTAVE_PARTS, N_BINS = 4, 160


def length_bin(size: int) -> int:
    return min(N_BINS - 1, int(OCTAVE_PARTS * math.log2(size) + 1e-9))


def bands_of(cells: Iterable[tuple[int, float, int]], rules: QualityRules) -> list[tuple[float, float]]:
    """Lowest and highest ratio of every length bin, from (bin, ratio, different documents)."""
    by_bin: dict[int, list[tuple[float, int]]] = defaultdict(list)
    for b, ratio, n in cells:
        by_bin[b].append((ratio, n))
    middle, spread = {}, {}
    for b, pairs in by_bin.items():
        values, counts = map(np.array, zip(*sorted(pairs)))
        total = counts.sum()
        if total >= rules.least:
            low, middle[b] = values[np.searchsorted(np.cumsum(counts), [0.16 * total, 0.5 * total])]
            spread[b] = max(float(middle[b] - low), rules.least_spread)
    out = []
    for b in range(N_BINS):
        near = [k for k in range(b - 2, b + 3) if k in middle]
        m, s = (float(np.median([x[k] for k in near])) if near else 0.0 for x in (middle, spread))
        out.append((m - rules.below * s, m + rules.above * s) if near else (0.0, math.inf))
    return out


def repeated_words(words: Sequence) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = reach = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def ratios(data: bytes, rules: QualityRules, compressor) -> tuple[float | None, list[float]]:
    """Ratio of the document, and of its chunks; the last chunk ends with the text, so all of it is judged."""
    if not data:
        return None, []
    n = rules.chunk_bytes
    starts = [*range(0, len(data) - n, n), len(data) - n] if len(data) > n else []
    return len(data) / len(compressor.compress(data)), [n / len(compressor.compress(data[at:at + n])) for at in starts]


def held(size: int, ratio: float | None, chunks: Sequence[float], bands: Sequence[tuple[float, float]], rules: QualityRules) -> tuple[bool, int]:
    """Whether the document and enough of its chunks are in band, and the chunks that are not."""
    if ratio is None:
        return True, 0
    low, high = bands[length_bin(size)]
    chunk_low, chunk_high = bands[length_bin(rules.chunk_bytes)]
    bad = sum(not chunk_low <= c <= chunk_high for c in chunks)
    return low <= ratio <= high and bad <= rules.max_bad_chunks * len(chunks), bad


def document_stats(text: str | None, rules: QualityRules, compressor) -> tuple:
    """The five counts, whether a word rule fails, size in bytes, ratio and the chunks' ratios."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: splits at exactly the six separators
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    n_repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(words)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), n_repeat, failed, len(data), *ratios(data, rules, compressor))


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bytes", "zstd_ratio", "chunk_ratios"]


def statistics(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``doc_id`` and the statistics of each document."""
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, zstd_ratio double, chunk_ratios array<double>")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=rules.level)
        stats = [document_stats(t.as_py(), rules, compressor) for t in batch.column(1)]
        columns = list(zip(*stats)) or [[]] * len(STATS)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=["doc_id", *STATS])

    return by_batch(docs.select("doc_id", "text"), step, schema)


def bands(stats: DataFrame, rules: QualityRules = QualityRules()) -> list[tuple[float, float]]:
    """Limits by length from all documents that pass the word rules; equal lengths and ratios count once.

    What reaches the driver are counts by length bin and ratio in hundredths, a table of bounded size.
    """
    size = F.col("n_bytes")
    b = F.least(F.lit(N_BINS - 1), F.floor(OCTAVE_PARTS * F.log2(size.cast("double")) + 1e-9)).cast("int")
    ratio = F.least(F.lit(1e4), F.round("zstd_ratio", 2))
    cells = stats.where("not base_failed").select(size, "zstd_ratio").distinct().groupBy(b.alias("b"), ratio.alias("ratio")).agg(
        F.count(F.lit(1)).alias("n"))
    return bands_of([(r["b"], r["ratio"], r["n"]) for r in cells.collect()], rules)


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, and the ratio and chunks behind the verdict.

    NULL and empty texts have no words: they fail the word rules, their ratio is NULL. Texts of any length are
    compressed whole and in chunks. Repeated rows are judged one by one; equal ratios at a limit are kept; an empty table
    gives no rows. With few documents a length may have no limits, then the word rules decide.
    """
    stats = materialize(statistics(docs, rules))
    limits = bands(stats, rules)
    low, high = (F.array(*[F.lit(x[side]) for x in limits]) for side in (0, 1))
    b = F.least(F.lit(N_BINS - 1), F.floor(OCTAVE_PARTS * F.log2(F.col("n_bytes").cast("double")) + 1e-9)).cast("int")
    chunk_low, chunk_high = limits[length_bin(rules.chunk_bytes)]
    bad = F.size(F.filter("chunk_ratios", lambda c: ~c.between(chunk_low, chunk_high))).cast("long")
    rows = stats.withColumn("bad_chunks", bad).withColumn("n_chunks", F.size("chunk_ratios").cast("long"))
    ok = F.col("zstd_ratio").between(F.get(low, b), F.get(high, b)) & (F.col("bad_chunks") <= rules.max_bad_chunks * F.col("n_chunks"))
    kept = ~F.col("base_failed") & F.coalesce(ok, F.lit(True))
    return rows.withColumn("kept", kept).select("doc_id", *STATS[:6], "kept", "zstd_ratio", "bad_chunks", "n_chunks")


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that every rule keeps, with all their columns; see ``judge`` for the cases.

    Texts are compressed twice, for the limits and for the verdict where they are read, so that they need no join.
    """
    limits = bands(materialize(statistics(docs, rules).select("base_failed", "n_bytes", "zstd_ratio")), rules)
    at = docs.columns.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=rules.level)
        verdicts = []
        for text in batch.column(at):
            *_, failed, size, ratio, chunks = document_stats(text.as_py(), rules, compressor)
            verdicts.append(not failed and held(size, ratio, chunks, limits, rules)[0])
        return batch.filter(pa.array(verdicts, pa.bool_()))

    return by_batch(docs, step, docs.schema)
