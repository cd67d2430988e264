"""Phrase collocation mining by Toivonen's method.

A sample of the pieces between punctuation marks is mined level by level at a lowered count
and proposes the phrases that may be frequent. One pass over all documents counts these and their negative
border exactly: a phrase is counted if its first part and its last part, one word shorter,
are both proposed, and every single word is. A border phrase that turns out frequent is
a failure: it joins the proposals, and an expansion pass counts what its border adds, and what
that adds in turn, up to the longest phrases. Then the count is closed: nothing frequent can be
missing, as all parts of a frequent phrase are frequent.

Proposals travel as a bit table of fixed size. A false hit there only counts a phrase
too many. Tasks number their words and phrases in blocks of bounded size and send one
row for every phrase of a block; counts are added up in Spark by the phrase itself.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tripwave.operators.ordered import materialize

#: Piece ends become line feeds, a tab becomes a space.
PLAIN = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
END, NOTHING = -1, -2
COUNTED = "lang string, phrase binary, k int, f long"


@dataclass(frozen=True)
class MiningParams:
    """What counts as frequent, how long a phrase may be, and the first so many of each language.

    One in ``one_in`` pieces is in the sample; ``bits`` is the size of the proposal table (a power
    of two, an eighth of that in bytes); a task counts in blocks of about ``block`` bytes.
    """

    least: int = 100
    longest: int = 5
    top: int = 2000
    one_in: int = 4
    bits: int = 1 << 26
    block: int = 3_000_000

    @property
    def lowered(self) -> int:
        """Four standard deviations below what a phrase at the limit has in the sample, so that few are missed."""
        mean = self.least / self.one_in
        return max(1, math.floor(mean - 4 * math.sqrt(mean * (1 - 1 / self.one_in))))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, None], object)[:-1], categorize=False)


def _lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return prefix * np.uint64(0x9E3779B97F4A7C15) + word


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each phrase in a table of so many bits."""
    mask = np.uint64(bits - 1)
    z = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    return z & mask, (z >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(7) & mask


class Proposals:
    """A bit table of phrases."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, 64 * len(self.table)):
            found &= (self.table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _phrase_hashes(langs: list[str], phrases: list[bytes]) -> np.ndarray:
    if not phrases:
        return np.zeros(0, np.uint64)
    split = [p.split(b" ") for p in phrases]
    sizes = np.fromiter(map(len, split), np.int64)
    words = _word_hashes([w for part in split for w in part])
    seeds = {lang: _lang_seed(lang) for lang in set(langs)}
    words ^= np.repeat(np.array([seeds[lang] for lang in langs], np.uint64), sizes)
    first = np.cumsum(sizes) - sizes
    hashes = words[first]
    for k in range(1, sizes.max()):
        more = sizes > k
        hashes[more] = _longer(hashes[more], words[first[more] + k])
    return hashes


def propose(phrases: DataFrame, bits: int, table: np.ndarray | None = None) -> np.ndarray:
    """The bit table of ``phrases`` (``lang``, ``phrase``), added to ``table``.

    Words of 64 bits are OR-ed in Spark; what reaches the driver is the table, of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            at = np.concatenate(_places(hashes, bits))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))],
                                             names=["word", "bit"])

    out = np.zeros(bits // 64, np.uint64) if table is None else table.copy()
    rows = phrases.select("lang", "phrase").mapInArrow(run, "word long, bit long").groupBy("word").agg(
        F.bit_or("bit").alias("bit")).toArrow()
    out[rows.column("word").to_numpy()] |= rows.column("bit").to_numpy().view(np.uint64)
    return out


@dataclass
class Numbered:
    """Words of a block as numbers in order, with ``END`` between pieces, and language, bytes and hash of each number."""

    numbers: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    words: pa.Array
    hashes: np.ndarray


class Block:
    """Plain texts by language; a number stands for a word of one language."""

    def __init__(self) -> None:
        self.texts: dict[str, list[bytes]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        self.texts[lang].append(text)
        self.size += len(text)

    def numbered(self, last: str | None = None) -> Numbered:
        """The block's words, those of the language ``last`` at the end."""
        langs = sorted(self.texts, key=lambda lang: (lang == last, lang))
        numbers, words, hashes, sizes, n = [], [], [], [], 0
        for lang in langs:
            text = pa.array([b" ".join(self.texts[lang])], pa.large_binary())
            coded = pc.split_pattern(text, " ").flatten().dictionary_encode()
            known = coded.dictionary
            blank = np.isin(np.arange(len(known)), [pc.index(known, x).as_py() for x in (b"", b"\n")])
            number = np.cumsum(~blank) - 1 + n
            number[blank] = [END if w == b"\n" else NOTHING for w in known.filter(pa.array(blank)).to_pylist()]
            code = number[coded.indices.to_numpy()]
            numbers.append(code[code != NOTHING])
            own = known.filter(pa.array(~blank))
            words.append(own.cast(pa.binary()))
            hashes.append(_word_hashes(own.to_pylist()) ^ _lang_seed(lang))
            sizes.append(len(own))
            n += len(own)
        return Numbered(np.concatenate(numbers), langs, np.repeat(np.arange(len(langs)), sizes), pa.concat_arrays(words), np.concatenate(hashes))


def _segments(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A plain text in parts of about ``size`` bytes that end between words, piece ends set apart by spaces."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            ends = [e for e in (text.find(b" ", stop), text.find(b"\n", stop)) if e >= 0]
            stop = min(ends) if ends else len(text)
        yield text[at:stop].replace(b"\n", b" \n ")
        at = stop
    yield b" \n "


def _drawn(text: bytes, seed: int, one_in: int) -> bytes:
    """One in so many pieces of a plain text, by the piece's number and the text's seed."""
    return b"\n".join([piece for i, piece in enumerate(text.split(b"\n"))
                       if ((i * 2654435761 ^ seed) * 2246822519 & 0xFFFFFFFF) * one_in >> 32 == 0])


def _rows(lang: pa.Array, phrase: pa.Array, k: int, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(f), k, np.int32)), pa.array(f)],
                                       names=["lang", "phrase", "k", "f"])
    for at in range(0, len(f), 20_000):
        yield batch.slice(at, 20_000)


def _count(block: Numbered, own: int, lengths: range, now: Proposals | None, before: Proposals | None,
           totals: bool) -> Iterator[pa.RecordBatch]:
    """Counts of one block's phrases that start in its first ``own`` words.

    Counted are phrases of ``lengths`` whose parts are in ``now``, but for those that ``before`` already gave.
    """
    words, hashes, langs = block.words, block.hashes, pa.array(block.langs)
    if not len(words):
        return
    text, lang_of = words, block.lang_of
    at = np.flatnonzero(block.numbers >= 0)
    code, known = block.numbers[at], np.full(len(words), before is not None)  # counted in an earlier pass
    counts = np.bincount(code[at < own], minlength=len(words))
    if totals:
        whole = np.bincount(lang_of, counts, len(block.langs)).astype(np.int64)
        yield from _rows(langs, pa.array([b""] * len(whole), pa.binary()), 0, whole)
    if 1 in lengths:
        seen = np.flatnonzero(counts)
        yield from _rows(langs.take(pa.array(lang_of[seen])), text.take(pa.array(seen)), 1, counts[seen])
    for k in range(2, lengths.stop):
        # of each position with a phrase of k - 1 words: its number, whether it counts longer ones now and did before;
        # what this pass is the first to count does so at once, so one pass closes all that failures reach
        good, old = now.has(hashes), known
        if before is not None:
            good, old = good | ~known, known & before.has(hashes)
        at, code = at[good[code]], code[good[code]]
        if not len(at):
            return
        follows = np.zeros(len(at), bool)
        follows[:-1] = at[1:] == at[:-1] + 1
        first = np.flatnonzero(follows)
        counted = old[code[first]] & old[code[first + 1]]
        last_word = block.numbers[at[first] + k - 1]
        at, pair = at[first], code[first] * len(words) + last_word
        code, unique = pd.factorize(pair)
        known = np.zeros(len(unique), bool)
        known[code] = counted
        prefix, word = unique // len(words), unique % len(words)
        hashes = _longer(hashes[prefix], block.hashes[word])
        lang_of = lang_of[prefix]
        text = pc.binary_join_element_wise(text.take(pa.array(prefix)), words.take(pa.array(word)), b" ")
        if k in lengths:
            counts = np.bincount(code[(at < own) & ~known[code]], minlength=len(unique))
            seen = np.flatnonzero(counts)
            yield from _rows(langs.take(pa.array(lang_of[seen])), text.take(pa.array(seen)), k, counts[seen])


def count_phrases(docs: DataFrame, lengths: range, params: MiningParams, now: np.ndarray | None = None,
                  before: np.ndarray | None = None, totals: bool = False) -> DataFrame:
    """Exact counts ``f`` of phrases of ``lengths`` words by ``lang`` whose parts are proposed.

    ``docs`` has ``lang`` (never NULL) and ``text`` (binary). With ``before``, only phrases that a
    pass with that table did not count, those whose parts this pass counts among them. ``totals`` adds a row of no words with the words of each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Proposals(t) if t is not None else None for t in shared.value]
        block = Block()
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                for segment in _segments((batch.column(1)[i].as_py() or b"").lower().translate(PLAIN)):
                    block.add(lang, segment)
                    if block.size >= params.block:
                        words = block.numbered(lang)
                        # the last words of an open piece start phrases that the next block completes
                        tail = words.numbers[1 - params.longest:]
                        tail = tail[np.flatnonzero(np.append(END, tail) == END)[-1]:]
                        yield from _count(words, len(words.numbers) - len(tail), lengths, *tables, totals)
                        block = Block()
                        block.add(lang, b" ".join(words.words.take(pa.array(tail)).to_pylist()))
        if block.size:
            words = block.numbered()
            yield from _count(words, len(words.numbers), lengths, *tables, totals)

    # blocks are sums already: adding them up before the shuffle as well would hold a second table of phrases in every task
    rows = docs.select("lang", "text").mapInArrow(run, COUNTED).repartition("lang", "phrase")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def sample_pieces(docs: DataFrame, one_in: int) -> DataFrame:
    """One in so many pieces of each text, drawn by a hash of row and place: ``lang`` and plain ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [_drawn((t or b"").lower().translate(PLAIN), seed & 0xFFFFFFFF, one_in)
                     for t, seed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], names=["lang", "text"])

    return docs.select("lang", "text", "seed").mapInArrow(run, "lang string, text binary")


def _missing(found: DataFrame, table: np.ndarray) -> DataFrame:
    """Phrases that the table does not propose."""
    shared = found.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed = Proposals(shared.value)
        for batch in batches:
            known = proposed.has(_phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield batch.filter(pa.array(~known))

    return found.select("lang", "phrase").mapInArrow(run, "lang string, phrase binary")


def frequent_phrases(docs: DataFrame, params: MiningParams = MiningParams()) -> tuple[DataFrame, int]:
    """All phrases of up to ``longest`` words that occur ``least`` times in their language, and the passes taken.

    Columns ``lang``, ``phrase`` (binary, words joined by spaces), ``k`` (words), ``f``; a phrase of no
    words holds the language's number of words.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"),
                        F.xxhash64("doc_id", "text").alias("seed"))
    table = np.zeros(params.bits // 64, np.uint64)
    sample = materialize(sample_pieces(texts, params.one_in))
    for k in range(1, params.longest):  # proposals of full length have no border, so they need none
        level = materialize(count_phrases(sample, range(k, k + 1), params, table).where(f"f >= {params.lowered}"))
        grown = propose(level, params.bits, table)
        if np.array_equal(grown, table):
            break
        table = grown
    frequent = F.col("f") >= params.least
    found = materialize(count_phrases(texts, range(1, params.longest + 1), params, table, totals=True).where(frequent | (F.col("k") == 0)))
    failures = materialize(_missing(found.where(F.col("k").between(1, params.longest - 1)), table))
    if failures.isEmpty():
        return found, 1
    grown = propose(failures, params.bits, table)
    fresh = materialize(count_phrases(texts, range(2, params.longest + 1), params, grown, table).where(frequent))
    return found.unionByName(fresh), 2


def _part(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``docs`` has ``doc_id``, ``lang`` and ``text``. Letters A-Z are lower-cased; a NULL lang is ``und``; NULL and
    empty texts have no words; repeated rows count each time; an empty table gives no rows; texts of any
    length are counted whole, in blocks. Phrases of 2 to ``longest`` words that occur ``least`` times are
    scored by their worst cut, floor(1000 a n / (l r)), ties to the shortest first part; a phrase inside
    a longer frequent one that is as frequent is dropped. Equal scores go by count, then by bytes.
    """
    found, _ = frequent_phrases(docs, params)
    found = materialize(found.select("lang", F.col("phrase").cast("string").alias("phrase"), "k", "f"))
    words = F.split("phrase", " ")
    many = found.where("k >= 2").withColumn("w", words)

    longer = many.where("k >= 3").select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))"
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    # a phrase as frequent as a longer one around it tells nothing more
    alone = many.join(longer, ["lang", "phrase"], "left").where("cover is null or cover < f").drop("cover")

    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("head"),
        _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    counts = found.where("k >= 1")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(found.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n")), "lang")
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"1000 * {wide.format('a')} * {wide.format('n')} div ({wide.format('l')} * {wide.format('r')})")
    cuts = cuts.withColumn("score", score.cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    scored = scored.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", "b.score")

    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = scored.withColumn("_salt", salt).withColumn(
        "_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(f"_place <= {params.top}")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.where(f"rank <= {params.top}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
