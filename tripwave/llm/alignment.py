"""Cross-tokenizer alignment by merge paths.

Two tokenizers cut a text into tokens A and B. Merging the end offsets of both gives the
groups: a group ends where an A and a B token end together. The merge of two sorted lists
is a path through a grid; where it crosses every ``steps``-th diagonal is found by binary
search, so the merge falls into pieces of equal work that know nothing of each other. A
long text's pieces are rows that Spark spreads; each emits its groups and what is open at
its two sides, and the open sides are stitched into groups. Short texts are one piece and
are merged where they were encoded.

A link is an A and a B token that end together. How often each pair of ids is linked in
the corpus is counted in a second step over the stored links; the counts of up to
``most_broadcast`` pairs are looked up in tasks, more of them by a salted join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tripwave.llm.vocab import ByteBpe, Pieces, parts_of
from tripwave.operators.ordered import checkpoint_folder, join_per_key, materialize


@dataclass(frozen=True)
class AlignParams:
    """Merge steps of a piece, and the most id pairs whose counts are broadcast (17 bytes each)."""

    steps: int = 32_768
    most_broadcast: int = 4_000_000


def diagonal(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` merged ends are from ``a``, for every diagonal of ``at`` at once; of equals a is first."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # a[mid] is among the first if no more than mid + (b before it) ends go before
        goes = np.zeros(len(at), bool)
        goes[open_] = a[mid[open_]] <= b[at[open_] - mid[open_] - 1]
        low, high = np.where(open_ & goes, mid + 1, low), np.where(open_ & ~goes, mid, high)
    return low


def path_cuts(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``steps`` merge steps begin in ``a`` and ``b``, with both ends; equal ends stay together."""
    at = np.arange(steps, len(a) + len(b), steps)
    i = diagonal(a, b, at)
    j = at - i
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j + split, [len(b)]])


class Writer:
    """Ids in decimal, each with the mark after it, as one buffer."""

    def __init__(self, highest: int) -> None:
        width = len(str(highest)) + 1
        self.digits = np.array([str(i) for i in range(highest + 1)], f"S{width}").view(np.uint8).reshape(-1, width)
        self.widths = np.count_nonzero(self.digits, axis=1)

    def write(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text, and where each id's part ends."""
        cells, widths = self.digits[ids], self.widths[ids]
        cells[np.arange(len(ids)), widths] = marks
        return cells[cells != 0].tobytes(), np.cumsum(widths + 1)


@dataclass
class Merged:
    """Groups of a piece: where A and B tokens end together, their text, and where it ends after each group."""

    a_last: np.ndarray
    b_last: np.ndarray
    body: bytes
    ends: np.ndarray


def merge(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, writer: Writer) -> Merged:
    """The groups that end in a piece; the first one takes all tokens before."""
    place = np.searchsorted(b_ends, a_ends)
    hit = place < len(b_ends)
    hit[hit] = b_ends[place[hit]] == a_ends[hit]
    a_last = np.flatnonzero(hit)
    b_last = place[a_last]
    if not len(a_last):
        return Merged(a_last, b_last, b"", a_last)
    a_size, b_size = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    stop = np.cumsum(a_size + b_size)
    ids = np.empty(stop[-1], np.int64)
    ids[np.arange(a_last[-1] + 1) + np.repeat(np.cumsum(b_size) - b_size, a_size)] = a[:a_last[-1] + 1]
    ids[np.arange(b_last[-1] + 1) + np.repeat(np.cumsum(a_size), b_size)] = b[:b_last[-1] + 1]
    marks = np.full(len(ids), ord(","), np.uint8)
    marks[stop - b_size - 1], marks[stop - 1] = ord("|"), ord(";")
    body, ends = writer.write(ids, marks)
    return Merged(a_last, b_last, body, ends[stop - 1])


ENCODED = ("_row long, doc_id {key}, piece int, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary, "
           "a_start long, b_start long")


def _bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


class Tokens:
    """Both tokenizers, and the lengths in bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        self.a, self.b = ByteBpe(a_path, pattern), Pieces(b_path)
        self.a_len = np.fromiter(map(len, self.a.bytes_of), np.int64)
        self.b_len = np.fromiter(map(len, self.b.bytes_of), np.int64)
        self.writer = Writer(max(len(self.a_len), len(self.b_len)))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text; none if a tokenizer does not give its bytes back."""
        none = np.zeros(0, np.uint32)
        if not text:
            return none, none
        a, b, raw = self.a.encode(" " + text), self.b.encode(text), b" " + text.encode()
        if any(b"".join(map(v.bytes_of.__getitem__, ids.tolist())) != raw for v, ids in ((self.a, a), (self.b, b))):
            return none, none
        return a, b


def _encode(rows: DataFrame, a_path: str, b_path: str, pattern: str, steps: int) -> DataFrame:
    """A row per short text, finished but for the counts, and a row per piece of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(a_path, b_path, pattern)
        for part in parts_of(batches, 2):
            types = [pa.int64(), part.schema.types[1], pa.int32(), *[pa.int64()] * 3, pa.string(), *[pa.binary()] * 2, *[pa.int64()] * 2]
            out = []
            for row, doc_id, text in zip(*[c.to_pylist() for c in part.columns]):
                a, b = tokens.encode(text)
                a_ends, b_ends = np.cumsum(tokens.a_len[a]), np.cumsum(tokens.b_len[b])
                if len(a) + len(b) <= steps:
                    done = merge(a, a_ends, b, b_ends, tokens.writer)
                    digest = hashlib.sha256(done.body[:-1]).hexdigest() if len(a) else ""
                    out.append((row, doc_id, None, len(a), len(b), len(done.ends), digest, _bytes(a[done.a_last]),
                                _bytes(b[done.b_last]), None, None))
                    continue
                i, j = path_cuts(a_ends, b_ends, steps)
                for k in range(len(i) - 1):
                    out.append((row, doc_id, k, len(a), len(b), None, None, _bytes(a[i[k]:i[k + 1]]), _bytes(b[j[k]:j[k + 1]]),
                                int(a_ends[i[k] - 1]) if i[k] else 0, int(b_ends[j[k] - 1]) if j[k] else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    shape = ENCODED.format(key=rows.schema["doc_id"].dataType.simpleString())
    names = [column.split()[0] for column in shape.split(", ")]
    return rows.mapInArrow(run, shape)


def _pieces(long: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Merges each piece of the long texts on its own, then stitches the open groups of a text."""
    key = long.schema["doc_id"].dataType.simpleString()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(a_path, b_path, pattern)
        comma = np.uint8(ord(","))
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                r = one.to_pylist()[0]
                a, b = np.frombuffer(r["a"], "<u4"), np.frombuffer(r["b"], "<u4")
                a_ends, b_ends = r["a_start"] + np.cumsum(tokens.a_len[a]), r["b_start"] + np.cumsum(tokens.b_len[b])
                done = merge(a, a_ends, b, b_ends, tokens.writer)
                first = (done.a_last[0] + 1, done.b_last[0] + 1) if len(done.ends) else (len(a), len(b))
                last = (done.a_last[-1] + 1, done.b_last[-1] + 1) if len(done.ends) else (len(a), len(b))
                sides = [tokens.writer.write(ids, np.full(len(ids), comma))[0]
                         for ids in (a[:first[0]], b[:first[1]], a[last[0]:], b[last[1]:])]
                body = done.body[done.ends[0]:] if len(done.ends) else b""
                yield pa.RecordBatch.from_arrays(
                    [*one.select(["_row", "doc_id", "piece", "n_a", "n_b"]).columns, pa.array([len(done.ends)]),
                     *[pa.array([s], pa.binary()) for s in (*sides, body, _bytes(a[done.a_last]), _bytes(b[done.b_last]))]],
                    names=["_row", "doc_id", "piece", "n_a", "n_b", "n_groups", *MARKS, "a", "b"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now["_row"]]), pa.array([now["doc_id"]], doc_type), pa.array([now["n_a"]]), pa.array([now["n_b"]]),
                 pa.array([state.n]), pa.array([state.digest.hexdigest()]), pa.array([b"".join(state.a)]), pa.array([b"".join(state.b)])],
                names=["_row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if now is not None and now["_row"] != r["_row"]:
                    yield finished()
                    now = None
                if now is None:
                    now, state = r, Stitched()
                state.add(r)
        if now is not None:
            yield finished()

    shape = "_row long, doc_id {key}, {piece}n_a long, n_b long, n_groups long, {more}, a binary, b binary"
    parts = long.repartition("_row", "piece").mapInArrow(groups, shape.format(
        key=key, piece="piece int, ", more=", ".join(f"{m} binary" for m in MARKS)))
    ordered = parts.repartition("_row").sortWithinPartitions("_row", "piece")
    return ordered.mapInArrow(stitch, shape.format(key=key, piece="", more="groups_sha256 string"))


MARKS = ("head_a", "head_b", "tail_a", "tail_b", "body")


class Stitched:
    """A text's groups from its pieces in order."""

    def __init__(self) -> None:
        self.digest, self.n = hashlib.sha256(), 0
        self.open_a, self.open_b, self.a, self.b = b"", b"", [], []

    def add(self, piece: dict) -> None:
        self.open_a += piece["head_a"]
        self.open_b += piece["head_b"]
        if not piece["n_groups"]:
            return
        between = b";" if self.n else b""
        # the marks at the end of the parts: "," after the last id, ";" after the last group
        self.digest.update(between + self.open_a[:-1] + b"|" + self.open_b[:-1])
        if piece["body"]:
            self.digest.update(b";" + piece["body"][:-1])
        self.open_a, self.open_b = piece["tail_a"], piece["tail_b"]
        self.n += piece["n_groups"]
        self.a.append(piece["a"])
        self.b.append(piece["b"])


def _compact(df: DataFrame) -> DataFrame:
    """Like ``materialize``, with a codec that halves columns of ids."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One number for the pair of each link of a batch, and the links of each row."""
    sides = [np.frombuffer(b"".join(x.to_pylist()), "<u4").astype(np.int64) for x in (a, b)]
    return sides[1] << 32 | sides[0], np.fromiter((len(x) // 4 for x in a.to_pylist()), np.int64)


def pair_counts(links: DataFrame) -> DataFrame:
    """``code`` (B id and A id), ``n`` (links of the pair), ``best`` (no pair of the B id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            codes, unique = pd.factorize(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(unique), pa.array(np.bincount(codes, minlength=len(unique)))],
                                              names=["code", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(_codes(part.column(0), part.column(1))[0])
                size += len(held[-1])
                if size >= 4_000_000:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = links.select("a", "b").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    top = counts.groupBy(F.shiftright("code", 32).alias("_b")).agg(F.max("n").alias("_top"))
    return counts.join(top, F.shiftright("code", 32) == F.col("_b")).select("code", "n", (F.col("n") == F.col("_top")).alias("best"))


def summaries(links: DataFrame, counts: DataFrame, most_broadcast: int = AlignParams.most_broadcast) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of aligned texts."""
    counts = materialize(counts)
    if counts.count() > most_broadcast:
        return _joined(links, counts)
    table = counts.toArrow().sort_by("code")
    shared = links.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        best = best.astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, sizes = _codes(part.column("a"), part.column("b"))
                place, ends = np.searchsorted(known, codes), np.cumsum(sizes)
                sums = [np.concatenate([[0], np.cumsum(x[place])]) for x in (best, n)]
                n_best, count_sum = [pa.array(s[ends] - s[ends - sizes]) for s in sums]
                doc_id, n_a, n_b, n_groups, digest = part.columns[:5]
                yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, pa.array(sizes), n_best, count_sum, digest],
                                                 names=SUMMARY)

    key = links.schema["doc_id"].dataType.simpleString()
    return links.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b").mapInArrow(
        run, f"doc_id {key}, {', '.join(f'{c} long' for c in SUMMARY[1:-1])}, groups_sha256 string")


SUMMARY = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _joined(links: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join: a row per text and pair, the rows of a pair that many texts hold spread by a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, sizes = _codes(part.column("a"), part.column("b"))
                pairs = pd.DataFrame({"_row": np.repeat(part.column("_row").to_numpy(), sizes), "code": codes})
                times = pairs.groupby(["_row", "code"], sort=False).size().rename("times").reset_index()
                yield pa.RecordBatch.from_pandas(times, preserve_index=False)

    pairs = links.select("_row", "a", "b").mapInArrow(run, "_row long, code long, times long")
    sums = join_per_key(pairs, counts, ["code"], ["_row"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = links.select("_row", "doc_id", "n_a", "n_b", "n_groups", (F.octet_length("a") / 4).cast("long").alias("n_links"),
                        "groups_sha256")
    return rows.join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"]).select(*SUMMARY)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, params: AlignParams = AlignParams()) -> DataFrame:
    """Groups and links of each text: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256`` (of the ids by group,
    ``a1,a2|b1;a3|b2``), ``a`` and ``b`` (ids of the links in order, little-endian 32 bit), and ``_row``, a number of the row.

    A is a byte-level vocabulary that gets the text after a space, B a sentencepiece model that adds the space.
    NULL and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros
    and an empty digest. Repeated rows count each time; a NULL id is kept; an empty table gives no rows.
    A text of any length is encoded whole by one task and merged by many.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    encoded = _compact(_encode(rows, a_path, b_path, pattern, params.steps))
    long = _compact(_pieces(encoded.where("piece is not null"), a_path, b_path, pattern))
    shape = ["_row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"]
    return encoded.where("piece is null").select(*shape).unionByName(long.select(*shape))


def align_documents(docs: DataFrame, a_path: str, b_path: str, pattern: str, params: AlignParams = AlignParams()) -> DataFrame:
    """``align`` with each text's links counted: ``n_links``, ``n_best`` (links whose id pair is the most frequent one of
    its B id in the corpus, ties included) and ``count_sum`` (corpus counts of its links' pairs)."""
    links = align(docs, a_path, b_path, pattern, params)
    return summaries(links, pair_counts(links), params.most_broadcast)
