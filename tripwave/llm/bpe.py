"""Byte-level BPE by overlapping chunks.

Long texts become chunk rows that overlap. Each chunk is pre-tokenised on its own, in
parallel; a chunk that begins inside a pre-token is wrong at first and right from the
first boundary that it shares with its predecessor, as the pattern looks only ahead.
Stitching keeps each chunk from such a boundary on; where two chunks share none, the
text between is pre-tokenised again from the last sure boundary. The pieces are then
encoded by merge ranks, and decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripwave.llm.text import ROWS_AT_ONCE


@dataclass(frozen=True)
class Chunking:
    """Code points of a chunk, by how much it overlaps the next, and how far ahead of a piece's end the pattern looks."""

    size: int = 16_384
    overlap: int = 512
    ahead: int = 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the lowest-ranked neighbouring pair is merged first, the leftmost of equals.

    A heap of pairs over a linked list, so a long run costs n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    end, n = list(range(1, len(piece) + 1)), len(piece)
    back = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := back[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Merges:
    """Merges of many short pieces at once, and decoding, with arrays over the vocabulary."""

    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.start = np.cumsum(self.length) - self.length
        by_id = sorted(ranks, key=ranks.get)
        self.text = np.frombuffer(b"".join(by_id), np.uint8)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.merged[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; every round merges the lowest-ranked pair of each piece, the leftmost of equals."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), self.NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(ids))
            open_ = np.repeat(lowest < self.NONE, sizes)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_owner.append(owner[~open_])
                ids, owner, rank = ids[open_], owner[open_], rank[open_]
                lowest, sizes = lowest[lowest < self.NONE], sizes[lowest < self.NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]
            ids[at] = rank[at]
            rank[at] = self.NONE
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            for k in (at, at - 1):  # the pairs on both sides of what was merged
                k = k[(k >= 0) & (k + 1 < len(ids))]
                k = k[owner[k] == owner[k + 1]]
                rank[k] = self._rank(ids[k], ids[k + 1])
        ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of the ids one after the other, gathered from one table."""
        ids = np.frombuffer(packed, "<u4")
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.text[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Encoder(dict):
    """Piece to its packed ids (little-endian 32 bit), remembered up to a bound."""

    MOST, LONGEST = 300_000, 64

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.merges = ranks, Merges(ranks)

    def __missing__(self, piece: str) -> bytes:
        """A piece too long to be remembered."""
        return np.array(merge(piece.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are new, all at once."""
        if len(self) + len(pieces) > self.MOST:
            self.clear()
        new = [p for p in pieces if p not in self and len(p) <= self.LONGEST]
        raw = [p.encode("utf-8", "replace") for p in new]
        whole = [self.ranks.get(r) for r in raw]
        self.update((p, int(r).to_bytes(4, "little")) for p, r in zip(new, whole) if r is not None)
        rest = [(p, r) for p, r, w in zip(new, raw, whole) if w is None]
        if rest:
            self.update(zip([p for p, _ in rest], self.merges.merge([r for _, r in rest])))

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of texts that are given as pieces."""
        self.learn(set().union(*texts))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in texts]

    def decode(self, packed: bytes) -> bytes:
        return self.merges.decode(packed)


def sure_pieces(pieces: list[str], size: int, last: bool, ahead: int) -> int:
    """How many leading pieces of a chunk do not depend on what follows the chunk."""
    end, n = size, len(pieces)
    while not last and n and end > size - ahead:
        n -= 1
        end -= len(pieces[n])
    return n


def stitch(chunks: list[tuple[int, str, list[str]]], find, ahead: int) -> list[str]:
    """Pieces of a text from its chunks (start, text, pieces) in order."""
    out: list[str] = []
    done = 0  # the text before this position is final and ends at a boundary
    held = ""  # the text from there to the end of the chunks seen
    wait = 0  # a run without a boundary is tried again when it has doubled
    for k, (start, text, pieces) in enumerate(chunks):
        last = k == len(chunks) - 1
        seen = done + len(held)
        own = pieces[:sure_pieces(pieces, len(text), last, ahead)]
        at, first = start, None
        if done >= start:
            for i, piece in enumerate(own):
                if at >= done:
                    first = i if at == done else None
                    break
                at += len(piece)
        if first is None:  # no shared boundary yet: from the last sure one up to one
            marks, at = {}, start
            for i, piece in enumerate(own):
                marks[at] = i
                at += len(piece)
            held += text[seen - start:]
            if len(held) < wait and not last:
                continue
            fresh = find(held)
            fresh = fresh[:sure_pieces(fresh, len(held), last, ahead)]
            at = done
            for piece in fresh:
                if at in marks and at > done:
                    first = marks[at]
                    break
                out.append(piece)
                at += len(piece)
            held, done = held[at - done:], at
            if first is None:
                wait = 2 * len(held)
                continue
        wait = 0
        out += own[first:]
        done += sum(map(len, own[first:]))
        held = text[done - start:]
    return out


def _short(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes texts of one chunk where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, find = Encoder(read_ranks(ranks_path)), regex.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                packed = encoder.encode([find(t) for t in part.column(1).to_pylist()])
                yield _encoded(part.column(0), packed, encoder)

    return rows.mapInArrow(run, _schema(rows))


def _schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary"


def _encoded(doc_ids: pa.Array, packed: list[bytes], encoder: Encoder) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(packed, pa.binary()), pa.array(map(encoder.decode, packed), pa.binary())],
        names=["doc_id", "ids", "decoded"])


def _long(rows: DataFrame, ranks_path: str, pattern: str, cut: Chunking) -> DataFrame:
    """Encodes long texts: chunks pre-tokenised in parallel, then one row per text stitched and encoded."""
    n = F.ceil(F.length("text") / cut.size).cast("int")
    chunks = rows.select("_row", "doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("_chunk"), "text").select(
        "_row", "doc_id", "_chunk", (F.col("_chunk") * cut.size).alias("_start"),
        F.substring("text", F.col("_chunk") * cut.size + 1, F.lit(cut.size + cut.overlap)).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                lengths = [np.fromiter(map(len, find(t)), np.int32).tolist() for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lengths, pa.list_(pa.int32()))],
                                                 names=[*part.schema.names, "_lengths"])

    key = rows.schema["doc_id"].dataType.simpleString()
    spread = chunks.repartition("_row", "_chunk").mapInArrow(
        split, f"_row long, doc_id {key}, _chunk int, _start int, _text string, _lengths array<int>")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, find = Encoder(read_ranks(ranks_path)), regex.compile(pattern).findall

        def finished(doc_id, parts) -> pa.RecordBatch:
            pieces = stitch(parts, find, cut.ahead)
            return _encoded(pa.array([doc_id], doc_type), encoder.encode([pieces]), encoder)

        now, parts = None, []
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for row in batch.to_pylist():
                if now is not None and now[0] != row["_row"]:
                    yield finished(now[1], parts)
                    parts = []
                now = row["_row"], row["doc_id"]
                ends = np.cumsum(row["_lengths"])
                parts.append((row["_start"], row["_text"],
                              [row["_text"][e - k:e] for e, k in zip(ends.tolist(), row["_lengths"])]))
        if now is not None:
            yield finished(now[1], parts)

    ordered = spread.repartition("_row").sortWithinPartitions("_row", "_chunk")
    return ordered.mapInArrow(join, _schema(rows))


def encode(docs: DataFrame, ranks_path: str, pattern: str, cut: Chunking = Chunking()) -> DataFrame:
    """``doc_id``, ``ids`` (packed little-endian 32 bit) and ``decoded`` (raw bytes) of each text.

    ``ranks_path`` is a vocabulary file that every executor can read. NULL counts as empty;
    empty texts have no ids; repeated rows are encoded one by one; an empty table gives no rows; a text of any
    length is encoded whole, beyond one chunk in overlapping chunks.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > cut.size
    texts = rows.where(long).withColumn("_row", F.monotonically_increasing_id())
    return _short(rows.where(~long), ranks_path, pattern).unionByName(_long(texts, ranks_path, pattern, cut))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


