"""Packing documents into sequences by cutting-stock column generation.

Whole sequences are cut off long documents first; what is left of each document is shorter
than a sequence. The lengths of these rests form a histogram of a few hundred bins. A
linear program over patterns (how many rests of each bin a sequence holds) minimises the
number of sequences; columns are priced by a knapsack over the bins, and generation ends
when a bound shows that little can be gained. Rounded down patterns are repeated as often as
the program says. The few rests that rounding leaves are packed by exact lengths, and cut
where no sum fits. All this sees the histogram only, which has one size whatever the table.

Documents are ranked inside their length by ranges, without a task that holds a length,
and the rank decides the sequence: a lookup in the table of patterns.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tripwave.llm.vocab import ByteBpe, parts_of
from tripwave.operators.ordered import CHUNK, Axis, checkpoint_folder, materialize, range_chunks, row_index, running


@dataclass(frozen=True)
class PackParams:
    """Tokens of a sequence, tokens of a histogram bin, and the id that ends a document.

    Column generation ends at ``gap`` above the least possible number of sequences. A rest that
    rounding leaves is cut to fill a sequence if ``least_cut`` tokens or more would be padding.
    """

    size: int = 2048
    width: int = 4
    end_id: int = 1
    gap: float = 0.0005
    least_cut: int = 32


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row operations; threads of a linear algebra library would compete with Spark's."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + np.abs(both[k:, k]).argmax()
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)
        both[rows] -= np.outer(factors[rows], both[k])
    return both[:, n:]


class Columns:
    """The linear program over patterns.

    A row per kind of rest (sorted sizes), whose rests must all get places. Besides patterns, which cost one
    sequence, there are free columns: a place may take a rest of the next smaller kind, and a place of the
    smallest may stay empty. So larger rests never have smaller duals, which keeps them from swinging.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, room: int) -> None:
        self.sizes, self.counts, self.room = sizes, counts.astype(float), room
        self.counts += np.linspace(0, 1e-4, len(sizes))  # no two ratios are equal, so steps do not run in circles
        fits = room // sizes
        self.basis = np.diag(fits).astype(float)  # a pattern per kind: as many as fit
        self.cost = np.ones(len(sizes))
        self.inverse = np.diag(1.0 / fits)
        self.used = self.counts / fits
        self.duals = self.inverse.sum(axis=0)
        self.upto = np.searchsorted(sizes, np.arange(room + 1), "right")

    def best(self, values: np.ndarray) -> tuple[float, np.ndarray]:
        """The pattern of the highest value: knapsack by dynamic programming."""
        top, pick = np.zeros(self.room + 1), np.full(self.room + 1, -1)
        for s in range(1, self.room + 1):
            top[s] = top[s - 1]
            if k := self.upto[s]:
                sums = top[s - self.sizes[:k]] + values[:k]
                j = sums.argmax()
                if sums[j] > top[s] + 1e-12:
                    top[s], pick[s] = sums[j], j
        pattern, s = np.zeros(len(self.sizes)), self.room
        while s > 0:
            if pick[s] < 0:
                s -= 1
            else:
                pattern[pick[s]] += 1
                s -= self.sizes[pick[s]]
        return float(top[-1]), pattern

    def _priced(self, gap: float) -> tuple[np.ndarray, float] | None:
        """A column that lowers the number of sequences, and its cost; none if no more than ``gap`` can be gained."""
        duals = self.duals
        falls = np.diff(duals, prepend=0.0)
        k = falls.argmin()
        if falls[k] < -1e-9:  # the rest of kind k is dearer than a smaller one, or costs less than nothing
            column = np.zeros(len(duals))
            column[k] = -1.0
            if k:
                column[k - 1] = 1.0
            return column, 0.0
        value, pattern = self.best(duals)
        return None if value <= 1 + gap else (pattern, 1.0)  # duals over the highest value are a bound

    def solve(self, gap: float) -> int:
        """Simplex steps, each with a priced column; returns their number."""
        step = 0
        while (found := self._priced(gap)) is not None and step < 40 * len(self.sizes):
            entering, cost = found
            held = np.flatnonzero(entering)
            column = (self.inverse[:, held] * entering[held]).sum(axis=1)
            rows = np.flatnonzero(column > 1e-9)
            out = rows[np.argmin(self.used[rows] / column[rows])]
            self.basis[:, out], self.cost[out] = entering, cost
            step += 1
            if step % 512 == 0:  # what rounding has gathered goes
                self.inverse = _inverse(self.basis)
                self.duals = self.inverse[self.cost > 0].sum(axis=0)
                self.used = np.maximum((self.inverse * self.counts).sum(axis=1), 0)
                continue
            row, share = self.inverse[out] / column[out], self.used[out] / column[out]
            self.duals = self.duals + (cost - (self.duals[held] * entering[held]).sum()) * row
            self.used = np.maximum(self.used - share * column, 0)
            self.used[out] = share
            moved = np.flatnonzero(np.abs(column) > 1e-13)
            self.inverse[moved] -= np.outer(column[moved], row)
            self.inverse[out] = row
        return step

    def rounded(self) -> tuple[np.ndarray, np.ndarray]:
        """Patterns (a column each) and whole repeats: rounded down, then one more where the rests fill it, largest fractions first."""
        own = np.flatnonzero(self.cost > 0)
        patterns, used = np.rint(self.basis[:, own]).astype(np.int64), self.used[own]
        times = np.floor(used + 1e-9).astype(np.int64)
        free = np.cumsum(np.floor(self.counts[::-1]).astype(np.int64) - (patterns @ times)[::-1])  # rests of a size or more without a place
        for p in np.argsort(times - used, kind="stable"):
            more = free - np.cumsum(patterns[::-1, p])
            if used[p] > times[p] and (more >= 0).all():
                times[p] += 1
                free = more
        return patterns, times


def _fill(lengths: np.ndarray, counts: np.ndarray, room: int) -> list[int]:
    """Places of the lengths whose sum is nearest to ``room`` from below; long ones are preferred."""
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for k in range(len(lengths)):  # from short to long, so that the way back meets long ones first
        left, part = min(int(counts[k]), room // int(lengths[k])), 1
        while left > 0:
            part = min(part, left)
            grown = reach | reach << part * int(lengths[k]) & mask
            if grown != reach:
                steps.append((reach, k, part))
                reach = grown
            left -= part
            part *= 2
    at, chosen = reach.bit_length() - 1, []
    for before, k, part in reversed(steps):
        if not before >> at & 1:
            chosen += [k] * part
            at -= part * int(lengths[k])
    return chosen


@dataclass
class Rest:
    """Part of a document's rest: rank of the document in its length, first token, tokens."""

    length: int
    rank: int
    start: int
    tokens: int


def pack_exactly(lengths: np.ndarray, counts: np.ndarray, first: np.ndarray, p: PackParams) -> list[list[Rest]]:
    """Sequences of a few rests by exact length, those of ``lengths[i]`` with ranks from ``first[i]`` on.

    The longest rest left is joined by the sum that fits best; where too much would be padding, one
    more rest is cut. The last sequence is cut into powers of two, which need no padding.
    """
    by_tokens: dict[int, list[Rest]] = {}
    for length, n, rank in zip(lengths.tolist(), counts.tolist(), first.tolist()):
        if n:
            by_tokens[length] = [Rest(length, r, 0, length) for r in range(rank + n - 1, rank - 1, -1)]

    def take(tokens: int) -> Rest:
        rest = by_tokens[tokens].pop()
        if not by_tokens[tokens]:
            del by_tokens[tokens]
        return rest

    out = []
    while by_tokens:
        sequence = [take(max(by_tokens))]
        room = p.size - sequence[0].tokens
        kinds = np.array(sorted(t for t in by_tokens if t <= room), int)
        for k in _fill(kinds, np.array([len(by_tokens[t]) for t in kinds.tolist()], int), room):
            sequence.append(take(int(kinds[k])))
            room -= sequence[-1].tokens
        if room >= p.least_cut and by_tokens:
            rest = take(max(by_tokens))  # longer than the room, else it would have been chosen
            sequence.append(Rest(rest.length, rest.rank, rest.start, room))
            left = Rest(rest.length, rest.rank, rest.start + room, rest.tokens - room)
            by_tokens.setdefault(left.tokens, []).append(left)
        out.append(sequence)
    if out and (total := sum(r.tokens for r in out[-1])) < p.size:
        out[-1:] = _powers(out[-1], total)
    return out


def _powers(sequence: list[Rest], total: int) -> list[list[Rest]]:
    """A sequence cut into sequences of a power of two each."""
    out, rests = [], sequence[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room, part = total & 1 << bit, []
        while room:
            rest = rests.pop()
            if rest.tokens > room:
                rests.append(Rest(rest.length, rest.rank, rest.start + room, rest.tokens - room))
                rest = Rest(rest.length, rest.rank, rest.start, room)
            part.append(rest)
            room -= rest.tokens
        if part:
            out.append(part)
    return out


PLAN = "bin int, from_rank long, to_rank long, sequence long, repeats long, turn long, slot long, start long, tokens long"


def plan(histogram: np.ndarray, p: PackParams) -> tuple[list[tuple], int]:
    """Where rests go, and the number of sequences. ``histogram[n]`` is the number of rests of n tokens.

    Rests are ranked by bin, long ones first. Places of the patterns are dealt out from large to small, so a rest gets
    a place of its own size or more. A row is a run of ranks in a bin: the sequences of a pattern in turn, from
    ``turn`` on; ``start`` and ``tokens`` are the part of the rest (NULL: all of it).
    """
    bins = -(-np.arange(len(histogram)) // p.width)
    by_bin = np.bincount(bins, histogram, p.size // p.width + 1).astype(np.int64)
    kinds = np.flatnonzero(by_bin[1:]) + 1
    rows, n, used = [], 0, np.zeros(len(by_bin), np.int64)
    if len(kinds):
        program = Columns(kinds, by_bin[kinds], p.size // p.width)
        program.solve(p.gap)
        patterns, times = program.rounded()
        places, slots = [], np.zeros(len(times), np.int64)  # runs of places, from large to small
        first = np.cumsum(times) - times
        for k in range(len(kinds) - 1, -1, -1):
            for q in np.flatnonzero(patterns[k] * times).tolist():
                many = int(patterns[k, q] * times[q])
                places.append([many, int(first[q]), int(times[q]), 0, int(slots[q])])
                slots[q] += patterns[k, q]
            b, need = int(kinds[k]), int(by_bin[kinds[k]])
            while need and places:
                many, sequence, repeats, turn, slot = places[0]
                take = min(need, many)
                rows.append((b, int(used[b]), int(used[b]) + take, sequence, repeats, turn, slot, 0, None))
                used[b] += take
                need -= take
                if take == many:
                    places.pop(0)
                else:
                    places[0][0], places[0][3] = many - take, turn + take
        n = int(times.sum())
    longer = ranks_before(histogram, p)
    first = np.clip(used[bins] - longer, 0, histogram)  # of each length, the rests that patterns take
    left = np.where(np.arange(len(histogram)) > 0, histogram - first, 0)
    exact = np.flatnonzero(left)
    for sequence in pack_exactly(exact, left[exact], first[exact], p):
        for slot, r in enumerate(sequence):
            rank = int(longer[r.length]) + r.rank
            rows.append((int(bins[r.length]), rank, rank + 1, n, 1, 0, slot, r.start, r.tokens))
        n += 1
    return rows, n


def ranks_before(histogram: np.ndarray, p: PackParams) -> np.ndarray:
    """For each length, how many rests of its bin are longer."""
    out, bins = np.zeros(len(histogram), np.int64), -(-np.arange(len(histogram)) // p.width)
    for n in range(len(histogram) - 2, -1, -1):
        if bins[n] == bins[n + 1]:
            out[n] = out[n + 1] + histogram[n + 1]
    return out


ENCODED = "_row long, doc_id {key}, doc_tokens long, rest int, crcs array<long>, ids binary"


def encode(docs: DataFrame, path: str, pattern: str, p: PackParams) -> DataFrame:
    """A row per document: its tokens with the end id, CRC-32 of each whole sequence and of the rest, the packed ids."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ByteBpe(path, pattern)
        for part in parts_of(batches, 2):
            packed = [np.append(vocabulary.encode(t or ""), p.end_id).astype("<u4") for t in part.column(2).to_pylist()]
            crcs = [[zlib.crc32(ids[i:i + p.size]) for i in range(0, len(ids), p.size)] for ids in packed]
            sizes = np.fromiter(map(len, packed), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes), pa.array((sizes % p.size).astype(np.int32)),
                 pa.array(crcs, pa.list_(pa.int64())), pa.array([ids.tobytes() for ids in packed], pa.binary())],
                names=["_row", "doc_id", "doc_tokens", "rest", "crcs", "ids"])

    encoded = rows.mapInArrow(run, ENCODED.format(key=rows.schema["doc_id"].dataType.simpleString()))
    table = f"{checkpoint_folder(docs.sparkSession)}/table-{uuid.uuid4().hex}"
    encoded.write.option("compression", "zstd").parquet(table)
    return docs.sparkSession.read.schema(encoded.schema).parquet(table)


def _slices(cut: DataFrame) -> DataFrame:
    """CRC-32 of the parts of documents that were cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, n = batch.column("ids").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist()
            sums = pa.array([zlib.crc32(i[4 * s:4 * (s + k)]) for i, s, k in zip(ids, at, n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PIECE if c != "ids_crc32"], sums],
                                             names=[*[c for c in PIECE if c != "ids_crc32"], "ids_crc32"])

    kind = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    columns = [c for c in PIECE if c != "ids_crc32"]
    return cut.select(*columns, "ids").mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in columns) + ", ids_crc32 long")


PIECE = ["_row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]


def assign(encoded: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """Pieces of encoded documents in sequences: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, and ``_row``, which tells documents of one id apart."""
    spark = encoded.sparkSession
    narrow = encoded.select("_row", "doc_id", "doc_tokens", "rest", "crcs")
    histogram = np.zeros(p.size, np.int64)
    for rest, n in narrow.groupBy("rest").count().collect():  # at most as many rows as a sequence has tokens
        histogram[rest] = n
    rows, sequences = plan(histogram, p)
    lookup = spark.createDataFrame(rows, PLAN) if rows else spark.createDataFrame([], PLAN)
    before = spark.createDataFrame(list(enumerate(ranks_before(histogram, p).tolist())), "rest int, _before long")

    whole = F.floor(F.col("doc_tokens") / p.size)
    ranged = range_chunks(narrow, ["rest", "_row"])
    ranked = running(ranged, Axis((), ("rest", "_row"), None), {"_upto": whole}, keep_chunk=True)
    ranked = row_index(ranked, Axis(("rest",), ("_row",), None), "_rank")
    ranked = ranked.withColumn("_whole", whole).withColumn("bin", F.ceil(F.col("rest") / p.width).cast("int"))

    full = ranked.where("_whole > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)))
    full = full.select("_row", "doc_id", (F.col("k") * p.size).alias("start"), F.lit(p.size).cast("long").alias("length"),
                       F.get("crcs", F.col("k").cast("int")).alias("ids_crc32"), "doc_tokens",
                       (F.lit(sequences) + F.col("_upto") - F.col("_whole") + F.col("k")).alias("sequence_id"),
                       F.lit(0).cast("long").alias("slot"))

    rests = ranked.where("rest > 0").join(F.broadcast(before), "rest").withColumn("_place", F.col("_rank") + F.col("_before"))
    placed = rests.join(F.broadcast(lookup), "bin").where("from_rank <= _place and _place < to_rank")
    turn = F.col("_place") - F.col("from_rank") + F.col("turn")
    placed = placed.select(
        "_row", "doc_id", (F.col("_whole") * p.size + F.col("start")).alias("start"),
        F.coalesce("tokens", F.col("rest").cast("long")).alias("length"), F.get("crcs", F.col("_whole").cast("int")).alias("ids_crc32"),
        "doc_tokens", (F.col("sequence") + turn % F.col("repeats")).alias("sequence_id"),
        (F.col("slot") + F.floor(turn / F.col("repeats"))).alias("slot"), (F.col("tokens") < F.col("rest")).alias("_cut"))
    placed = materialize(placed)
    # as many as the plan cuts, which rounding bounds: a few rests for each pattern
    parts = _slices(encoded.select("_row", "ids").join(F.broadcast(placed.where("_cut")), "_row"))
    rests = placed.where("_cut is null or not _cut").select(*PIECE).unionByName(parts)
    before_it = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(before_it), F.lit(0)))
    return rests.unionByName(full.withColumn("offset", F.lit(0).cast("long"))).drop("slot")


def pack_documents(docs: DataFrame, path: str, pattern: str, p: PackParams = PackParams()) -> DataFrame:
    """Every document cut into pieces and packed; see ``assign`` for the columns.

    ``docs`` has ``doc_id`` and ``text``. NULL and empty texts are the end id alone; repeated rows and ids are documents
    of their own; a NULL id is kept; texts of any length are encoded whole; an empty table gives no rows.
    Documents of one length are ranked by their place in the table.
    """
    return assign(encode(docs, path, pattern, p), p)


def sequences(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed ids (little-endian 32 bit) of each sequence: ``sequence_id``, ``n_tokens``, ``ids``.

    A sequence has at most as many pieces as tokens, so its group is bounded.
    """
    part = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    rows = pieces.select("_row", "start", "length", "sequence_id", "offset").join(encoded.select("_row", "ids"), "_row")
    rows = rows.select("sequence_id", "offset", "length", part.alias("part"))
    grouped = rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("p"))
    return grouped.select("sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (x, y) -> concat(x, y.part))").alias("ids"))
