"""N-gram Jaccard join by signature trees.

Texts become sets of shingle hashes; equal sets are one node. Two sets that are similar
enough share one of the first shingles of either in any common order (prefix filter), so
the sets that share such a shingle form a block, and every link lies in a block. The
order puts shingles that many documents share last, which keeps blocks small.

Inside a block the sets are leaves of a signature tree: nodes hold OR-combined token
bitmaps, size ranges and whether all below is one component already. A dual traversal
prunes node pairs whose maximum possible overlap is too small, then document pairs by
their own bitmaps. What is left is verified on the exact sets. A first round takes one
candidate per document, which joins tight groups by few pairs; a second one takes all
pairs that are left between different components. Blocks above a bound are cut
into chunks by size, which are the tree's upper nodes: pairs of chunks are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripwave.llm.components import connected_components
from tripwave.llm.shingles import WordHasher, set_key, signature
from tripwave.llm.text import ROWS_AT_ONCE
from tripwave.operators.ordered import materialize


@dataclass(frozen=True)
class JoinParams:
    """Shingles of ``words`` words; a link needs ``percent`` of the union.

    ``hints`` bounds the table of frequent shingles that sets the order (no row depends on
    it, only the cost), ``segment`` the shingles counted at a time in a task; a block of
    more than ``chunk`` sets is cut; ``leaf`` is a tree node's fan-out.
    """

    words: int = 4
    percent: int = 85
    hints: int = 1 << 17
    frequent: int = 32
    segment: int = 2_000_000
    chunk: int = 2048
    leaf: int = 64


def least_overlap(a, b, percent: int):
    """Smallest intersection with which sets of ``a`` and ``b`` shingles link."""
    return -((-percent * (a + b)) // (100 + percent))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def sketch(docs: DataFrame, params: JoinParams) -> DataFrame:
    """One row per document (``doc_id``, ``n``, ``key``) and one per locally frequent shingle (``token``, ``times``)."""
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0

        def frequent() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 3
            n = int(often.sum())
            return _batch(doc_id=pa.nulls(n, id_type), n=pa.nulls(n, pa.int64()), key=pa.nulls(n, pa.int64()),
                          token=token[often], times=times[often].astype(np.int64))

        for part in _pages(batches):
            id_type, found = part.column(0).type, []
            for text in part.column(1).to_pylist():
                s = hasher.shingles(text, params.words)
                found.append((len(s), set_key(s)))
                held.append(s)
                size += len(s)
                if size > params.segment:
                    yield frequent()
                    held, size = [], 0
            n = part.num_rows
            yield _batch(doc_id=part.column(0), n=pa.array([f[0] for f in found], pa.int64()),
                         key=pa.array([f[1] for f in found], pa.int64()), token=pa.nulls(n, pa.int64()), times=pa.nulls(n, pa.int64()))
        if held:
            yield frequent()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key_type}, n long, key long, token long, times long")


def order_hints(sketched: DataFrame, params: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and the class of each: the logarithm of its count (``hints`` rows at most)."""
    times = sketched.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
    table = times.where(F.col("times") >= params.frequent).orderBy(F.desc("times"), "token").limit(params.hints).toArrow()
    token, count = table["token"].to_numpy(), table["times"].to_numpy()
    order = np.argsort(token)
    return token[order], np.log2(count[order]).astype(np.uint8)


def prefixes(docs: DataFrame, hints: tuple[np.ndarray, np.ndarray], params: JoinParams) -> DataFrame:
    """Prefix shingles (``token``, ``key``, ``n``, ``front``) and bitmaps (``key``, ``bits``) of the distinct sets.

    ``front`` marks the shorter prefix that is enough for the smaller set of a pair. A task
    names a set once if it meets it again soon.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hints)
    percent = params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (known, classes), seen = WordHasher(), shared.value, set()
        for part in _pages(batches):
            tokens, keys, sizes, fronts, bits = [], [], [], [], []
            for text in part.column(0).to_pylist():
                s = hasher.shingles(text, params.words)
                n = len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(key)
                long = n - least_overlap(n, -(-percent * n // 100), percent) + 1
                short = n - least_overlap(n, n, percent) + 1
                if len(known):
                    at = np.searchsorted(known, s)
                    at[at == len(known)] = 0
                    order = np.argsort(np.where(known[at] == s, classes[at], 0).astype(np.uint8), kind="stable")[:long]
                else:
                    order = np.arange(long)
                tokens.append(s[order])
                keys.append(key)
                sizes.append(n)
                fronts.append(np.arange(long) < short)
                bits.append(signature(s))
            if keys:
                times = [len(t) for t in tokens]
                own, n = np.array(keys, np.int64), np.array(sizes, np.int32)
                rows = sum(times)
                yield _batch(token=np.concatenate(tokens), key=np.repeat(own, times), n=np.repeat(n, times),
                             front=np.concatenate(fronts), bits=pa.nulls(rows, pa.binary()))
                yield _batch(token=pa.nulls(len(own), pa.int64()), key=own, n=n, front=pa.nulls(len(own), pa.bool_()),
                             bits=pa.array(bits, pa.binary()))

    return docs.select("text").mapInArrow(run, "token long, key long, n int, front boolean, bits binary")


def blocks(entries: DataFrame, params: JoinParams) -> DataFrame:
    """Entries that may have a partner: ``token``, ``chunk``, ``key``, ``n``.

    The entries are range-sorted by shingle and size, so that a shingle of any frequency is
    spread over tasks. Kept are entries with a neighbour of fitting size in their run. Runs
    that end inside a task and fit in a chunk have chunk -1; others get rising numbers.
    """
    percent, most = params.percent, params.chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        state = {"open": True, "number": 0}  # open: the run may have begun in another task

        def emit(token, key, n, front, last: bool) -> Iterator[pa.RecordBatch]:
            """Whole runs, or with ``last`` the final ones; rows of one run are consecutive."""
            if not len(token):
                return
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, n, front = token[new], key[new], n[new], front[new]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            run_of = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]).astype(np.int64)]))
            size = np.diff(np.concatenate([start, [len(token)]]))
            edge = np.zeros(len(start), bool)
            edge[0], edge[-1] = state["open"], edge[-1] or last
            state["open"] = False
            fits = (run_of[1:] == run_of[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:])
            near = np.zeros(len(token), bool)
            near[1:] |= fits
            near[:-1] |= fits
            keep = near & (np.add.reduceat(front.astype(np.int64), start) > 0)[run_of] | edge[run_of]
            cut = edge | (size > most)
            steps = np.where(cut, -(-size // most), 0)
            number = state["number"] + (np.cumsum(steps) - steps)[run_of] + (np.arange(len(token)) - start[run_of]) // most
            chunk = np.where(cut[run_of], base + number, -1)
            state["number"] += int(steps.sum())
            if keep.any():
                yield _batch(token=token[keep], chunk=chunk[keep], key=key[keep], n=n[keep])

        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now)]
            token = now[0]
            whole = int(np.searchsorted(token, token[-1])) if len(token) else 0
            if whole == 0 and len(token) > 16 * most:  # one run: let go of what fills whole chunks
                whole = len(token) // most * most - most
                yield from emit(*[c[:whole] for c in now], last=True)
                state["open"] = True
            else:
                yield from emit(*[c[:whole] for c in now], last=False)
            held = [c[whole:] for c in now]
        if held is not None:
            yield from emit(*held, last=True)

    ranged = entries.repartitionByRange("token", "n", "key").sortWithinPartitions("token", "n", "key")
    return ranged.select("token", "key", "n", "front").mapInArrow(run, "token long, chunk long, key long, n int")


def one_of_equal(kept: DataFrame) -> DataFrame:
    """Of whole blocks with the same members only one: the many shingles that close copies share say the same."""
    whole = kept.where("chunk < 0")
    members = whole.groupBy("token").agg(F.bit_xor(F.xxhash64("key")).alias("_all"), F.count(F.lit(1)).alias("_n"),
                                         F.min("key").alias("_least"), F.max("key").alias("_most"))
    first = members.groupBy("_all", "_n", "_least", "_most").agg(F.min("token").alias("token"))
    return whole.join(first.select("token"), "token", "left_semi").unionByName(kept.where("chunk >= 0"))


def units(kept: DataFrame, all_pairs: bool, percent: int) -> DataFrame:
    """Entries by unit of work: ``token``, ``left``, ``right``, ``side``, and the entry.

    A whole block is a unit. Of a block in chunks every pair of chunks is one whose sizes
    can match and which are not both inside the same component; without ``all_pairs`` only
    a chunk and the next one, so that the work is linear.
    """
    whole = kept.where("chunk < 0").select(F.col("chunk").alias("left"), F.col("chunk").alias("right"), F.lit(0).alias("side"), "*")
    nodes = kept.where("chunk >= 0").groupBy("token", "chunk").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    a, b = nodes.alias("a"), nodes.alias("b")
    fits = (F.col("a.chunk") <= F.col("b.chunk")) & (100 * F.col("a.hi") >= percent * F.col("b.lo")) & (
        100 * F.col("b.hi") >= percent * F.col("a.lo"))
    one = (F.col("a.c0") == F.col("a.c1")) & (F.col("b.c0") == F.col("b.c1")) & (F.col("a.c0") == F.col("b.c0"))
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).where(fits & ~one).select(
        "a.token", F.col("a.chunk").alias("left"), F.col("b.chunk").alias("right"))
    if not all_pairs:
        near = pairs.groupBy("token", "left").agg(F.sort_array(F.collect_set("right")).alias("right"))
        pairs = near.select("token", "left", F.explode(F.slice("right", 1, 2)).alias("right"))
    sides = pairs.select("token", "left", "right", F.explode(F.when(
        F.col("left") == F.col("right"), F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("chunk"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("chunk")),
                           F.struct(F.lit(1).alias("side"), F.col("right").alias("chunk"))))).alias("s"))
    sides = sides.select("token", "left", "right", "s.side", "s.chunk")
    parts = kept.where("chunk >= 0").join(sides, ["token", "chunk"])
    return whole.unionByName(parts.select(*whole.columns))


class Tree:
    """Signature tree over sets of one bitmap width, in the order given."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, component: np.ndarray, fan: int) -> None:
        self.bits, self.n, self.component = bits, n, component
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, n - self.ones, component, component)]
        width = bits.shape[1]
        self.fans = []
        fan = int(max(4, min(fan, ((1 << 19) / width) ** 0.5)))  # bounds the bitmaps compared at a time
        while len(self.levels[-1][0]) > 1 or not self.fans:
            orred, lo, hi, extra, c0, c1 = self.levels[-1]
            at = np.arange(0, len(orred), fan)
            self.fans.append(fan)
            self.levels.append((np.bitwise_or.reduceat(orred, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(extra, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def folded(self) -> Tree:
        """The same sets with bitmaps of half the width."""
        half = self.bits.shape[1] // 2
        return Tree(self.bits[:, :half] | self.bits[:, half:], self.n, self.component, self.fans[0])

    def children(self, level: int, node: int) -> range:
        fan = self.fans[level - 1]
        return range(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0])))


def possible(a: Tree, la: int, i, b: Tree, lb: int, j, percent: int) -> np.ndarray:
    """Which pairs of nodes (``i`` x ``j``) can hold a link between different components, by their maximum overlap."""
    ba, lo_a, hi_a, extra_a, c0_a, c1_a = (x[i] for x in a.levels[la])
    bb, lo_b, hi_b, extra_b, c0_b, c1_b = (x[j] for x in b.levels[lb])
    col = lambda x: x[:, None]
    fits = (100 * col(hi_a) >= percent * lo_b) & (100 * hi_b >= percent * col(lo_a))
    fits &= ~((col(c0_a) == c1_a[:, None]) & (c0_b == c1_b) & (col(c0_a) == c0_b))
    if fits.any():
        common = np.bitwise_count(col(ba) & bb[None]).sum(axis=2, dtype=np.int64)
        most = common + np.minimum(col(extra_a), extra_b)
        fits &= most >= least_overlap(col(lo_a), lo_b, percent)
    return fits


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets (row of ``a``, row of ``b``, largest possible overlap) that the bitmaps can't rule out.

    With ``a is b`` every pair comes once, the smaller row first.
    """
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, x, lb, y = stack.pop()
        down_a = la > 1 and la >= lb
        down_b = lb > 1 and lb >= la
        if down_a or down_b:
            i = np.array(a.children(la, x)) if down_a else np.array([x])
            j = np.array(b.children(lb, y)) if down_b else np.array([y])
            na, nb = la - down_a, lb - down_b
            fits = possible(a, na, i, b, nb, j, percent)
            for p, q in zip(*np.nonzero(fits)):
                if a is not b or i[p] <= j[q] or na != nb:
                    stack.append((na, int(i[p]), nb, int(j[q])))
            continue
        i, j = np.array(a.children(1, x)), np.array(b.children(1, y))
        fits = possible(a, 0, i, b, 0, j, percent)
        if a is b:
            fits &= i[:, None] < j
        p, q = np.nonzero(fits)
        if len(p):
            p, q = i[p], j[q]
            common = np.bitwise_count(a.bits[p] & b.bits[q]).sum(axis=1, dtype=np.int64)
            most = np.minimum(a.n[p] - a.ones[p], b.n[q] - b.ones[q]) + common
            yield p, q, most


def _forest(n: int, links) -> tuple[np.ndarray, np.ndarray]:
    """For each set the earlier one that it may overlap most, if there is one."""
    best, partner = np.zeros(n), np.full(n, -1)
    for p, q, score in links:
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        order = np.argsort(score, kind="stable")
        better = score[order] > best[hi[order]]
        at = order[better]
        best[hi[at]], partner[hi[at]] = score[at], lo[at]
    child = np.flatnonzero(partner >= 0)
    return child, partner[child]


def block_pairs(n, bits: list[bytes], component, side, params: JoinParams, all_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (rows) of one unit of work."""
    width = np.array([len(b) for b in bits])
    trees = {}
    for s in np.unique(side):
        for w in np.unique(width):
            rows = np.flatnonzero((width == w) & (side == s))
            if len(rows):
                matrix = np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), -1)
                trees[int(s), int(w)] = rows, Tree(matrix, n[rows], component[rows], params.leaf)
    two = len(np.unique(side)) == 2

    def found():
        for (s, w), (rows, tree) in trees.items():
            for (t, v), (other, second) in trees.items():
                if two and not (s == 0 and t == 1):
                    continue
                if not two and w > v:
                    continue
                if w == v:
                    first, second_ = tree, second
                elif w == 2 * v and two:
                    first, second_ = tree.folded(), second
                elif v == 2 * w:
                    first, second_ = tree, second.folded()
                else:
                    continue  # sizes differ by more than a factor of two
                for p, q, most in traverse(first, second_, params.percent):
                    p, q = rows[p], other[q]
                    yield p, q, most / (n[p] + n[q] - most)

    if not all_pairs:
        return _forest(len(n), found())
    got = [(p, q) for p, q, _ in found()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def candidates(kept: DataFrame, bits: DataFrame, all_pairs: bool, params: JoinParams) -> DataFrame:
    """Distinct pairs of sets (``a`` < ``b``) that the signature trees of the blocks can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            unit = [table[c].to_numpy() for c in ("token", "left", "right")]
            key, n, component, side = (table[c].to_numpy().astype(np.int64) for c in ("key", "n", "component", "side"))
            new = np.concatenate([[True], np.logical_or.reduce([u[1:] != u[:-1] for u in unit])])
            start = np.flatnonzero(new)
            raw = table["bits"].to_pylist()
            out = set()
            for s, e in zip(start, np.append(start[1:], len(key))):
                if e - s > 1 and not (component[s:e] == component[s]).all():
                    i, j = block_pairs(n[s:e], raw[s:e], component[s:e], side[s:e], params, all_pairs)
                    a, b = key[s:e][i], key[s:e][j]
                    out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
            rows = np.array(sorted(out), np.int64).reshape(-1, 2)
            return _batch(a=rows[:, 0].copy(), b=rows[:, 1].copy())

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            token, left, right = (held[c].to_numpy() for c in ("token", "left", "right"))
            same = (token == token[-1]) & (left == left[-1]) & (right == right[-1])
            whole = len(token) - int(same[::-1].argmin() if not same.all() else len(token))
            if whole:
                yield pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield pairs(held)

    work = units(kept, all_pairs, params.percent).join(bits, "key")
    work = work.select("token", "left", "right", "side", "key", "n", "component", "bits")
    ordered = work.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right", "side", "n", "key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def exact_sets(docs: DataFrame, named: DataFrame, keys: DataFrame, params: JoinParams) -> DataFrame:
    """``key`` and its exact ``shingles`` for the keys given, from one document of each."""
    one = named.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("_id"))
    texts = docs.select("doc_id", "text").join(one.select("_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part in _pages(batches):
            sets = [hasher.shingles(t, params.words) for t in part.column(0).to_pylist()]
            yield _batch(key=pa.array([set_key(s) for s in sets], pa.int64()), shingles=pa.array(sets, pa.list_(pa.int64())))

    return texts.select("text").mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact sets link."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b")
    common, total = F.size(F.array_intersect("_sa", "_sb")), F.size("_sa") + F.size("_sb")
    return both.where((100 + percent) * common >= percent * total).select("a", "b")


def _labelled(kept: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return kept.withColumn("component", F.col("key"))
    named = labels.select(F.col("node").alias("key"), F.col("component").alias("_label"))
    return kept.join(named, "key", "left").withColumn("component", F.coalesce("_label", "key")).drop("_label")


def similar_groups(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Documents link if their shingle sets overlap by ``percent`` of the union; a component is
    what links reach, named by its smallest ``doc_id``. NULL and empty texts have no
    shingles and link with nothing; a text of fewer words than a shingle is one shingle;
    equal texts always link. Rows that repeat an id are documents of the same name; those
    without an id link like any other but name no component; an empty table gives no rows. Shingles and sets are told apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketch(docs, params))
    named = sketched.where("n is not null").select("doc_id", "n", "key")
    entries = materialize(prefixes(docs, order_hints(sketched, params), params))
    kept = materialize(one_of_equal(materialize(blocks(entries.where("token is not null"), params))))
    bits = entries.where("bits is not null").select("key", "bits")
    bits = materialize(bits.join(kept.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))

    links, labels = None, None
    for all_pairs in (False, True):
        pairs = materialize(candidates(_labelled(kept, labels), bits, all_pairs, params))
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        new = materialize(verified(pairs, exact_sets(docs, named.where("n > 0"), keys, params), params.percent))
        links = new if links is None else links.unionByName(new)
        labels = materialize(connected_components(links, "a", "b"))

    first = named.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    first = first.join(labels.select(F.col("node").alias("key"), "component"), "key", "left")
    first = first.withColumn("component", F.coalesce("component", "key"))
    least = first.groupBy("component").agg(F.min("first").alias("component_id"))
    group = first.join(least, "component").select("key", "component_id")
    return named.join(group, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One document of each group of similar ones, and every row without a word.

    Each row has a key of its own, a number that is written once; of a group the row with the
    smallest ``doc_id`` stays, NULL last, and of rows with that id the one with the smallest
    number. So a row without an id is judged by its text like any other, and of rows that
    repeat an id those with one text, or similar ones, leave one.
    """
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = similar_groups(rows.select(F.col("_row").alias("doc_id"), "text"), params)
    groups = groups.withColumnsRenamed({"doc_id": "_row", "component_id": "_group"}).join(rows.select("_row", "doc_id"), "_row")
    first = groups.where("n_shingles > 0").groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"))
    stay = first.select("_first._row").unionByName(groups.where("n_shingles = 0").select("_row"))
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)
