"""Approximate nearest neighbours over balanced posting lists.

Centroids are leaves of a balanced tree fitted on a bounded sample. Every vector goes to
the posting list of its nearest centroid, and boundary vectors also to further lists
whose centroid is nearly as near. Centroids are searched by a best-first walk over an
in-memory neighbour graph; a query reads the lists whose distance ratio to its nearest
one is small. Vectors of one direction are one entry, so a vector that a third of all rows
share costs no more than any other, and long lists are read in parts. Distances and scores
are computed in double precision throughout: single precision cannot rank near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwave.operators.ordered import materialize


@dataclass(frozen=True)
class IndexParams:
    """``sample`` distinct vectors at most fit the centroids, ``max_lists`` bounds their number.

    A vector is stored in up to ``replicas`` lists within ``closure`` times its distance to
    the nearest centroid; a query reads up to ``probes`` lists within ``reach`` times it, and
    the nearest ``least`` in any case.
    ``part`` rows of a list, and as many queries, are scored at once.
    """

    sample: int = 32_768
    list_size: int = 200
    max_lists: int = 1024
    degree: int = 24
    replicas: int = 8
    closure: float = 1.2
    probes: int = 64
    reach: float = 1.2
    least: int = 8
    part: int = 8192
    seed: int = 11


def balanced_leaves(points: np.ndarray, leaves: int, rng: np.random.RandomState) -> list[np.ndarray]:
    """Unit means of ``leaves`` groups of nearly equal size, by splits at the median of a two-means axis."""
    if leaves <= 1 or len(points) < 2:
        return [points.mean(axis=0)]
    a = points[rng.randint(len(points))]
    b = points[(points @ a).argmin()]
    left = leaves // 2
    at = len(points) * left // leaves
    for _ in range(6):
        order = np.argsort(points @ (a - b), kind="stable")
        b, a = points[order[:at]].mean(axis=0), points[order[at:]].mean(axis=0)
    order = np.argsort(points @ (a - b), kind="stable")
    return balanced_leaves(points[order[:at]], left, rng) + balanced_leaves(points[order[at:]], leaves - left, rng)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)  # no overflow in the squares
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


class Graph:
    """Centroids, and for each its nearest others; searched best-first."""

    def __init__(self, centroids: np.ndarray, degree: int) -> None:
        self.centroids = centroids
        sims = centroids @ centroids.T
        np.fill_diagonal(sims, -2)
        near = np.argsort(-sims, axis=1)[:, :degree]
        ring = (np.arange(len(centroids))[:, None] + 1) % len(centroids)  # keeps the graph connected
        self.near = np.concatenate([near, ring], axis=1)
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, 8).astype(int))

    def search(self, vectors: np.ndarray, k: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest centroids found for each unit vector, and their distances."""
        n, lists = len(vectors), len(self.centroids)
        k = min(k, lists)
        found = min(lists, k + 16)
        width = min(width, lists)
        rows = np.arange(n)[:, None]
        sims = np.full((n, lists), -2.0)
        open_ = np.full((n, lists), -2.0)  # similarity of those seen and not yet expanded
        first = np.broadcast_to(self.entries, (n, len(self.entries)))
        sims[rows, first] = open_[rows, first] = vectors @ self.centroids[self.entries].T
        while True:
            best = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            edge = -np.partition(-sims, found - 1, axis=1)[:, found - 1]
            live = open_[rows, best].max(axis=1) > np.maximum(edge, -1.5)
            if not live.any():
                break
            who = np.flatnonzero(live)
            open_[who[:, None], best[who]] = -2
            next_ = self.near[best[who]].reshape(len(who), -1)
            new = np.einsum("nd,nkd->nk", vectors[who], self.centroids[next_])
            fresh = sims[who[:, None], next_] <= -1.5
            open_[who[:, None], next_] = np.where(fresh, new, open_[who[:, None], next_])
            sims[who[:, None], next_] = new
        at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return at, np.sqrt(np.maximum(2 - 2 * sims[rows, at], 0))


def usable(vector: Column) -> Column:
    """No NULL or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def direction(vector: Column) -> Column:
    """The vector over its largest component: the same bits for v, 2v or 3v, and the same cosines."""
    largest = F.array_max(F.transform(vector, F.abs))
    return F.transform(F.transform(vector, lambda x: x / largest), lambda x: x + F.lit(0.0))  # no -0.0


def _key(vector: Column) -> Column:
    return F.concat_ws("-", F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.reverse(vector))))


def _matrix(batch, name: str = "embedding") -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(vectors: DataFrame, n: int, params: IndexParams) -> np.ndarray:
    """Centroids from a bounded hash sample of the distinct vectors (``sample`` rows reach the driver)."""
    keep = F.pmod(F.xxhash64("key", F.lit(params.seed)), F.lit(1 << 32)) < int((1 << 32) * min(1.0, params.sample / max(n, 1)))
    drawn = vectors.where(keep).orderBy(F.xxhash64("key"), "key").limit(params.sample).select("embedding").toArrow()
    if not drawn.num_rows:
        drawn = vectors.limit(1).select("embedding").toArrow()
    points = unit(_matrix(drawn))
    lists = max(1, min(params.max_lists, n // params.list_size, len(points) // 8))
    leaves = balanced_leaves(points, lists, np.random.RandomState(params.seed))
    return unit(np.array(leaves))


def _to_lists(rows: DataFrame, centroids: np.ndarray, most: int, ratio: float, least: int, params: IndexParams) -> DataFrame:
    """``rows`` once for each of the ``least`` nearest lists, and those within ``ratio`` of the nearest, numbered as ``list``."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(centroids, params.degree)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists, far = graph.search(unit(_matrix(part)), most)
                row, place = np.nonzero((far <= ratio * far[:, :1] + 1e-6) | (np.arange(far.shape[1]) < least))
                chosen = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(lists[row, place], pa.int32())],
                                                 names=[*part.schema.names, "list"])

    return rows.mapInArrow(run, f"{kind}, list int")


def _parts(rows: DataFrame, size: int, name: str) -> DataFrame:
    return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, params: IndexParams = IndexParams()) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``, by largest cosine.

    Both have ``vec_id`` and ``embedding``. Returns ``query_id``, ``rank`` from 1, ``vec_id``
    and ``score``, the cosine of the original vectors in double precision; equal scores rank
    by ``vec_id``. The row with the query's own id is left out; fewer candidates give fewer
    rows. Rows without an id, NULL or zero vectors, vectors with NULL or non-finite
    components, and vectors whose length is not the most frequent one take no part.
    Rows repeated with the same id count once. Empty tables give no rows.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    wanted = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = wanted.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows, wanted = rows.where(F.size("embedding") == usual["d"]), wanted.where(F.size("embedding") == usual["d"])

    rows, wanted = (df.withColumn("embedding", direction(F.col("embedding"))) for df in (rows, wanted))

    # Of vectors with one direction only the k + 1 smallest ids can be among k neighbours.
    same = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("_at", F.dense_rank().over(same)).where(F.col("_at") <= k + 1)
    first = first.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = materialize(first.select(_key(F.col("embedding")).alias("key"), "embedding", "ids"))
    asked = materialize(wanted.select("vec_id", _key(F.col("embedding")).alias("key"), "embedding"))
    centroids = fit(distinct, distinct.count(), params)
    postings = materialize(_to_lists(distinct, centroids, params.replicas, params.closure, 1, params))
    probes = asked.dropDuplicates(["key"]).select(F.col("key").alias("query"), "embedding")
    probes = materialize(_to_lists(probes, centroids, params.probes, params.reach, params.least, params))
    return _ranked(_scored(postings, probes, k, params), asked, k)


def _scored(postings: DataFrame, probes: DataFrame, k: int, params: IndexParams) -> DataFrame:
    """The k + 1 best of every part of a list for the queries that read it: ``query``, ``ids``, ``score``."""
    sizes = _parts(postings, params.part, "parts").join(_parts(probes, params.part, "blocks"), "list")
    left = postings.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
    right = probes.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")

    def score(entries: pa.Table, asked: pa.Table) -> pa.Table:
        if not entries.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int64())),
                             "score": pa.array([], pa.float64())})
        v, q = unit(_matrix(entries)), unit(_matrix(asked))
        least = pc.list_element(entries["ids"], 0).to_numpy()
        most, own = min(len(v), k + 1), []
        # A product of matrices may sum in any order; what it cannot tell apart is summed in one order below.
        unsure = 4 * (v.shape[1] + 8) * np.finfo(np.float64).eps
        for at in range(0, len(q), 256):
            sims = q[at:at + 256] @ v.T
            edge = -np.partition(-sims, most - 1, axis=1)[:, most - 1:most]
            row, near = np.nonzero(sims >= edge - unsure)
            step = max(1, (1 << 22) // v.shape[1])
            exact = np.concatenate([np.einsum("nd,nd->n", q[at + row[i:i + step]], v[near[i:i + step]]) for i in range(0, len(row), step)])
            order = np.lexsort((least[near], -exact, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)  # rows ascend, before and after sorting
            best = order[place < most]
            own.append((at + row[best], near[best], exact[best]))
        row, near, exact = (np.concatenate(o) for o in zip(*own))
        return pa.table({"query": asked["query"].take(pa.array(row)), "ids": entries["ids"].take(pa.array(near)), "score": pa.array(exact)})

    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        score, "query string, ids array<long>, score double")


def _ranked(scored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Neighbours of each query from the best of its lists."""
    found = scored.select("query", F.explode("ids").alias("near"), "score")
    found = found.groupBy("query", "near").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    found = found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k + 1)
    answers = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_at", "near", "score"))).alias("best"))
    rows = asked.select("vec_id", "key").distinct().join(answers, asked["key"] == answers["query"])
    others = F.slice(F.filter("best", lambda b: b["near"] != F.col("vec_id")), 1, k)
    rows = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_place", "_hit"))
    return rows.select("query_id", (F.col("_place") + 1).alias("rank"), F.col("_hit.near").alias("vec_id"),
                       F.col("_hit.score").alias("score"))
