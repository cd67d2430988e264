"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At every level each child draws ``-ln(u) / weight`` from the row's key and its own
name, and the smallest draw wins, so a child gets rows in proportion to its weight.
A draw depends on nothing but key, child and weight. If weights change inside a
subtree, only rows that enter or leave children with a changed weight move.
``grown`` adds a shard as a region of its own: no other weight changes at the root,
so the new shard takes rows only into itself, however often the tree grows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwave.llm.text import hash_key
from tripwave.operators.ordered import CHUNK, range_chunks

#: Hex digits of a draw: 52 bits, exact in a double.
DIGITS = 13


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack: ``{region: {rack: {shard: weight}}}``."""

    regions: Mapping[str, Mapping[str, Mapping[int, float]]]

    def __post_init__(self) -> None:
        shards = [s for racks in self.regions.values() for shards in racks.values() for s in shards]
        weights = [w for racks in self.regions.values() for shards in racks.values() for w in shards.values()]
        racks = [r for racks in self.regions.values() for r in racks]
        if not shards or len(set(racks)) != len(racks) or len(set(shards)) != len(shards) or min(weights) < 0 or sum(weights) <= 0:
            raise ValueError("a tree needs distinct racks and shards, weights of 0 or more, and a positive one")

    @staticmethod
    def even(shards: int, racks: int = 2, per_rack: int = 2) -> Tree:
        """Equal weights, ``racks`` racks of ``per_rack`` shards in each region."""
        out: dict[str, dict[str, dict[int, float]]] = {}
        for s in range(shards):
            rack = s // per_rack
            out.setdefault(f"g{rack // racks}", {}).setdefault(f"r{rack}", {})[s] = 1.0
        return Tree(out)

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        return Tree({**self.regions, f"new{shard}": {f"new{shard}": {shard: weight}}})


def _children(level: str, weights: Mapping[object, float]) -> Column:
    """Children with a weight, as an array of (name, weight)."""
    return F.array(*[F.struct(F.lit(str(c)).alias("name"), F.lit(f"{level} {c}").alias("drawn"), F.lit(float(w)).alias("weight"))
                     for c, w in weights.items() if w > 0])


def _choose(key: Column, children: Column) -> Column:
    """Name of the child with the smallest draw."""

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child["drawn"])), 1, DIGITS), 16, 10).cast("double")
        return -F.ln((bits + F.lit(0.5)) / F.lit(float(16**DIGITS))) / child["weight"]

    return F.array_min(F.transform(children, lambda c: F.struct(draw(c).alias("draw"), c["name"].alias("name"))))["name"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of each key, found by descending region, rack and shard."""

    def total(node) -> float:
        return sum(map(total, node.values())) if isinstance(node, Mapping) else float(node)

    def level(name: str, parents: Mapping[str, Mapping]) -> Column:
        pairs = [(F.lit(p), _children(name, {c: total(node) for c, node in of.items()})) for p, of in parents.items()
                 if total(of) > 0]
        return F.create_map(*[c for pair in pairs for c in pair])

    racks = {r: shards for of in tree.regions.values() for r, shards in of.items()}
    region = _choose(key, _children("region", {r: total(of) for r, of in tree.regions.items()}))
    rack = _choose(key, level("rack", tree.regions)[region])
    return _choose(key, level("shard", racks)[rack]).cast("int")


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", more: Mapping[str, Column] | None = None) -> DataFrame:
    """Each row's ``key``, the columns in ``more``, its ``shard``, and its ``slot`` there.

    Slots count 0, 1, 2, ... in a shard by the order of the key. They come from range
    partitions and one count per shard and partition: no task holds a shard.

    A NULL key is a key like others; rows with equal keys share a shard and get their
    slots in any order; an empty table gives no rows. Only ``key`` decides on the shard.
    """
    rows = docs.select(F.col(key).alias("key"), *[c.alias(n) for n, c in (more or {}).items()])
    rows = rows.withColumn("shard", shard_of(hash_key(F.col("key")), tree))
    rows = range_chunks(rows, ["shard", "key"])
    before = Window.partitionBy("shard").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("shard", CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("shard", CHUNK).orderBy("key"))
    done = rows.withColumn("_at", at).join(offsets, ["shard", CHUNK])
    return done.select(F.col("key").alias(key), *(more or {}), "shard",
                       (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents on ``shards`` equal shards, and where they go with one shard more.

    ``size`` is the UTF-8 length of the text plus 1, ``text_crc32`` its unsigned checksum;
    NULL text counts as empty.
    """
    tree = Tree.even(shards)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return assign(docs, tree, "doc_id", {
        "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text).cast("long"), "law": F.lit("key"),
        "grown_shard": shard_of(hash_key(F.col("doc_id")), tree.grown(shards)),
    })
