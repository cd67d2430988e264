"""Connected components by contraction, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripwave.operators.ordered import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of an edge.

    Each round points every node at its smallest neighbour, doubles the pointers twice, and
    replaces the edges by those between the nodes pointed at; the number of rounds grows
    with the logarithm of the longest path. Nothing but emptiness is asked by the driver.
    Edges with a NULL end are ignored; loops make their node a component of its own.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ends = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    current, rounds = materialize(ends.where("u < v")), []
    while not current.isEmpty():
        both = current.union(current.select("v", "u"))
        nearest = both.groupBy("u").agg(F.min("v").alias("v"))
        to = materialize(nearest.select(F.col("u").alias("node"), F.least("u", "v").alias("to")))
        for _ in range(2):
            to = to.alias("p").join(to.select(F.col("node").alias("mid"), F.col("to").alias("end")),
                                    F.col("p.to") == F.col("mid")).select("node", F.col("end").alias("to"))
        to = materialize(to.where("node != to"))
        rounds.append(to)
        for end in ("u", "v"):
            step = to.select(F.col("node").alias(end), F.col("to").alias("_to"))
            current = current.join(step, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        current = current.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        current = materialize(current.where("u < v").distinct())
    labels = nodes.withColumn("component", F.col("node"))
    for to in rounds:
        step = to.select(F.col("node").alias("component"), F.col("to").alias("_to"))
        labels = labels.join(step, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return labels
