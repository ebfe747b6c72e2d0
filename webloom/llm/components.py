"""Connected components by contraction: tables only, nothing on the driver but one yes or no per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.runtime import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Each round sends every node to the neighbour that comes first in a random order and redraws the
    edges between the targets. The random order makes the rounds logarithmic also on sorted paths;
    a node with very many neighbours is one row per neighbour, summed before the shuffle.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    names = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("n")).select("a", F.least(rank("a"), F.col("n"))["to"].alias("to"))
        first = cut(first)
        left, right = first.withColumnsRenamed({"to": "x"}), first.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        moved = first.select(F.col("a").alias("node"), "to")
        if names is None:
            names = moved
        else:
            next_name = moved.select(F.col("node").alias("to"), F.col("to").alias("next"))
            names = cut(names.join(next_name, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = names.groupBy("to").agg(F.min("node").alias("component"))
    return cut(names.join(smallest, "to").select("node", "component"))
