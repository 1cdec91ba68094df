"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a groupBy and a join on the table of edges, so neither the links nor the labels of all nodes are ever in
one place; a node with very many neighbours is one side of a sort-merge join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours (the larger ones, or the smaller ones and itself) to the smallest of them all."""
    if large:
        sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    linked = sides.join(least, F.col("u") == F.col("c"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) to (node, root): the smallest node of its component for each node that has an edge.

    Rows with a null end are ignored; loops and repeated or reversed edges don't matter.
    """
    state = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))]
    now = staged(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        new = staged(_star(_star(now, True), False), "edges")
        done = new.agg(*state).first() == now.agg(*state).first()
        drop_staged(now)
        now = new
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
