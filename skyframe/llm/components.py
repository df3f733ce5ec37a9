"""Connected components by alternating large-star and small-star steps.

A large-star step points every greater neighbour of a node to the least node around it; a small-star step does so for
the neighbours that are not greater. Both keep components as they are, and together they end in stars whose centre is
the least node of each component, after about log(n) rounds. Each step is a partial aggregate and a join on the node, so
a node with very many neighbours is spread over tasks, and every round is written to the shared folder. Rounds end as
soon as the edges are stars, which one aggregate by node shows. No join is a broadcast: the driver holds no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import big_side, drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(big_side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(big_side(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) are stars around v: no centre has a centre, no other node has two."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return nodes.where(F.col("out") + F.col("centre") > 1).isEmpty()


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge that isn't the least of its component, in a stored table.

    The first round reads ``edges`` several times, so they should be stored tables; repeated edges do no harm. Edges of
    an earlier result may be among ``edges`` in place of what they came from, so that new edges cost few rounds.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for n in range(max_rounds):
        after = stored(_small_star(_large_star(now)), "edges")
        if n:
            drop_stored(edges.sparkSession, now)
        now = after
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` has two long columns u and v.

    The component is its least node. Loops and repeated edges do no harm; null ends are left out; without edges the
    result is empty.
    """
    found = stars(edges, max_rounds)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
