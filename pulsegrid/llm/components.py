"""Connected components of an edge table, by contraction.

Each round sends every node to the node next to it (or itself) whose hash is smallest, contracts the edges and drops
loops.  Nodes that are no local minimum vanish; as hashes are random to the shape of the graph, a fixed share of the
nodes goes in each round even on long sorted chains, so rounds are logarithmic.  The maps of all rounds are then
composed, last to first, and each component is named by its smallest node.  Every round is cut off by a saved table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), either way round, repeats and loops allowed -> (node, root), root being the smallest node reached.

    Nodes without an edge to another node are not listed.  An empty edge table gives an empty result.
    """
    edges = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(ranked("b")).alias("_m"))
        step = saved(nearest.select(F.col("a").alias("node"), F.least(ranked("a"), "_m")["v"].alias("to")))
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("_a")), step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").filter("_a <> _b")
        edges = saved(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].withColumnRenamed("to", "_top")
    for step in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("to"), "_top")
        out = saved(step.join(up, "to", "left").select("node", F.coalesce("_top", "to").alias("_top")))
    names = saved(out.groupBy("_top").agg(F.min("node").alias("root")))
    return out.join(names, "_top").select("node", "root")
