"""Connected components of a graph held in DataFrames, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them (edges lead from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each component is a star already: a node with a link to a smaller one has no other link, and none to itself."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b), once each; component is the least node reachable. Each round is
    written to the shared folder; the driver only learns whether one more is needed."""
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _settled(now):
        after = scratch.keep(_small_star(_large_star(now)), "star")
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(scratch: Scratch, found: DataFrame, more: DataFrame) -> DataFrame:
    """found, the result of components, after more edges (a, b): only whole components are linked anew, not their nodes."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(scratch, between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti")
    nodes = found.unionByName(new.select("node", F.col("node").alias("component")))
    return scratch.keep(nodes.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "components")
