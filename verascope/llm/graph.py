"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verascope.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node move to the least node around it; small star: those below do."""
    around = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; edges: u, v of one ordered type; component: its least node.

    Self-loops, repeated and mirrored edges change nothing; nodes on no edge are not returned; rows with a
    null end are ignored. Each round is written to the shared folder, so lineage stays short; rounds grow with
    the logarithm of the longest chain.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if not seen[0] or seen == before:
            break
        before = seen
        now = written(_star(_star(now, True), False), "edges")
    stars = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
