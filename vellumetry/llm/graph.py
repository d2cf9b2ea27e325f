"""Connected components by alternating large-star and small-star steps.

Each round rewrites the edge table and writes it to the shared storage, so
lineage stays short and a lost executor costs one round at most. The rows of
the round before tell in how many files. Nothing but two counters a round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import materialise

#: Edges that make a task and a file of their own, about.
EDGES = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        near = both
        hub = F.least("a", F.min("b"))
        keep = F.col("b") > F.col("a")
    else:
        near = both.where("b < a")
        hub = F.min("b")
        keep = F.lit(True)
    hubs = near.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("n"), (F.least("a", "least") if large else F.col("least")).alias("hub"))
    linked = near.where(keep).join(hubs, F.col("a") == F.col("n"))
    out = linked.select(F.col("hub").alias("a"), F.col("b"))
    if not large:
        out = out.union(hubs.select(F.col("hub").alias("a"), F.col("n").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type -> (node, component): the least node of each node's component.

    Loops and repeated edges are allowed; nodes without an edge to another don't appear.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    summary, n = None, edges.count()
    while True:
        after = materialise(_star(_star(edges, True), False).coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, n // EDGES)), "components")
        now = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        edges, n = after, now.n
        if now == summary:
            break
        summary = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a"), F.col("a"))).distinct()
