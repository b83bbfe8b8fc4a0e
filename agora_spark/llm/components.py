"""Connected components of a graph given as a table of edges: distributed union-find.

Each round hooks every node to its smallest neighbour, follows the pointers to their roots by doubling
(pointer jumping), and contracts the edges to the roots. Rounds shrink the graph at least by half, the
jumps of a round are logarithmic in its longest chain. Every step is a join or a grouped minimum, and
is written to the shared folder, so a lost executor costs a reread. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import materialize, release


def _rooted(pointers: DataFrame) -> DataFrame:
    """Pointers (node, to) followed to their roots; roots point to themselves."""
    while True:
        p, q = pointers.alias("p"), pointers.select(F.col("node").alias("via"), F.col("to").alias("further")).where("via <> further")
        jumped = materialize(p.join(q, F.col("p.to") == F.col("via"), "left").select("p.node", F.coalesce("further", "p.to").alias("to"), F.col("further").isNotNull().alias("moved")), "jump")
        moving = not jumped.where("moved").isEmpty()
        release(pointers)
        out = jumped.select("node", "to")
        out._agora_path = jumped._agora_path
        if not moving:
            return out
        pointers = out


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long): component is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are left out. No edges give no rows.
    """
    edges = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
        pointers = _rooted(materialize(ends.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("to")), "hook"))
        if labels is None:
            labels = pointers
        else:
            after = labels.alias("l").join(pointers.select(F.col("node").alias("was"), F.col("to").alias("now")), F.col("l.to") == F.col("was"), "left")
            fresh = materialize(after.select("l.node", F.coalesce("now", "l.to").alias("to")), "labels")
            release(labels)
            labels = fresh
        a, b = (pointers.select(F.col("node").alias(f"n{x}"), F.col("to").alias(f"r{x}")) for x in "ab")
        left = edges.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb")).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        fewer = materialize(left, "edges")
        release(edges)
        if pointers is not labels:
            release(pointers)
        edges = fewer
        if edges.isEmpty():
            release(edges)
            out = labels.select("node", F.col("to").alias("component"))
            out._agora_path = labels._agora_path
            return out
