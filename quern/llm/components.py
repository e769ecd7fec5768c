"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the edge list; nothing is collected.
A hub node is a skewed join key whose other side is one row, which adaptive execution
splits.  Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.workspace import Workspace


def _star(edges: DataFrame) -> DataFrame:
    """Small-star: join all smaller neighbours of a node, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Large-star: join all larger neighbours of a node to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``; component is the smallest id reachable.

    Loops and repeated edges are allowed, an empty list gives an empty result.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = ws.save(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen, turn = tuple(state), turn + 1
        nxt = ws.save(_star(_large(now).distinct()).distinct(), f"{name}-{turn}")
        ws.drop(f"{name}-{turn - 1}")
        now = nxt
    every = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return every.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
