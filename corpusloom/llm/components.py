"""Connected components of a graph whose edges are rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._text import checkpointed


#: Edges whose nodes' smallest neighbours (16 bytes each, two nodes an edge at most) are broadcast.
MOST_BROADCAST = 100_000
EDGES_A_TASK = 50_000


def _unsettled(edges: DataFrame) -> int:
    """Nodes of ``edges`` that keep them from being stars: those with two edges down, or with edges both up and down."""
    down, up = (F.sum(F.col(c)) for c in ("down", "up"))
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(down.alias("down"), up.alias("up")).where("down > 1 or (down = 1 and up > 0)").count()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint) but the roots; root is the smallest node it reaches.

    Each round joins every node with its smallest neighbour; a hot node is an ordinary skewed join,
    which Spark splits, and of few edges, which are counted, the neighbours are broadcast. Rounds end when only
    stars are left, after about the logarithm of the longest path. Null ends and loops are left out. An edge
    table without rows gives none.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    now = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    many = now.count()
    few = F.broadcast if many <= MOST_BROADCAST else lambda df: df
    tasks = -(-many // EDGES_A_TASK) or 1
    now = now.coalesce(tasks)
    for _ in range(rounds):
        if not _unsettled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(few(least), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(few(floor), "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        now = checkpointed(small.distinct().coalesce(tasks))
    raise RuntimeError(f"no fixed point after {rounds} rounds")
