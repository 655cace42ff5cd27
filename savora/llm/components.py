"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round hangs every node on the smallest node it can see; the rounds end when the edges are stars. A
round is a few joins and aggregates over the edges and is written to the shared folder, so a lost executor
costs one round at most, and no neighbourhood is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.session import stored

MOST_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _smallest(pairs: DataFrame) -> DataFrame:
    # Written, so that the join with it can split a node with very many neighbours.
    return stored(pairs.groupBy("a").agg(F.min("b").alias("m")), "star")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both)
    seen = both.where("b > a").join(least, "a")
    return seen.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _smallest(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, of every node that is not its own smallest.

    ``edges`` has two bigint columns; order, repetitions and loops do not matter.
    """
    a, b = edges.columns
    edges = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges"
    )
    before = _signature(edges)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        edges = stored(_small_star(stored(_large_star(edges), "edges")), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
