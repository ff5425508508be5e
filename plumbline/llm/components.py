"""Connected components by alternating large-star and small-star steps.

Cases: links from a node to itself and repeated links change nothing; without links the result is empty.  Nodes must not be null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import BROADCAST_ROWS, pin

ROUNDS = 60
#: A written frame is read by one task for so many of its rows, and by at least so many tasks.
ROWS_A_TASK, LEAST_TASKS = 50_000, 8


def tasks_for(rows: int) -> int:
    return max(LEAST_TASKS, math.ceil(rows / ROWS_A_TASK))


def compact(pinned: DataFrame, rows: int | None = None) -> DataFrame:
    """A written frame, read by as many tasks as its counted rows need: the next exchange then leaves a file for each of these, not for
    each partition of the last one.  A frame whose partitions are full stays as it is."""
    tasks = tasks_for(pinned.count() if rows is None else rows)
    return pinned.coalesce(tasks) if tasks < pinned.rdd.getNumPartitions() else pinned


def _least(rows: DataFrame, few: bool) -> DataFrame:
    """Smallest ``v`` of each ``u``, combined before the shuffle.  Its join with the rows of a hub is a broadcast where the links were
    counted few; else it is written first, so that the join is a plain shuffle join that adaptive execution can split."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(low) if few else pin(low)


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node ties its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both, few)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down, few)
    tied = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; the component is its smallest node.

    The edge lists stay distributed and are checkpointed each round; the driver sees two numbers a round.  A
    node of many links is one key of a grouped minimum (combined before the shuffle) and of a join that adaptive
    execution may split.
    """
    edges = pin(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = edges.count()
    few = n <= BROADCAST_ROWS // 4  # a step makes at most one row more for each node, and a link has two
    edges, before = compact(edges, n), None
    for _ in range(rounds):
        tied = _large_star(edges, few)
        tied = tied.coalesce(tasks_for(n)) if few else pin(tied)
        tied = _small_star(tied, few)
        edges = pin(tied.coalesce(tasks_for(n)) if few else tied)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
