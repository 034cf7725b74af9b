"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each node of a large-star step sends its larger neighbours to its smallest one, each node of a small-star step its
smaller ones; the edges shrink to stars around the smallest node of every component, in a logarithmic number of rounds.
Every round is written to the shared folder, and the round before is deleted. Degrees may be as large as a component: the minimum is aggregated before
the shuffle and joined back, and the join's hot keys are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Returns the like."""
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("near"))
    if large:
        pairs = down.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
    else:
        pairs = down
    least = pairs.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
    joined = pairs.join(least, "node")
    if large:
        moved = joined.where("near > node").select(F.col("near").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("near").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return moved.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of longs: (node, root), root the smallest node of its component, for all nodes but the roots.
    The caller may `drop` it when it is of no more use."""
    edges = table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        last, edges = edges, table(_star(_star(edges, True), False), "links")
        drop(last)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots._work_path = edges._work_path
    return roots
