"""Connected components of an edge list by alternating star contraction.

Each round links every node to the smallest node around it (first from the side of the larger nodes, then from the
smaller), so components collapse to stars in a number of rounds that grows with the logarithm of their diameter.
Every round is one aggregation that combines map-side and one join; its result is written to the shared checkpoint
folder, which cuts the lineage. The edges of a hub never meet in one task: a node with more than one in ``HEAVY`` of
all edges gets its smallest neighbour from a broadcast of such nodes, and there are at most ``HEAVY`` of them.
Nothing but a row count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import HEAVY, cut


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Edges (a, b) with a > b, turned so that the neighbours of each node point at the smallest of them.

    ``total`` is at least the number of edges.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    around = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
    least = around.select("a", F.least("a", "low").alias("low"), "degree")
    hubs = least.where(F.col("degree") * HEAVY > (2 * total if large else total)).select("a", F.col("low").alias("hub_low"))
    kept = both.where(F.col("b") > F.col("a")) if large else both
    # An edge of a hub already has its answer and may go anywhere in the next join: its other end spreads it.
    moved = (
        kept.join(F.broadcast(hubs), "a", "left")
        .withColumn("key", F.when(F.col("hub_low").isNull(), F.col("a")).otherwise(F.col("b")))
        .join(least.select(F.col("a").alias("key"), "low"), "key", "left")
        .select(F.col("b").alias("x"), F.coalesce("hub_low", "low").alias("y"))
    )
    if not large:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), F.col("low").alias("y")))
    return moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node."""
    now = cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    state, total = None, now.count()
    for _ in range(max_rounds):
        now = cut(_star(_star(now, True, total), False, total))
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if after == state:
            break
        state, total = after, after[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
