"""Connected components as DataFrame rounds (alternating large-star and small-star).

Every round is two group-bys and joins; nothing but two sums per round reaches the driver.
Each round's edges are written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str, dst: str, rows: int | None = None) -> DataFrame:
    """(node, component) of every node of ``edges``; component is the least node that it reaches.

    Direction, repeats, self links and nulls in ``edges`` don't matter; nodes may be of any
    orderable type.  A node that has only self links is left out.  ``rows`` may bound the edges.
    """
    now = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    now = materialize(now, rows)
    before = None
    while (state := _state(now)) != before and state[0]:  # the rounds are known to end; their number grows with log(nodes) squared at most
        before = state
        now = materialize(_small_star(_large_star(now)), state[0])
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
