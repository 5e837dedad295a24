"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headwise.llm.common import cut


def _linked(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node links its larger (or its smaller) neighbours and itself to
    the smallest of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    met = both.join(least, "a")
    if large:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that can be
    reached. Alternates the two star steps until nothing moves; each round is written to the
    shared folder. Only a count reaches the driver. Hubs are joined, never collected."""
    def turned(e: DataFrame) -> DataFrame:  # larger node first
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")

    now = cut(turned(edges).distinct(), "edges")
    while True:
        next_ = cut(_linked(turned(_linked(now, large=True)), large=False), "edges")
        # A forest of stars is a fixed point: same rows as before.
        if next_.count() == now.count() and next_.exceptAll(now).isEmpty():
            break
        now = next_
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
