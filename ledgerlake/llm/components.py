"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import discard, stored


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node the smallest of its neighbours and itself."""
    return edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of the edges (a, b).

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to the
    smallest one, then so is every smaller neighbour. Each step is a grouping and a join on nodes;
    the edges are stored after each round, and their number never grows.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") > F.col("b"))
        .distinct(),
        "components",
    )
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_nearest(both), "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .distinct()
        )
        least = _nearest(large)
        small = (
            large.join(least, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
                        F.struct(F.col("a"), F.col("least").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.a", "e.b")
            .where(F.col("a") > F.col("b"))
            .distinct()
        )
        before, links = links, stored(small, "components")
        discard(before)
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")
        ).first()
        if now == seen:
            break
        seen = now
    # every edge now leads from a node to the smallest one of its component
    root = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        root.select("node", F.col("node").alias("component"))
    )
