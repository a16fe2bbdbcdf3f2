"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node in links (a, b).

    Alternates large-star and small-star steps: each hangs neighbours on the smallest node in reach,
    and the number of rounds grows with the logarithm of a component's size. Nodes of any degree are
    handled: minima are partial sums, and the join back to the links is one that Spark can split.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        # Large star: of a node's larger neighbours, each goes to the smallest in reach of the node.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = written(both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct())
        # Small star: a node and its smaller neighbours go to the smallest of these.
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = written(small.unionByName(small_least.select(F.col("m").alias("a"), "b")).distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    # Every edge now leads from the root of a component.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
