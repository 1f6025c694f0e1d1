"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b).

    Each round hangs a node's larger neighbours, then its smaller ones, on its least neighbour; the
    links that are left in the end are stars. Rounds grow with the logarithm of the nodes.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    while (now := state(edges)) != was:
        was = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        edges = materialise(large.join(low, "a").select(pairs).where("a <> b").distinct(), "edges")
    hung = edges.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(hung, nodes["node"] == hung["a"], "left").select("node", F.coalesce("component", "node").alias("component"))
