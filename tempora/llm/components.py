"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node that each linked node can reach.

    Nodes without links don't appear. Every table that is joined has been written before, so both sides of
    a join are plain exchanges and Spark can split a node with very many links."""
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(pair(links), "edges"), None
    if (mark := _mark(edges))[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        if mark == before:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(pair(large), "edges")
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = materialize(pair(small), "edges")
        before, mark = mark, _mark(edges)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
