"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.sources.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) of the nodes of edges (src, dst: undirected; loops and repeats are allowed).

    In a round a node's larger neighbours go to its smallest one, and then
    its smaller ones too, so the number of rounds grows with the logarithm of
    the longest path; no more rows than edges exist at any time.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        own = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
        least = own.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        moved = own.join(least, "a").where("b > a" if larger else "b > least")
        hub = least.where("least < a").select("a", F.col("least").alias("b"))
        return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(hub).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    at = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    at = stored(at, "components")
    before = state(at)
    while True:
        at = stored(star(star(at, True), False), "components")
        after = state(at)
        if after == before:
            break
        before = after
    return at.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
