"""Connected components of an edge table, by stars that grow and collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component: the smallest node reachable, for each node of edges (a, b: long, undirected, no nulls; loops and repeats are allowed).

    Alternating large and small stars: every round is two aggregations by
    node and two joins, the number of rounds grows with the logarithm of the
    longest path, and no more rows than edges exist at any time. A round is
    written to the shared folder, so neither lineage nor driver grows.
    """
    at = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # large star: a node's larger neighbours, and it, go to its smallest neighbour
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.where("least < a").select("a", F.col("least").alias("b")))
            .distinct()
        )
        # small star: a node's smaller neighbours, and it, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b")))
            .distinct()
        )
        new = stored(small, name)
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() == at.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        at = new
        if same:
            break
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
