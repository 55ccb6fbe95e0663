"""Connected components of a graph whose edges and nodes stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); nodes are joined if their roots are equal.

    Each round gives every node a random rank, contracts it into its lowest-ranked
    neighbour (or itself) and keeps the edges between different results, so a constant
    share of the nodes goes in a round whatever the shape: chains and stars alike. Only
    whether edges are left comes to the driver. A round is a written table, so a lost
    executor costs a part of one round.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "cc_edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = len(maps)

        def rank(c: str, salt: int = salt) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), F.col(c)), F.col(c).alias("at"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("low"))
        step = best.select("a", F.least(F.col("low"), rank("a"))["at"].alias("to"))
        step = stage(step, f"cc_map_{salt}")
        maps.append(step)
        left = step.select("a", F.col("to").alias("_a"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").where("_a <> _b")
        edges = moved.select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
        ).distinct()
        edges = stage(edges, f"cc_edges_{salt}")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = step.join(later, F.col("to") == F.col("_n"), "left").select(
            F.col("a").alias("node"), F.coalesce("_r", "to").alias("root")
        )
    return found
