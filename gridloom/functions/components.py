"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import stored


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of the undirected graph with ``links`` (``a`` long, ``b`` long).

    Returns ``node``, ``component`` (the smallest node reachable) for every node that has a link to another; an
    empty table gives an empty one, self links and repeats change nothing. Alternates two star steps (each node's
    larger, then smaller neighbours are hung under the smallest neighbour), every step is two keyed
    shuffles, and every round is written to the shared folder, so neither plan nor lineage grows.
    Raises RuntimeError when ``max_rounds`` do not suffice, rather than return half-joined components.
    """
    edges = stored(_oriented(links), "links")
    before = None
    for _ in range(max_rounds):
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == after:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge is (a, b) with b < a here, so a's smaller neighbours are its rows
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    hung = edges.join(least, F.col("a") == F.col("k")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
