"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    mix = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mix).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return linked.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for linked nodes.

    ``links`` has two columns of one orderable type; nulls and loops are left out.
    Each round is written to the shared folder, so a lost executor repeats one
    round at most; the number of rounds grows with the logarithm of the longest
    chain. A node with very many links is only ever aggregated and joined.
    """
    edges = links.toDF("a", "b").where("a <> b").distinct()
    edges = materialize(edges)
    state = _state(edges)
    while state[0]:
        old, edges = edges, materialize(_small_star(_large_star(edges)))
        discard(old.written_path)
        before, state = state, _state(edges)
        if before == state:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("b", "b").distinct()).toDF("node", "root")
