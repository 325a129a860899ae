"""Connected components of an edge table by alternating star contractions, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) -> (node, component): component is the smallest node reachable.  Nodes without edges do not occur.

    A large star ties a node's larger neighbours to its smallest one, a small star ties its smaller ones to it; the
    alternation ends when every edge leads to its component's smallest node, after a logarithmic number of rounds.
    """
    e = scratch.table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, turn = None, 0
    while True:
        turn += 1
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written before they are joined, so that Spark can split the edges of a node that has very many
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{turn}m")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"{name}-{turn}l")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}s")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{turn}m")
        scratch.drop(f"{name}-{turn}l")
        scratch.drop(f"{name}-{turn}s")
        scratch.drop(f"{name}-{turn - 1}")
        e = new
        if state == before or state[0] == 0:
            break
        before = state
    # now each node has one edge, to its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
