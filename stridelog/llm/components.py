"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over distinct edges (u > v): every node's neighbours are hung under the least of them and the node itself."""
    if large:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a2"), F.least("m", "a").alias("m"))
    hung = both.join(least, F.col("a") == F.col("a2"))
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select(F.col("a2").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root: the least node of the component of every node that has an edge. ``edges``: u, v of one orderable type.

    Neighbour lists are never gathered: each step is a minimum by key and a join whose hot keys the
    adaptive join splits. Every round is stored, so a lost executor costs one round. Raises if it has not settled.
    """
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    stamp = None
    for _ in range(most_rounds):
        edges = materialize(_star(_star(edges, True), False), "stars")
        got = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if got == stamp:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        stamp = got
    raise RuntimeError("components did not settle")
