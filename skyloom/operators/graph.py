"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.plans.staging import is_empty, stage


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with the least ``m`` of its ``u``.

    The second key, which follows from the first, gives the join a shuffle of its own: in that of the
    aggregate, which it would share, adaptive execution can't split a hub with very many edges.
    """
    apart = F.pmod("u", F.lit(2)).alias("half")
    return edges.select("u", "v", apart).join(least.select("u", "m", apart), ["u", "half"]).drop("half")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them (edges hold u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its least node.

    Self-loops, repeated edges and either direction are allowed; edges with a null end are
    ignored. A node that only has a self-loop is its own component. No list of neighbours
    is ever gathered: each step is a partial minimum and an equi join, so a hub with very
    many neighbours only skews a join, which adaptive execution splits. The number of
    steps grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    pairs = stage(pairs, "edges")
    loops = pairs.where("u = v").select("u", "v")
    now = pairs.where("u > v")
    mark = None
    while not is_empty(now):
        now = stage(_small_star(_large_star(now)), "stars")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(centres).unionAll(loops.join(now, "u", "left_anti").select(F.col("u").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
