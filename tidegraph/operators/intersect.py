"""Neighbour intersections. All named strategies are one relational plan with equal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def intersection_size(a: Column, b: Column, bound: Column | int | None = None) -> Column:
    """Common elements of two arrays of distinct ids, none above ``bound``."""
    both = F.array_intersect(a, b)
    return F.size(both if bound is None else F.filter(both, lambda x: x <= bound))


def intersect_neighbours(graph: Graph, u: int, v: int, bound: int | None = None) -> int:
    one = graph.edges.where(F.col("src") == u).select("dst")
    two = graph.edges.where(F.col("src") == v).select("dst")
    both = one.distinct().join(two, "dst", "left_semi")
    return (both if bound is None else both.where(F.col("dst") <= bound)).count()


def common_neighbours(graph: Graph, pairs: DataFrame, bounded: bool = True) -> DataFrame:
    """(src, dst, common) for each pair that has common out-neighbours (none above dst, if bounded).

    Joins edges with edges instead of building neighbour arrays, so a hub's list never sits in one row.
    """
    e = graph.edges.select("src", "dst")
    one = pairs.select("src", "dst").join(e.select("src", F.col("dst").alias("x")), "src")
    if bounded:
        one = one.where(F.col("x") <= F.col("dst"))
    two = e.select(F.col("src").alias("dst"), F.col("dst").alias("x"))
    return one.join(two, ["dst", "x"], "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("common"))
