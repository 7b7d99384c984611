"""Connected components of a link table, distributed, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``links(a, b)``; component is the smallest id reachable.

    Each round hooks every node's larger neighbours, then its smaller ones, to the smallest member of its
    neighbourhood. Nodes and links stay distributed; both aggregations combine before the shuffle, so a
    node with very many links costs a task no more than its distinct partial minima. Nulls take no part.
    """
    links = materialize(links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "links")
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        both = links.unionByName(links.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v")
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v u", "m v").where("u <> v").unionByName(least.selectExpr("u", "m v"))
        small = small.selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
        after = materialize(small, "links")
        # converged when the links form stars: no centre is itself hooked, and no node has two centres
        again = after.select("u", "v").join(after.selectExpr("u v"), "v", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty()
        discard(links)
        links = after
        if again:
            break
    else:
        raise RuntimeError("components did not converge")
    return links.selectExpr("u id", "v component").unionByName(links.selectExpr("v id", "v component").distinct())
