"""Synthetic graphs: seeded by row, so the same graph whatever the partitioning. Always symmetric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, normalize


def _uniform(seed: int, *key) -> Column:
    """In [0, 1), from the row's number."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") / float(1 << 52)


def uniform(spark: SparkSession, scale: int, degree: int = 16, seed: int = 20240611) -> Graph:
    """2**scale vertices, degree * 2**scale undirected edges with uniform ends."""
    n = 1 << scale
    rows = spark.range(n * degree)
    edges = rows.select(*[F.floor(_uniform(seed + i, F.col("id")) * n).cast("long").alias(c) for i, c in enumerate(("src", "dst"))])
    return Graph(normalize(edges, True), n, True)


def rmat(spark: SparkSession, scale: int, degree: int = 16, seed: int = 20240611) -> Graph:
    """Recursive matrix (Kronecker) graph with the fixed quadrant shares .57, .19, .19, .05."""
    n = 1 << scale
    src = dst = F.lit(0).cast("long")
    for level in range(scale):
        u = _uniform(seed + level, F.col("id"))
        down = (u >= 0.76).cast("long")
        right = (((u >= 0.57) & (u < 0.76)) | (u >= 0.95)).cast("long")
        src, dst = src * 2 + down, dst * 2 + right
    return Graph(normalize(spark.range(n * degree).select(src.alias("src"), dst.alias("dst")), True), n, True)


def random_weights(edges: DataFrame, top: int = 255) -> DataFrame:
    """Weights 1 .. top from the ends alone: both directions of an edge get the same."""
    return edges.select("src", "dst", (F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(top)) + 1).cast("int").alias("weight"))
