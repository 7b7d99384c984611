"""Primitives that extern code builds on: edge map and reduce, filters with counts, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .edges import EdgeSet, Update


def edge_map_reduce(graph: Graph, state: DataFrame, value: Callable[..., Column], op: str = "sum", frontier: DataFrame | None = None) -> DataFrame:
    """(id, value): values of the edges reduced by destination."""
    edges = EdgeSet(graph) if frontier is None else EdgeSet(graph).from_(frontier)
    return edges.messages(state, [Update("_", value, op)]).withColumnRenamed("_m0", "value")


def edge_map_count(graph: Graph, frontier: DataFrame | None = None) -> DataFrame:
    """(id, value): edges that reach each destination."""
    edges = graph.edges if frontier is None else graph.edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("value"))


def edge_map_induced(graph: Graph, vertices: DataFrame) -> Graph:
    """The edges whose source is in the set."""
    return Graph(graph.edges.join(vertices.select(F.col("id").alias("src")).distinct(), "src", "left_semi"), graph.n)


def edge_map_filter(graph: Graph, vertices: DataFrame, keep: Callable[..., Column], state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, count) of the kept out-edges of each vertex of the set, the kept edges themselves, for packing)."""
    edges, (hit,) = EdgeSet(graph).from_(vertices).rows(state, keep)
    kept = edges.where(hit).select(graph.edges.columns)
    counts = kept.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    every = vertices.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return every, kept


def histogram(values: DataFrame, key: str) -> DataFrame:
    return values.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
