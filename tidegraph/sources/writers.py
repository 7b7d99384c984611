"""Writers: edge lists as text, edges as Parquet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Graph


def write_edge_list(graph: Graph, path: str) -> None:
    """A folder of text files with ``u v`` (or ``u v w``) lines; the edge-list reader reads it back."""
    columns = ["src", "dst"] + (["weight"] if graph.weighted else [])
    graph.edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)


def write_parquet(graph: Graph, path: str) -> None:
    graph.edges.write.parquet(path)
