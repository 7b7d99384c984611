"""Vertex sets, vertex state and vector operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_vertex_set(spark: SparkSession, size: int, n: int) -> DataFrame:
    """An empty (0) or full (n) vertex set; other sizes have no members to speak of and are rejected."""
    if size not in (0, n):
        raise ValueError("a new vertex set is empty or full")
    return spark.range(size)


def add_vertex(vertices: DataFrame, v: int) -> DataFrame:
    """Appends; repeats are kept and count."""
    return vertices.unionAll(vertices.sparkSession.createDataFrame([(v,)], "id long"))


def size(vertices: DataFrame) -> int:
    return vertices.count()


def contains(vertices: DataFrame, v: int) -> bool:
    return not vertices.where(F.col("id") == v).isEmpty()


def members(state: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows of ``state`` that are in the set."""
    return state.join(vertices.select("id").distinct(), "id", "left_semi")


def apply(state: DataFrame, changes: dict[str, Callable[[], Column] | Column], where: Column | None = None, among: DataFrame | None = None) -> DataFrame:
    """Assign columns on every vertex, on those that satisfy ``where``, or on the members of ``among``."""
    columns = {k: (c() if callable(c) and not isinstance(c, Column) else c) for k, c in changes.items()}
    if among is not None:
        state = state.join(among.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
        inside = F.coalesce(F.col("_in"), F.lit(False))
        where = inside if where is None else inside & where
    if where is not None:
        columns = {k: F.when(where, c).otherwise(F.col(k)) for k, c in columns.items()}
    return state.withColumns(columns).drop("_in")


def where(state: DataFrame, predicate: Column, among: DataFrame | None = None) -> DataFrame:
    """The vertices (id) that satisfy a predicate, of all or of a set."""
    return (state if among is None else members(state, among)).where(predicate).select("id")


def where_update(state: DataFrame, changes: dict[str, Column], predicate: Column, active: str = "active") -> DataFrame:
    """A filter that also assigns: first the changes, at once; then ``active`` by the predicate on the new values."""
    return state.withColumns(changes).withColumn(active, predicate)


def set_at(state: DataFrame, v: int, column: str, value) -> DataFrame:
    return state.withColumn(column, F.when(F.col("id") == v, F.lit(value)).otherwise(F.col(column)))


def get(state: DataFrame, v: int, column: str):
    row = state.where(F.col("id") == v).select(column).first()
    if row is None:
        raise KeyError(v)
    return row[0]


def total(state: DataFrame, column: str):
    """Sum of a column; 0 for no vertex."""
    return state.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def largest(state: DataFrame, column: str):
    return state.agg(F.max(column)).first()[0]


def write_min(state: DataFrame, v: int, column: str, value) -> tuple[DataFrame, bool]:
    """Lower one element; also tells whether that changed it."""
    changed = value < get(state, v, column)
    return (set_at(state, v, column, value) if changed else state), changed


def atomic_add(state: DataFrame, v: int, column: str, value) -> DataFrame:
    return state.withColumn(column, F.when(F.col("id") == v, F.col(column) + F.lit(value)).otherwise(F.col(column)))


def apply_extern(state: DataFrame, vertices: DataFrame, function: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Hand the state and a set to the caller's own DataFrame function; it returns the new state."""
    return function(state, vertices)


def apply_update_priority_extern(state: DataFrame, vertices: DataFrame, function: Callable[[DataFrame, DataFrame], DataFrame], priority: str, dirty: str = "dirty") -> DataFrame:
    """The same for a function that changes priorities: rows whose priority it changed join the queue, others
    stay as they were. The queue finds them in the bucket of their new priority."""
    after = apply_extern(state.withColumn("_was", F.col(priority)), vertices, function)
    return after.withColumn(dirty, F.col(dirty) | ~F.col(priority).eqNullSafe(F.col("_was"))).drop("_was")
