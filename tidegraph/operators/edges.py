"""Edge traversal as one plan: semi-join, joins with the state the functions read, one aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.hints import BROADCAST_IDS, DEFAULT, Hints

#: Reductions of messages, and how they meet the old value.
OPS = ("sum", "min", "max", "set")


@dataclass(frozen=True)
class Update:
    """``column`` of the vertex at ``at`` ('dst' or 'src') is reduced with ``op`` by ``value(s, d, w)``.

    'set' is the plain assignment in which any writer may win; here the smallest value wins.
    """

    column: str
    value: Callable[..., Column]
    op: str = "sum"
    at: str = "dst"

    def __post_init__(self):
        if self.op not in OPS or self.at not in ("src", "dst"):
            raise ValueError(f"unknown reduction {self.op!r} at {self.at!r}")


class Side:
    """One end of an edge inside a function: ``s.rank`` is the property, ``s.id`` the vertex."""

    def __init__(self, key: str):
        self._key, self._used = key, set()

    @property
    def id(self) -> Column:
        return F.col(self._key)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        self._used.add(name)
        return F.col(f"_{self._key}_{name}")

    def __getitem__(self, name: str) -> Column:
        return getattr(self, name)


def combine(op: str, old: Column, message: Column) -> Column:
    if op == "sum":
        return F.when(message.isNull(), old).otherwise(old + message)
    if op == "min":
        return F.least(old, message)
    if op == "max":
        return F.greatest(old, message)
    return F.coalesce(message, old)


class EdgeSet:
    """Fluent traversal: ``EdgeSet(graph).from_(frontier).to(predicate).apply(state, updates)``."""

    def __init__(self, graph: Graph, hints: Hints = DEFAULT):
        self.graph, self.hints = graph, hints
        self._sets: list[tuple[str, DataFrame]] = []
        self._predicates: list[tuple[str, Callable[[Side], Column]]] = []
        self._active: int | None = None

    def _with(self, end: str, what) -> EdgeSet:
        other = EdgeSet(self.graph, self.hints)
        other._sets, other._predicates, other._active = list(self._sets), list(self._predicates), self._active
        if isinstance(what, DataFrame):
            other._sets.append((end, what))
        elif what is not None:
            other._predicates.append((end, what))
        return other

    def frontier(self, active: int, column: str = "active") -> EdgeSet:
        """Only edges whose source is active: ``column`` of the state is true for ``active`` vertices.

        A sparse push looks the edges up by a frontier of a checked size; else the flag is read in the join.
        """
        other = self._with("src", lambda s: s[column])
        other._active = active
        return other

    def from_(self, what) -> EdgeSet:
        """Only edges whose source is in a vertex set (id), or satisfies a predicate on its state."""
        return self._with("src", what)

    def to(self, what) -> EdgeSet:
        """The same for the destination."""
        return self._with("dst", what)

    src_filter, dst_filter = from_, to

    def rows(self, state: DataFrame | None, *functions: Callable[..., Column]) -> tuple[DataFrame, list[Column]]:
        """The edges that pass, joined with just the properties that the functions read, and their columns."""
        edges = self.hints.spread(self.graph.edges)
        for end, ids in self._sets:
            edges = self.hints.semi_join(edges, ids, end)
        src, dst = Side("src"), Side("dst")
        conditions = [(end, p(src if end == "src" else dst)) for end, p in self._predicates]
        w = F.col("weight") if self.graph.weighted else F.lit(None).cast("int")
        columns = [f(src, dst, w) for f in functions]
        for side in (src, dst):
            if side._used:
                if state is None:
                    raise ValueError("these functions read vertex state")
                own = state.select(F.col("id").alias(side._key), *[F.col(c).alias(f"_{side._key}_{c}") for c in sorted(side._used)])
                for end, c in conditions:  # a predicate reads one end: it thins the state before the join
                    if end == side._key:
                        own = own.where(c)
                if side is src and self._active is not None and self._active <= BROADCAST_IDS and self.hints.sparse(self._active, self.graph.n):
                    own = F.broadcast(own)
                elif self.graph.placed and side is src and self.graph.n > BROADCAST_IDS:  # the state is hashed, so a round sorts no edges
                    own = own.hint("shuffle_hash")
                edges = edges.join(own, side._key)
        for end, c in conditions:
            if not (src if end == "src" else dst)._used:
                edges = edges.where(c)
        return edges, columns

    def messages(self, state: DataFrame | None, updates: list[Update]) -> DataFrame:
        """(id, _m0, _m1, ...): reduced messages of the vertices that get any."""
        edges, values = self.rows(state, *[u.value for u in updates])
        names = [f"_m{i}" for i in range(len(updates))]
        ends = sorted({u.at for u in updates})
        if len(ends) == 1:
            sent = edges.select(F.col(ends[0]).alias("id"), *[v.alias(n) for v, n in zip(values, names, strict=True)])
        else:  # both ends at once: an edge sends a message to each
            edges = edges.withColumns({f"_v{i}": v for i, v in enumerate(values)})
            to = lambda end: F.struct(F.col(end).alias("id"), *[(F.col(f"_v{i}") if u.at == end else F.lit(None).cast(edges.schema[f"_v{i}"].dataType)).alias(names[i]) for i, u in enumerate(updates)])
            sent = edges.select(F.explode(F.array(to("src"), to("dst"))).alias("m")).select("m.*")
        reduce = {"sum": F.sum, "min": F.min, "max": F.max, "set": F.min}
        return sent.groupBy("id").agg(*[reduce[u.op](n).alias(n) for u, n in zip(updates, names, strict=True)])

    def apply(self, state: DataFrame, updates: list[Update]) -> DataFrame:
        """``state`` after the traversal. All functions read the state as it was before."""
        return self._apply(state, updates, None, None, None)

    def apply_modified(self, state: DataFrame, updates: list[Update], track: str, active: str = "active", unset: Column | None = None) -> DataFrame:
        """As apply; ``active`` marks the vertices whose ``track`` changed: the next frontier, without repeats.

        For 'min' and 'max' the value must differ; a sum or an assignment counts whenever a message came.
        ``unset`` is a condition on the receiving vertex, which keeps its state where it is false. It is read
        where combined messages meet the state, so no edge travels to its destination for it (a ``to``
        predicate has the same rows and thins edges first, at that price).
        """
        return self._apply(state, updates, track, active, unset)

    def _apply(self, state, updates, track, active, unset):
        joined = state.join(self.messages(state, updates), "id", "left")
        new = {}
        for i, u in enumerate(updates):
            new[u.column] = combine(u.op, new.get(u.column, F.col(u.column)), F.col(f"_m{i}")).cast(state.schema[u.column].dataType)
        if track is not None:
            own = [(i, u) for i, u in enumerate(updates) if u.column == track]
            changed = F.lit(False)
            for i, u in own:
                m = F.col(f"_m{i}")
                changed = changed | (m.isNotNull() if u.op in ("sum", "set") else F.coalesce(m < F.col(track) if u.op == "min" else m > F.col(track), F.lit(False)))
            new[active] = changed
        if unset is not None:
            new = {c: (unset & v if c == active else F.when(unset, v).otherwise(F.col(c))) for c, v in new.items()}
        return joined.withColumns(new).drop(*[f"_m{i}" for i in range(len(updates))])

    def apply_returning(self, state: DataFrame | None, predicate: Callable[..., Column]) -> DataFrame:
        """The destinations (id) of edges for which a function returns true, each once."""
        edges, (hit,) = self.rows(state, predicate)
        return edges.where(hit).select(F.col("dst").alias("id")).distinct()

    def apply_update_priority(self, state: DataFrame, update: Update, dirty: str = "dirty") -> DataFrame:
        """As apply_modified on a priority column; rows whose priority changed become dirty, others stay so."""
        after = self.apply_modified(state.withColumn("_was", F.col(dirty)), [update], update.column, dirty)
        return after.withColumn(dirty, F.col(dirty) | F.col("_was")).drop("_was")
