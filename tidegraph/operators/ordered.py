"""Ordered processing: buckets are a derived column, the queue is a loop on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import INT_MAX
from ..plans.loop import Rounds
from .edges import EdgeSet, Update


class PriorityQueue:
    """Vertices by ``floor(priority / delta)``, increasing (or decreasing) bucket by bucket.

    ``state`` holds the priority column and a dirty flag: dirty vertices are in the queue. A vertex whose
    priority changed since it was queued is found in its present bucket only, so duplicates within a bucket or
    across buckets cannot arise; the options are accepted. What the loop asks of the state (the next bucket,
    its size, the watched vertex) is observed while a round is written.
    """

    def __init__(self, state: DataFrame, priority: str, delta: int = 1, increasing: bool = True, start: int | None = None, all_in: bool = False, absent: int | None = INT_MAX, watch: int | None = None, dup_within: bool = False, dup_across: bool = False):
        self.priority, self.delta, self.increasing, self.absent, self.watch = priority, delta, increasing, absent, watch
        queued = (F.col("id") == start) if start is not None else (self._present() if all_in else F.lit(False))
        self.rounds = Rounds()
        self.current: int | None = None
        self.replace(state.withColumn("dirty", queued))

    def _present(self) -> Column:
        return F.lit(True) if self.absent is None else F.col(self.priority) != self.absent

    def bucket(self) -> Column:
        return F.floor(F.col(self.priority) / self.delta).cast("long")

    def replace(self, state: DataFrame) -> None:
        """The next round's state, written; the figures of the queue come with it."""
        waits = F.when(F.col("dirty") & self._present(), self.bucket())
        figures = {"ahead": (F.min if self.increasing else F.max)(waits), "waiting": F.count(waits)}
        if self.watch is not None:
            own = F.col("id") == self.watch
            figures |= {"watched": F.max(F.when(own & self._present(), self.bucket()))}
        self.state = self.rounds.keep(state, **figures)

    def _advance(self) -> int | None:
        return self.rounds.figures["ahead"]

    def finished(self) -> bool:
        return self._advance() is None

    def finished_node(self, v: int) -> bool:
        """No queued bucket can still improve the vertex: its own is strictly before all of them."""
        ahead = self._advance()
        if ahead is None:
            return True
        if v == self.watch:
            own = self.rounds.figures["watched"]
        else:
            row = self.state.where((F.col("id") == v) & self._present()).select(self.bucket()).first()
            own = None if row is None else row[0]
        return own is not None and (own < ahead if self.increasing else own > ahead)

    def ready(self) -> Column:
        """Of a row: whether it is in the current bucket."""
        return F.col("dirty") & self._present() & (self.bucket() == self.current)

    def dequeue_ready_set(self) -> DataFrame | None:
        """The next bucket's vertices, as rows of the state; None when no bucket is left."""
        ahead = self._advance()
        if ahead is None:
            return None
        self.current = ahead
        return self.state.where(self.ready())

    def current_priority(self) -> int | None:
        return self.current

    def process(self, edges: EdgeSet, update: Update, stop: Callable[[PriorityQueue], bool] | None = None) -> DataFrame:
        """Run the loop: relax the edges of each ready bucket until no bucket is left, or ``stop`` says so."""
        while not (stop is not None and stop(self)) and (ahead := self._advance()) is not None:
            self.current = ahead
            ready = self.ready()
            step = self.state.withColumn("ready_", ready).withColumn("dirty", F.col("dirty") & ~ready)
            waiting = self.rounds.figures["waiting"]  # at most so many are ready
            self.replace(edges.frontier(waiting, "ready_").apply_update_priority(step, update).drop("ready_"))
        return self.rounds.release(self.state)

    def process_sum(self, edges: EdgeSet, change: Callable[..., Column], settled: str) -> DataFrame:
        """Run the loop where relaxing adds ``change`` to the neighbours' priorities, not past the current one.

        A dequeued vertex is final: it leaves the queue, ``settled`` gets its priority, and later changes pass
        it by. Others move to the bucket of their new priority.
        """
        while (ahead := self._advance()) is not None:
            self.current = ahead
            ready = self.ready()
            step = self.state.withColumn("ready_", ready).withColumns({"dirty": F.col("dirty") & ~ready, settled: F.when(ready, F.col(self.priority)).otherwise(F.col(settled))})
            got = edges.frontier(self.rounds.figures["waiting"], "ready_").messages(step, [Update(self.priority, change, "sum")])
            after = update_priority_sum(F.col(self.priority), F.col("_m0"), F.lit(ahead * self.delta))
            self.replace(step.join(got, "id", "left").withColumn(self.priority, F.when(F.col("dirty"), after).otherwise(F.col(self.priority))).drop("_m0", "ready_"))
        return self.rounds.release(self.state)


def update_priority_sum(old: Column, change: Column, least: Column) -> Column:
    """old + change, never below ``least``; unchanged where old is there already."""
    return F.when(old > least, F.greatest(least, old + F.coalesce(change, F.lit(0)))).otherwise(old)
