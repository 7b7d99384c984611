"""Driver-side rounds: one written table a round, with the round's figures from the same write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

from ..runtime import discard, materialize


class Rounds:
    """Keeps a loop's state: every round is written to the shared folder, so a plan never holds more than one
    round however often it reads the state, and a lost executor costs at most that round.

    Figures (aggregates) asked for with a round are observed while it is written: a loop needs one action a
    round. The table before the last is deleted.
    """

    def __init__(self):
        self.round, self._held, self.figures = 0, [], {}

    def keep(self, df: DataFrame, **figures: Column) -> DataFrame:
        self.round += 1
        if figures:
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in figures.items()])
        out = materialize(df, "round")
        if figures:
            self.figures = dict(seen.get)
        self._held.append(out)
        if len(self._held) > 2:
            discard(self._held.pop(0))
        return out

    def release(self, last: DataFrame | None = None) -> DataFrame | None:
        """Drop what no plan will read; ``last`` is the final state, which stays."""
        for df in self._held:
            if df is not last:
                discard(df)
        self._held = []
        return last


def repeat(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], times: int) -> DataFrame:
    """A fixed number of rounds, each written once."""
    rounds = Rounds()
    for i in range(times):
        state = rounds.keep(step(state, i))
    return rounds.release(state)
