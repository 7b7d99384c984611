"""Rank-like algorithms: fixed rounds of join and sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.edges import EdgeSet, Update
from ..operators.vertices import where_update
from ..plans.hints import DEFAULT, Hints
from ..plans.loop import Rounds, repeat


def pagerank(graph: Graph, rounds: int = 20, damping: float = 0.85, hints: Hints = DEFAULT) -> DataFrame:
    """(id, rank, error): error is the last round's absolute change. Dangling mass is not handed on."""
    n = max(graph.n, 1)
    base = (1.0 - damping) / n
    state = graph.out_degrees().select("id", "degree", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("error"))
    edges = EdgeSet(graph.laid_out(), hints)

    def step(state: DataFrame, _: int) -> DataFrame:
        got = edges.messages(state, [Update("rank", lambda s, d, w: s.rank / s.degree)])
        new = F.lit(base) + F.lit(damping) * F.coalesce("_m0", F.lit(0.0))
        return state.join(got, "id", "left").select("id", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("error"))

    return repeat(state, step, rounds).drop("degree")


def pagerank_delta(graph: Graph, rounds: int = 10, damping: float = 0.85, epsilon: float = 0.1, trace: list | None = None) -> DataFrame:
    """(id, rank, delta, active): only vertices whose change exceeds epsilon times their rank send on.

    ``trace`` collects (frontier size, sum of |delta|) of each round.
    """
    n = max(graph.n, 1)
    base = (1.0 - damping) / n
    state = graph.out_degrees().select("id", "degree", F.lit(0.0).alias("rank"), F.lit(1.0 / n).alias("delta"), F.lit(True).alias("active"))
    keep = Rounds()
    edges = EdgeSet(graph.laid_out())
    for i in range(1, rounds + 1):
        got = edges.frontier(keep.figures["active"] if i > 1 else n).messages(state, [Update("_", lambda s, d, w: s.delta / s.degree)])
        joined = state.join(got, "id", "left").withColumn("_sum", F.coalesce("_m0", F.lit(0.0))).drop("_m0")
        if i == 1:
            whole = F.col("_sum") * damping + base
            joined = joined.withColumns({"rank": F.col("rank") + whole, "delta": whole - 1.0 / n})
        else:
            joined = joined.withColumns({"rank": F.col("rank") + F.col("_sum") * damping, "delta": F.col("_sum") * damping})
        state = keep.keep(where_update(joined.drop("_sum"), {}, F.abs("delta") > epsilon * F.col("rank")), active=F.count_if("active"), change=F.sum(F.abs("delta")))
        if trace is not None:
            trace.append((keep.figures["active"], keep.figures["change"]))
    return keep.release(state).drop("degree")


def eigenvector_centrality(graph: Graph, rounds: int = 9) -> DataFrame:
    """(id, score, error): unnormalised power iteration."""
    state = graph.state(score=1.0 / max(graph.n, 1), error=0.0)
    edges = EdgeSet(graph.laid_out())

    def step(state: DataFrame, _: int) -> DataFrame:
        got = edges.messages(state, [Update("score", lambda s, d, w: s.score)])
        new = F.coalesce("_m0", F.lit(0.0))
        return state.join(got, "id", "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("error"))

    return repeat(state, step, rounds)


def spmv(graph: Graph, vector: DataFrame) -> DataFrame:
    """(id, value): matrix (weights, or 1) times vector (id, value), by source."""
    got = EdgeSet(graph).messages(vector, [Update("value", lambda s, d, w: d.value * (w if graph.weighted else F.lit(1)), at="src")])
    return graph.vertices().join(got, "id", "left").select("id", F.coalesce("_m0", F.lit(0.0)).cast("double").alias("value"))


def collaborative_filtering(graph: Graph, k: int = 20, step: float = 3.5e-7, decay: float = 0.001, rounds: int = 10, start: float = 0.5) -> DataFrame:
    """(id, latent): gradient descent on ratings (edge weights); errors gather on destinations alone."""
    state, laid = graph.vertices().select("id", F.array_repeat(F.lit(start), k).alias("latent")), EdgeSet(graph.laid_out())

    def one(state: DataFrame, _: int) -> DataFrame:
        edges, _ = laid.rows(state, lambda s, d, w: F.array(s.latent, d.latent))
        dot = F.aggregate(F.zip_with("_src_latent", "_dst_latent", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        edges = edges.select("dst", "_src_latent", (F.col("weight") - dot).alias("_err"))
        sums = edges.groupBy(F.col("dst").alias("id")).agg(F.array(*[F.sum(F.col("_src_latent")[i] * F.col("_err")) for i in range(k)]).alias("_e"))
        joined = state.join(sums, "id", "left")
        error = F.coalesce("_e", F.array_repeat(F.lit(0.0), k))
        return joined.select("id", F.zip_with("latent", error, lambda x, e: x + step * (e - decay * x)).alias("latent"))

    return repeat(state, one, rounds)
