"""Reachability, shortest paths and the centralities built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import INT_MAX, great_circle_cm, maximum
from ..graph import Graph
from ..operators.edges import EdgeSet, Update
from ..operators.ordered import PriorityQueue
from ..plans.hints import BROADCAST_IDS, DEFAULT, Hints
from ..plans.loop import Rounds
from ..runtime import discard, materialize

#: Rows of a level that a task may hash; beyond that they are sorted, which spills.
HASHED_ROWS = 500_000


def bfs(graph: Graph, root: int, hints: Hints = DEFAULT) -> DataFrame:
    """(id, parent, depth): the smallest possible parent; -1 where unreached; the root is its own."""
    at_root = F.col("id") == root
    state = graph.vertices().select("id", F.when(at_root, F.lit(root)).otherwise(-1).cast("long").alias("parent"), F.when(at_root, 0).otherwise(-1).alias("depth"), at_root.alias("active"))
    edges, keep, active = EdgeSet(graph.laid_out(), hints), Rounds(), F.count_if("active")
    state, depth = keep.keep(state, active=active), 0
    while keep.figures["active"]:
        depth += 1
        after = edges.frontier(keep.figures["active"]).apply_modified(state, [Update("parent", lambda s, d, w: s.id, "set")], "parent", unset=F.col("parent") == -1)
        state = keep.keep(after.withColumn("depth", F.when(F.col("active"), depth).otherwise(F.col("depth"))), active=active)
    return keep.release(state).drop("active")


def _distances(graph: Graph, root: int) -> DataFrame:
    return graph.vertices().select("id", F.when(F.col("id") == root, 0).otherwise(INT_MAX).cast("long").alias("dist"), (F.col("id") == root).alias("active"))


def bellman_ford(graph: Graph, root: int, hints: Hints = DEFAULT) -> tuple[DataFrame, bool]:
    """((id, dist), whether a negative cycle was met): unreachable vertices have 2147483647."""
    edges, keep, active = EdgeSet(graph.laid_out(), hints), Rounds(), F.count_if("active")
    state, rounds, n = keep.keep(_distances(graph, root), active=active), 0, graph.n
    while keep.figures["active"] and rounds < n:
        after = edges.frontier(keep.figures["active"]).apply_modified(state, [Update("dist", lambda s, d, w: s.dist + w, "min")], "dist")
        state = keep.keep(after, active=active)
        rounds += 1
    return keep.release(state).drop("active"), bool(keep.figures["active"])


def delta_stepping(graph: Graph, root: int, delta: int = 1, hints: Hints = DEFAULT) -> DataFrame:
    """(id, dist): shortest distances, bucket by bucket of width delta (1: weighted breadth-first search)."""
    queue = PriorityQueue(_distances(graph, root).drop("active"), "dist", max(delta, hints.delta), start=root)
    return queue.process(EdgeSet(graph.laid_out(), hints), Update("dist", lambda s, d, w: s.dist + w, "min")).drop("dirty")


def point_to_point(graph: Graph, source: int, target: int, delta: int = 1) -> int:
    """Shortest distance between two vertices; stops as soon as it is settled."""
    queue = PriorityQueue(_distances(graph, source).drop("active"), "dist", delta, start=source, watch=target)
    state = queue.process(EdgeSet(graph.laid_out()), Update("dist", lambda s, d, w: s.dist + w, "min"), stop=lambda q: q.finished_node(target))
    return state.where(F.col("id") == target).first()["dist"]


def a_star(graph: Graph, coordinates: DataFrame, source: int, target: int, delta: int = 1) -> int:
    """Point-to-point distance, buckets ordered by distance plus great-circle estimate; coordinates (id, lat, lon)."""
    goal = coordinates.where(F.col("id") == target).first()
    guess: Column = great_circle_cm(F.col("lat"), F.col("lon"), F.lit(goal["lat"]), F.lit(goal["lon"])).cast("long")
    state = graph.vertices().join(coordinates, "id", "left").withColumn("h", F.coalesce(guess, F.lit(0))).drop("lat", "lon")
    at = F.col("id") == source
    state = state.withColumns({"f": F.when(at, 0).otherwise(INT_MAX).cast("long"), "g": F.when(at, F.col("h")).otherwise(INT_MAX).cast("long")})
    queue = PriorityQueue(state, "g", delta, start=source, watch=target)
    edges = EdgeSet(graph.laid_out())
    while not queue.finished_node(target):
        if queue.dequeue_ready_set() is None:
            break
        step = queue.state.withColumn("ready", queue.ready())
        got = edges.frontier(queue.rounds.figures["waiting"], "ready").messages(step, [Update("f", lambda s, d, w: s.f + w, "min"), Update("g", lambda s, d, w: s.g, "min")])
        joined = step.join(got, "id", "left")
        better = F.coalesce(F.col("_m0") < F.col("f"), F.lit(False))
        priority = F.least(F.col("g"), maximum(F.col("_m0") + F.col("h"), F.col("_m1")).cast("long"))
        joined = joined.withColumns({"dirty": (F.col("dirty") & ~F.col("ready")) | better, "f": F.least("f", "_m0"), "g": F.when(better, priority).otherwise(F.col("g"))})
        queue.replace(joined.drop("_m0", "_m1", "ready"))
    out = queue.state.where(F.col("id") == target).first()["f"]
    queue.rounds.release()
    return out


def multi_source_depths(graph: Graph, sources: list[int]) -> DataFrame:
    """(run, id, depth) of the reached vertices for many roots at once: one plan a depth, whatever their number."""
    spark = graph.spark
    front = spark.createDataFrame([(s, s) for s in sources], "run long, id long").withColumn("depth", F.lit(0))
    keep, depth = Rounds(), 0
    edge = graph.laid_out().edges.select(F.col("src").alias("id"), "dst")
    seen = keep.keep(front, active=F.count_if(F.col("depth") == depth))
    while keep.figures["active"]:
        depth += 1
        step = seen.where(F.col("depth") == depth - 1).join(edge, "id").select("run", F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(depth))
        seen = keep.keep(seen.unionByName(step).groupBy("run", "id").agg(F.min("depth").alias("depth")), active=F.count_if(F.col("depth") == depth))
    return keep.release(seen)


def closeness(graph: Graph, sources: list[int]) -> DataFrame:
    """(id, score): for each source the sum of hop distances to all reached vertices; unreached ones count 0.

    The state has a row for each source and vertex reached from it, so the sources are the caller's to choose.
    """
    return multi_source_depths(graph, sources).groupBy(F.col("run").alias("id")).agg(F.sum("depth").cast("long").alias("score"))


def closeness_weighted(graph: Graph, source: int) -> int:
    """Sum of shortest distances from one source; unreachable vertices count 0."""
    dist, _ = bellman_ford(graph, source)
    return dist.where(F.col("dist") < INT_MAX).agg(F.coalesce(F.sum("dist"), F.lit(0))).first()[0]


def betweenness(graph: Graph, sources: list[int], normalize: bool = False) -> DataFrame:
    """(id, score): dependencies of all vertices, summed over the sources (each source keeps its own too).

    Path counts go forward by depth, dependencies backward by depth, for all sources in one plan a level. A level
    is a table of its own, so each vertex and edge is met once a source and direction; messages combine before
    the shuffle, and those that do not go one level on are dropped where they arrive.
    """
    spark, out, into = graph.spark, graph.laid_out().edges, graph.transpose().laid_out().edges
    most = HASHED_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sent(edges: DataFrame, level: DataFrame, value: str) -> DataFrame:
        own = level.select("run", F.col("id").alias("src"), value)
        own = own.hint("shuffle_hash") if BROADCAST_IDS < level.count() <= most else own
        return edges.join(own, "src").groupBy("run", F.col("dst").alias("id")).agg(F.sum(value).alias("_m"))

    first = spark.createDataFrame([(s, s) for s in dict.fromkeys(sources)], "run long, id long")
    levels = [materialize(first.withColumn("paths", F.lit(1.0)), "level")]
    seen = levels[0].select("run", "id")
    while True:
        after = sent(out, levels[-1], "paths").withColumnRenamed("_m", "paths").join(seen, ["run", "id"], "left_anti")
        after = materialize(after, "level")
        if after.isEmpty():
            break
        levels.append(after)
        seen = seen.unionByName(after.select("run", "id"))
    done = [materialize(levels[-1].withColumn("dep", 1.0 / F.col("paths")), "level")]
    for level in levels[-2::-1]:
        got = sent(into, done[-1], "dep")
        done.append(materialize(level.join(got, ["run", "id"], "left").select("run", "id", "paths", (1.0 / F.col("paths") + F.coalesce("_m", F.lit(0.0))).alias("dep")), "level"))
    state = done[0]
    for level in done[1:]:
        state = state.unionByName(level)
    own = state.groupBy("id").agg(F.sum((F.col("dep") - 1.0 / F.col("paths")) * F.col("paths")).alias("score"))
    scores = graph.vertices().join(own, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    scores = materialize(scores, "scores")
    for level in levels + done:
        discard(level)
    if normalize:
        top = scores.agg(F.max("score")).first()[0] or 1.0
        scores = scores.withColumn("score", F.col("score") / top)
    return scores
