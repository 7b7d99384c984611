"""Components, cores, triangles, covers, trees and cuts."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import global_rank, running_sums
from ..graph import Graph
from ..operators.edges import EdgeSet, Update
from ..operators.intersect import common_neighbours
from ..operators.ordered import PriorityQueue
from ..plans.hints import DEFAULT, Hints
from ..plans.loop import Rounds
from ..runtime import discard, materialize


def connected_components(graph: Graph, hints: Hints = DEFAULT) -> DataFrame:
    """(id, label): smallest id that reaches a vertex along edges; components if the graph is symmetric."""
    edges, keep, active = EdgeSet(graph.laid_out(), hints), Rounds(), F.count_if("active")
    state = keep.keep(graph.vertices().select("id", F.col("id").alias("label"), F.lit(True).alias("active")), active=active)
    while keep.figures["active"]:
        after = edges.frontier(keep.figures["active"]).apply_modified(state, [Update("label", lambda s, d, w: s.label, "min")], "label")
        state = keep.keep(after, active=active)
    return keep.release(state).drop("active")


def connected_components_jumping(graph: Graph, hints: Hints = DEFAULT) -> DataFrame:
    """The same labels by all edges each round plus pointer jumping: logarithmic rounds on long paths."""
    edges, keep = EdgeSet(graph.laid_out(), hints), Rounds()
    state = keep.keep(graph.vertices().select("id", F.col("id").alias("label")))
    changed = True
    while changed:
        low = keep.keep(edges.apply(state.withColumn("old", F.col("label")), [Update("label", lambda s, d, w: s.label, "min")]))
        up = low.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        jumped = low.join(up, "label").select("id", "old", F.col("_up").alias("label"))
        kept = keep.keep(jumped, active=F.count_if(F.col("label") != F.col("old")))
        state, changed = kept.drop("old"), keep.figures["active"]
    keep.release(kept)
    return state


def k_core(graph: Graph) -> DataFrame:
    """(id, core): core numbers of a symmetric graph.

    Peeling in order of degree takes a round for every wave of removals. The same numbers are the largest
    fixpoint of: a vertex's number is the h-index of its neighbours' numbers. From the degrees downwards all
    vertices move at once, so a few rounds do. The h-index comes from counts per (vertex, number), never from
    a hub's whole list; numbers only fall, so the vertex's own one caps it afterwards.
    """
    edges, keep, active = EdgeSet(graph.laid_out()), Rounds(), F.count_if("active")
    state = keep.keep(graph.out_degrees().select("id", F.col("degree").alias("core"), F.lit(True).alias("active")), active=active)
    while keep.figures["active"]:
        pairs, (value,) = edges.rows(state, lambda s, d, w: s.core)
        counts = pairs.groupBy(F.col("dst").alias("id"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        upward = Window.partitionBy("id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
        own = counts.select("id", F.least("value", F.sum("n").over(upward)).alias("h")).groupBy("id").agg(F.max("h").alias("h"))
        new = F.least("core", F.coalesce("h", F.lit(0))).cast("long")
        state = keep.keep(state.join(own, "id", "left").select("id", new.alias("core"), (new != F.col("core")).alias("active")), active=active)
    return keep.release(state).select("id", "core")


def k_core_unordered(graph: Graph) -> DataFrame:
    """The same numbers by peeling: the vertices of least degree are final and their neighbours' degrees sink,
    not below the present level. A round for every wave of removals, so slower than :func:`k_core`."""
    state = graph.out_degrees().withColumn("core", F.lit(0).cast("long"))
    queue = PriorityQueue(state, "degree", all_in=True, absent=None)
    return queue.process_sum(EdgeSet(graph.laid_out()), lambda s, d, w: F.lit(-1), "core").select("id", "core")


def triangle_count(graph: Graph, oriented: bool = True) -> int:
    """Triangles, each once; symmetric graphs.

    Oriented: edges go from the end with the lower (degree, id) to the other, so that a hub's list is only
    ever met from the small side. Otherwise by ids, with the bounded intersection of neighbour lists.
    """
    if not oriented:
        found = common_neighbours(graph, graph.edges.where("dst < src"))
        return found.agg(F.coalesce(F.sum("common"), F.lit(0))).first()[0]
    degree = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    e = graph.edges.select("src", "dst").join(degree.withColumnRenamed("n", "_s"), "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("_d")), "dst")
    up = materialize(e.where("_s < _d or (_s = _d and src < dst)").select("src", "dst", F.col("_d").alias("n")), "oriented")
    # a list is no longer than the square root of twice the edges, whatever the hubs; an edge sends what follows it
    # in its source's list to its other end, where it meets that end's own list: eight bytes a wedge travel
    lists = materialize(up.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("n", "dst"))).alias("l")).select("src", F.transform("l", lambda x: x["dst"]).alias("l")), "lists")
    sent = lists.where("size(l) > 1").select("l", F.posexplode("l").alias("i", "x")).where("i < size(l) - 1").select("x", F.slice("l", F.col("i") + 2, F.size("l")).alias("rest"))
    closed = sent.join(lists.select(F.col("src").alias("x"), F.col("l").alias("own")).hint("shuffle_hash"), "x")
    found = closed.agg(F.sum(F.size(F.array_intersect("rest", "own")))).first()[0] or 0
    discard(lists)
    discard(up)
    return found


def maximal_independent_set(graph: Graph, seed: int = 0, priority: Column | None = None) -> DataFrame:
    """(id, chosen): Luby rounds with hashed priorities (or ``priority``, read from the id; ties by id).

    Symmetric graphs. Always the set that a serial pass in order of priority would choose.
    """
    keep, open_ = Rounds(), F.count_if("open")
    p = F.xxhash64(F.lit(seed), "id") if priority is None else priority
    state = keep.keep(graph.vertices().select("id", p.alias("p"), F.lit(False).alias("chosen"), F.lit(True).alias("open")), open=open_)
    edges = EdgeSet(graph.laid_out())
    while keep.figures["open"]:
        first = edges.frontier(keep.figures["open"], "open").messages(state, [Update("p", lambda s, d, w: F.struct(s.p, s.id), "min")])
        fresh = F.col("open") & (F.col("_m0").isNull() | (F.struct("p", "id") < F.col("_m0")))
        state = keep.keep(state.join(first, "id", "left").withColumn("fresh", fresh).drop("_m0"), fresh=F.count_if("fresh"))
        hit = edges.frontier(keep.figures["fresh"], "fresh").messages(state, [Update("open", lambda s, d, w: F.lit(1), "max")])
        state = keep.keep(state.join(hit, "id", "left").select("id", "p", (F.col("chosen") | F.col("fresh")).alias("chosen"), (F.col("open") & ~F.col("fresh") & F.col("_m0").isNull()).alias("open")), open=open_)
    return keep.release(state).select("id", "chosen")


def set_cover(graph: Graph, epsilon: float = 0.01) -> DataFrame:
    """(id) of the chosen sets: approximate cover, vertices are sets that hold their out-neighbours.

    Buckets of uncovered size in powers of 1 + epsilon, largest first. In a round the sets of the top bucket
    claim their elements, the smallest id wins each; sets that won nearly a bucket's worth join the cover,
    the others release what they won. Two tables are written a round: the claims and what is left.
    """
    scale = 1.0 / math.log(1.0 + epsilon)
    # a whole power of the base belongs to its own bucket, however the logarithm rounds
    bucket = F.floor(scale * F.log(F.col("n").cast("double")) + 1e-9).cast("long")
    left, claimed, found = Rounds(), Rounds(), []
    size = F.count(F.lit(1))
    edges = left.keep(graph.edges.select("src", "dst"), left=size)
    while left.figures["left"]:
        sets = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select("src", bucket.alias("b"))
        top = sets.agg(F.max("b").alias("b"))  # one row
        large = sets.join(F.broadcast(top), "b").select("src", "b")
        claims = edges.join(large, "src").groupBy("dst").agg(F.min(F.struct("src", "b")).alias("c")).select("dst", "c.src", "c.b")
        least = F.greatest(F.ceil(F.pow(F.lit(1 + epsilon), F.col("b") - 1) - 1e-9), F.lit(1))
        won = claims.groupBy("src", "b").agg(size.alias("n")).where(F.col("n") >= least).select("src")
        claims = claimed.keep(claims.join(won, "src", "left_semi").select("src", "dst"))
        edges = left.keep(edges.join(claims.select("dst"), "dst", "left_anti").join(claims.select("src").distinct(), "src", "left_anti").select("src", "dst"), left=size)
        found.append(materialize(claims.select(F.col("src").alias("id")).distinct(), "chosen"))
    left.release()
    claimed.release()
    out = graph.spark.range(0)
    for f in found:
        out = out.unionAll(f)
    return out


#: Edges up to which a spanning tree is grown serially, in the order of a heap.
SERIAL_EDGES = 200_000


def minimum_spanning_tree(graph: Graph, start: int, serial_edges: int = SERIAL_EDGES) -> DataFrame:
    """(id, parent): -1 where unreached, the start is its own parent.

    Edges are ordered by (weight, smaller id, larger id), a total order, so an undirected graph has one tree
    whichever way it is found: up to an explicit number of edges by growing it from the start with a heap,
    beyond that by Boruvka rounds, distributed, whose tree is then oriented from the start. A directed graph
    is grown along its edges; that has no distributed form, so a larger one is an error.
    """
    if graph.edges.limit(serial_edges + 1).count() <= serial_edges:
        out: dict[int, list] = {}
        for row in graph.edges.collect():
            out.setdefault(row["src"], []).append((row["weight"], row["dst"]))
        parent, heap = {}, [(0, start, start, start, start)]
        while heap:
            _, _, _, v, p = heapq.heappop(heap)
            if v in parent:
                continue
            parent[v] = p
            for w, x in out.get(v, []):
                if x not in parent:
                    heapq.heappush(heap, (w, min(v, x), max(v, x), x, v))
        found = graph.spark.createDataFrame(list(parent.items()), "id long, parent long")
        return graph.vertices().join(found, "id", "left").select("id", F.coalesce("parent", F.lit(-1)).alias("parent"))
    if not graph.undirected:
        raise ValueError(f"a directed graph of more than {serial_edges} edges")
    tree, names = boruvka(graph, serial_edges)
    found = _rooted(tree, names, start, serial_edges)
    return graph.vertices().join(found, "id", "left").select("id", F.coalesce("parent", F.lit(-1)).alias("parent"))


#: Light edges that are contracted before the others, as a multiple of the vertices.
LIGHT_SHARE = 4


def boruvka(graph: Graph, serial_edges: int = 0, record: bool = False) -> tuple[DataFrame, DataFrame]:
    """((src, dst), (id, label)) of the minimum spanning forest; ties by (weight, smaller id, larger id).

    The light edges are contracted first: what the heavy ones join is then mostly joined already, and those
    leave in one pass. The last ``serial_edges`` edges between components are joined on the driver. With
    ``record`` nothing is, all edges take part at once, and ``path`` holds for each vertex and round the
    component after it (l) and the weight by which the one before was joined (w, null: by none).
    """
    pairs = graph.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight").groupBy("u", "v").agg(F.min("weight").alias("w"))
    size = F.count(F.lit(1))
    held, names = Rounds(), Rounds()
    pairs = held.keep(pairs, left=size)
    total, bound = held.figures["left"], None
    if not record and total > LIGHT_SHARE * graph.n:
        bound = pairs.agg(F.percentile_approx("w", LIGHT_SHARE * graph.n / total)).first()[0]
    label = graph.vertices().withColumn("label", F.col("id"))
    label = names.keep(label.withColumn("path", F.array().cast("array<struct<l:long,w:int>>")) if record else label)
    trees = []
    for part in (pairs,) if bound is None else (pairs.where(F.col("w") <= bound), pairs.where(F.col("w") > bound)):
        left = Rounds()
        end = lambda key, to: label.select(F.col("id").alias(key), F.col("label").alias(to)).hint("shuffle_hash")  # noqa: B023, E731
        e = left.keep(part.join(end("u", "a"), "u").join(end("v", "b"), "v").where("a <> b"), left=size)
        while left.figures["left"] > serial_edges:
            pick = F.struct("w", "u", "v")
            sides = F.array(F.struct(F.col("a").alias("c"), F.struct("w", "u", "v", F.col("b").alias("o")).alias("p")), F.struct(F.col("b").alias("c"), F.struct("w", "u", "v", F.col("a").alias("o")).alias("p")))
            best = materialize(e.select(F.explode(sides).alias("s")).groupBy("s.c").agg(F.min("s.p").alias("p")).select("c", "p.*"), "picks")
            trees.append(materialize(best.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct(), "tree"))
            roots = _hooked(best, pick)
            if record:
                step = roots.join(best.select("c", "w"), "c").select(F.col("c").alias("label"), "p", "w")
                after = label.join(step, "label", "left").select("id", F.coalesce("p", "label").alias("label"), F.concat("path", F.array(F.struct(F.coalesce("p", "label").alias("l"), F.col("w").cast("int").alias("w")))).alias("path"))
            else:
                after = label.join(roots.withColumnRenamed("c", "label"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
            label = names.keep(after)
            one, two = roots.select(F.col("c").alias("a"), F.col("p").alias("_a")), roots.select(F.col("c").alias("b"), F.col("p").alias("_b"))
            e = left.keep(e.join(one, "a").join(two, "b").where("_a <> _b").select("u", "v", "w", F.col("_a").alias("a"), F.col("_b").alias("b")), left=size)
            discard(best)
        if left.figures["left"]:
            chosen, roots = _kruskal(e.collect())
            trees.append(graph.spark.createDataFrame(chosen, "src long, dst long"))
            moved = graph.spark.createDataFrame(roots, "label long, p long")
            label = names.keep(label.join(F.broadcast(moved), "label", "left").select("id", F.coalesce("p", "label").alias("label")))
        left.release()
    names.release(label)
    held.release()
    tree = graph.spark.createDataFrame([], "src long, dst long")
    for t in trees:
        tree = tree.unionByName(t)
    return materialize(tree, "tree"), label


def _hooked(best: DataFrame, pick: Column) -> DataFrame:
    """(c, p): the root of each component's tree of picks, by pointer jumping; of two that pick each other the smaller."""
    other = best.select(F.col("c").alias("o"), pick.alias("_pick"))
    root = (pick == F.col("_pick")) & (F.col("c") < F.col("o"))
    keep = Rounds()
    state = keep.keep(best.join(other, "o").select("c", F.when(root, F.col("c")).otherwise(F.col("o")).alias("p")), moved=F.lit(1))
    moved = 1
    while moved:
        up = state.select(F.col("c").alias("p"), F.col("p").alias("_p"))
        state = keep.keep(state.join(up, "p").select("c", F.col("_p").alias("p"), (F.col("p") != F.col("_p")).alias("_moved")), moved=F.count_if("_moved")).drop("_moved")
        moved = keep.figures["moved"]
    return state


def _kruskal(rows: list) -> tuple[list, list]:
    """((u, v) of the forest, (component, root) of all components) of edges (u, v, w, a, b) between components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for r in sorted(rows, key=lambda r: (r["w"], r["u"], r["v"])):
        a, b = find(r["a"]), find(r["b"])
        if a != b:
            root[max(a, b)] = min(a, b)
            chosen.append((r["u"], r["v"]))
    return chosen, [(x, find(x)) for x in list(root)]


def _rooted(tree: DataFrame, names: DataFrame, start: int, serial_edges: int = 0) -> DataFrame:
    """(id, parent) of the start's tree (the start is its own parent), in rounds that do not follow its depth.

    Leaves hang on their only neighbour; taking them off again and again leaves a small core, which is walked
    on the driver if it has at most ``serial_edges`` edges. A larger one is put in the order of its Euler tour
    by pointer jumping: of the two directions of an edge the earlier one leads away from the start.
    """
    spark, size = tree.sparkSession, F.count(F.lit(1))
    own = names.where(F.col("id") == start).first()
    reached = names.where(F.col("label") == (own["label"] if own else start)).select(F.col("id").alias("src"))
    arcs = tree.unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(reached, "src", "left_semi")
    keep, found = Rounds(), [spark.createDataFrame([(start, start)], "id long, parent long")]
    arcs, before = keep.keep(arcs, left=size), None
    while (left := keep.figures["left"]) > 2 * serial_edges and (before is None or left < 0.9 * before):
        leaves = materialize(arcs.groupBy("src").agg(size.alias("n"), F.min("dst").alias("parent")).where((F.col("n") == 1) & (F.col("src") != start)).select(F.col("src").alias("id"), "parent"), "leaves")
        found.append(leaves)
        gone = lambda key: leaves.select(F.col("id").alias(key))  # noqa: B023, E731
        arcs, before = keep.keep(arcs.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"), left=size), left
    if 0 < left <= 2 * serial_edges:
        near: dict[int, list] = {}
        for r in arcs.collect():
            near.setdefault(r["src"], []).append(r["dst"])
        parent, front = {start: start}, [start]
        for v in front:
            for x in near.get(v, []):
                if x not in parent:
                    parent[x] = v
                    front.append(x)
        found.append(spark.createDataFrame([p for p in parent.items() if p[0] != start], "id long, parent long"))
    elif left:
        around = Window.partitionBy("src").orderBy("dst")
        first = arcs.where(F.col("src") == start).agg(F.min("dst")).first()[0]
        # after the arc to a vertex comes the arc to that vertex's next neighbour, all around
        turn = arcs.select("src", "dst", F.coalesce(F.lead("dst").over(around), F.first("dst").over(around)).alias("ndst"))
        end = (F.col("src") == start) & (F.col("ndst") == first)
        step = turn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(~end, F.col("src")).alias("nsrc"), F.when(~end, F.col("ndst")).alias("ndst"), F.when(end, 0).otherwise(1).cast("long").alias("d"))
        tour = Rounds()
        state = tour.keep(step, open=F.count("nsrc"))
        while tour.figures["open"]:
            ahead = state.select(F.col("src").alias("nsrc"), F.col("dst").alias("ndst"), F.col("nsrc").alias("_s"), F.col("ndst").alias("_d"), F.col("d").alias("_n"))
            state = tour.keep(state.join(ahead, ["nsrc", "ndst"], "left").select("src", "dst", F.col("_s").alias("nsrc"), F.col("_d").alias("ndst"), (F.col("d") + F.coalesce("_n", F.lit(0))).alias("d")), open=F.count("nsrc"))
        back = state.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("d").alias("_back"))
        found.append(materialize(state.join(back, ["src", "dst"]).where("d > _back").select(F.col("dst").alias("id"), F.col("src").alias("parent")), "core"))
        tour.release()
    keep.release()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def lighter_than_path(graph: Graph, tree: DataFrame) -> DataFrame:
    """The edges (src < dst) of the undirected graph that are lighter than an edge of ``tree`` (src, dst, weight)
    on the path between their ends: none, if and only if the tree spans its vertices with least weight.

    Boruvka rounds over the tree alone give each vertex the components it was part of and the weights by which
    they were joined; the heaviest of these below the first common component is the heaviest edge of the path.
    """
    _, names = boruvka(Graph(tree, graph.n, True), record=True)
    top = tree.agg(F.max("weight")).first()[0]
    # an edge as heavy as the tree's heaviest is lighter than none
    e = graph.edges.where("src < dst").where(F.col("weight") < F.lit(top))
    own = lambda key, name: names.select(F.col("id").alias(key), F.col("path").alias(name))
    met = F.array_position(F.zip_with("_a", "_b", lambda x, y: x["l"] == y["l"]), True).cast("int")
    both = e.join(own("src", "_a"), "src").join(own("dst", "_b"), "dst").withColumn("_k", met).where("_k > 0")
    heaviest = lambda name: F.array_max(F.transform(F.slice(name, 1, F.col("_k")), lambda x: x["w"]))
    return both.where(F.col("weight") < F.greatest(heaviest("_a"), heaviest("_b"))).select("src", "dst", "weight")


def sweep_cut(graph: Graph, scores: DataFrame, score: str = "score") -> DataFrame:
    """(id, rank): the vertices before the first prefix of least conductance, by descending score.

    Conductance is crossing / min(volume, m - volume), 1 where either is 0. Equal scores go by ascending id.
    """
    ranked = global_rank(scores.select("id", score), F.col(score).desc(), F.col("id").asc())
    ranks = materialize(ranked.select("id", "rank"), "ranks")
    m = graph.edge_count()
    e = graph.edges.select("src", "dst").join(ranks.select(F.col("id").alias("src"), F.col("rank").alias("rank")), "src").join(ranks.select(F.col("id").alias("dst"), F.col("rank").alias("_r")), "dst", "left")
    turn = F.when(F.col("_r") < F.col("rank"), -1).otherwise(1)
    per = e.groupBy("rank").agg(F.count(F.lit(1)).alias("volume"), F.sum(turn).alias("crossing"))
    steps = ranks.join(per, "rank", "left").select("id", "rank", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("crossing", F.lit(0)).cast("long").alias("crossing"))
    sums = running_sums(steps, "rank", ["volume", "crossing"])
    side = F.least(F.col("volume"), m - F.col("volume"))
    conductance = F.when((F.col("crossing") == 0) | (side == 0), 1.0).otherwise(F.try_divide(F.col("crossing"), side))
    best = sums.select(conductance.alias("c"), "rank").agg(F.min(F.struct("c", "rank"))).first()[0]
    return ranks.where(F.col("rank") < (best["rank"] if best else 0))
