"""Operators and algorithms on small graphs: known values, serial oracles, and hint invariance."""

import heapq
import random
import struct
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.algorithms import paths, ranking, structure
from tidegraph.functions.scalar import INT_MAX, argument, atoi
from tidegraph.graph import Graph
from tidegraph.operators import vertices
from tidegraph.operators.edges import EdgeSet, Update
from tidegraph.operators.ordered import PriorityQueue
from tidegraph.plans.hints import Hints, Schedule
from tidegraph.plans.loop import Rounds
from tidegraph.runtime import materialize
from tidegraph.sources import readers, writers

# fixed values: a small graph; the expected values below belong to it
SMALL = [(3, 4), (4, 2), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
WEIGHTED = [(s, d, i + 1) for i, (s, d) in enumerate(SMALL)]


@pytest.fixture(scope="module")
def small(spark):
    return Graph.from_pairs(spark, SMALL).persist()


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    return Graph.from_pairs(spark, [(rng.randrange(14), rng.randrange(14), rng.randint(1, 20)) for _ in range(60)]).persist()


def rows(df):
    return sorted(map(tuple, df.collect()))


def dijkstra(g, root):
    out = {}
    for s, d, w in g.edges.collect():
        out.setdefault(s, []).append((d, w))
    dist, heap = {root: 0}, [(0, root)]
    while heap:
        a, v = heapq.heappop(heap)
        if a > dist[v]:
            continue
        for d, w in out.get(v, []):
            if a + w < dist.get(d, INT_MAX):
                dist[d] = a + w
                heapq.heappush(heap, (a + w, d))
    return [(v, dist.get(v, INT_MAX)) for v in range(g.n)]


def test_load_rules(spark):
    g = Graph.from_pairs(spark, [(1, 2, 5), (1, 2, 3), (2, 2, 1)])
    assert rows(g.edges) == [(1, 2, 3)] and g.n == 3
    assert rows(Graph.from_pairs(spark, [(1, 2), (2, 1)], symmetrize=True).edges) == [(1, 2), (2, 1)]


def test_edge_set(small):
    assert (small.n, small.edge_count()) == (5, 7)
    assert rows(small.out_degrees()) == [(0, 0), (1, 3), (2, 2), (3, 1), (4, 1)]
    assert small.out_degree(1) == 3 and rows(small.neighbours(1)) == [(2,), (3,), (4,)]
    with pytest.raises(ValueError):
        small.relabel()
    with pytest.raises(ValueError):
        small.random_out_neighbour(0)
    assert small.random_out_neighbour(3) == 4


def test_edge_apply(small):
    zero = small.state(a=F.lit(0).cast("long"))
    total = lambda e, u: vertices.total(e.apply(zero, u), "a")
    assert total(EdgeSet(small), [Update("a", lambda s, d, w: F.lit(5), at="src")]) == 35
    start = vertices.add_vertex(vertices.add_vertex(vertices.new_vertex_set(small.spark, 0, 5), 0), 1)
    assert total(EdgeSet(small).from_(start), [Update("a", lambda s, d, w: F.lit(10), at="src")]) == 30
    state = vertices.set_at(vertices.set_at(zero, 4, "a", 10), 1, "a", 5)
    both = [Update("a", lambda s, d, w: F.lit(67), at="src"), Update("a", lambda s, d, w: F.lit(63))]
    less, more = (lambda s: s.a < 6), (lambda d: d.a > 9)
    # edges into vertex 4 from 1, 2 and 3
    assert vertices.total(EdgeSet(small).src_filter(less).dst_filter(more).apply(state, both), "a") == 15 + 3 * (67 + 63)
    assert vertices.largest(EdgeSet(small).apply(zero, [Update("a", lambda s, d, w: F.lit(1), at="src")]), "a") == 3
    with pytest.raises(ValueError):
        Update("a", lambda s, d, w: s.a, "avg")
    with pytest.raises(ValueError):
        vertices.new_vertex_set(small.spark, 2, 5)


def test_ranking(spark, small):
    error, rank = ranking.pagerank(small, 9).agg(F.sum("error"), F.sum("rank")).first()
    assert error == pytest.approx(0.00289518, rel=1e-4) and rank == pytest.approx(0.83)
    trace = []
    ranking.pagerank_delta(small, 4, trace=trace)
    assert [t[0] for t in trace] == [5, 3, 2, 1] and trace[0][1] == pytest.approx(0.566667, rel=1e-5)
    assert ranking.eigenvector_centrality(small).agg(F.sum("error")).first()[0] == pytest.approx(3.2)
    ratings = Graph.from_pairs(spark, [(1, 4, 3), (1, 5, 2), (2, 6, 1), (3, 4, 1)])
    assert ranking.collaborative_filtering(ratings, 1, 0.35, 0.001, 5).select(F.sum(F.col("latent")[0])).first()[0] == pytest.approx(7.49039, rel=1e-5)
    csr = Graph.from_csr(spark, [0, 3, 4, 5, 6], [1, 2, 3, 0, 0, 0], [4, 5, 6, 4, 5, 6])
    assert rows(paths.bellman_ford(csr, 0)[0]) == [(0, 0), (1, 4), (2, 5), (3, 6)]


@pytest.mark.parametrize("direction", ["SparsePush", "DensePull"])
def test_shortest_paths(mixed, direction):
    want = dijkstra(mixed, 0)
    hints = Hints(direction=direction)
    dist, negative = paths.bellman_ford(mixed, 0, hints)
    assert rows(dist) == want and not negative
    for delta in (3, 10**6):
        assert rows(paths.delta_stepping(mixed, 0, delta, hints)) == want


def test_point_to_point(spark, mixed):
    want = dict(dijkstra(mixed, 0))
    assert paths.point_to_point(mixed, 0, 4, 3) == want[4]
    where = spark.createDataFrame([(v, 0.0, v * 1e-12) for v in range(mixed.n)], "id long, lat double, lon double")
    assert paths.a_star(mixed, where, 0, 4, 2) == want[4]


def test_negative_cycle(spark):
    g = Graph.from_pairs(spark, [(0, 1, -2), (1, 0, 1)])
    assert paths.bellman_ford(g, 0)[1]


def test_bfs_and_closeness(spark, small, mixed):
    out = {}
    for s, d, _ in mixed.edges.collect():
        out.setdefault(s, set()).add(d)
    depth, queue = {0: 0}, deque([0])
    while queue:
        v = queue.popleft()
        for d in out.get(v, ()):
            if d not in depth:
                depth[d] = depth[v] + 1
                queue.append(d)
    for v, parent, own in rows(paths.bfs(mixed, 0)):
        assert own == depth.get(v, -1)
        assert parent == -1 if v not in depth else v == parent == 0 or (v in out[parent] and depth[parent] == own - 1)
    assert rows(paths.closeness(small, [1, 2, 3, 4])) == [(1, 3), (2, 2), (3, 3), (4, 3)]
    w = Graph.from_pairs(spark, [(1, 2, 1), (2, 1, 3), (4, 1, 1), (2, 4, 1), (1, 3, 6), (2, 3, 3), (3, 4, 4), (4, 3, 1)])
    assert paths.closeness_weighted(w, 3) == 15


def test_betweenness(mixed):
    out = {}
    for s, d, _ in mixed.edges.collect():
        out.setdefault(s, set()).add(d)
    depth, number, order = {3: 0}, {3: 1.0}, [3]
    for v in order:
        for d in out.get(v, ()):
            if d not in depth:
                depth[d] = depth[v] + 1
                number[d] = 0.0
                order.append(d)
            if depth[d] == depth[v] + 1:
                number[d] += number[v]
    dep = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for d in out.get(v, ()):
            if depth[d] == depth[v] + 1:
                dep[v] += number[v] / number[d] * (1 + dep[d])
    for v, score in rows(paths.betweenness(mixed, [3])):
        assert score == pytest.approx(dep.get(v, 0.0), abs=1e-6)


def test_structure(spark, small):
    s = Graph.from_pairs(spark, SMALL, symmetrize=True).persist()
    assert structure.triangle_count(s) == structure.triangle_count(s, False) == 4
    want = [(0, 0), (1, 3), (2, 3), (3, 3), (4, 3)]
    assert rows(structure.k_core(s)) == want == rows(structure.k_core_unordered(s))
    labels = [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert rows(structure.connected_components(s)) == labels == rows(structure.connected_components_jumping(s))
    assert structure.sweep_cut(small, small.vertices().select("id", F.col("id").alias("score"))).count() == 2
    chosen = {v for v, c in rows(structure.maximal_independent_set(s)) if c}
    pairs = set(rows(s.edges))
    assert all((a, b) not in pairs for a in chosen for b in chosen)
    assert all(v in chosen or any((v, c) in pairs for c in chosen) for v in range(5))


def test_set_cover(spark):
    g = Graph.from_pairs(spark, [(0, v) for v in range(3, 8)] + [(1, 8), (1, 9), (2, 3), (2, 8)])
    assert rows(structure.set_cover(g)) == [(0,), (1,)]


def test_spanning_trees(spark):
    # fixed values: edges and parents
    ring = Graph.from_pairs(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (1, 5, 3)], symmetrize=True)
    want = [(0, -1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(structure.minimum_spanning_tree(ring, 1)) == want
    assert rows(structure.minimum_spanning_tree(ring, 1, serial_edges=0)) == want
    other = Graph.from_pairs(spark, [(3, 4, 1), (4, 2, 2), (1, 2, 3), (1, 3, 4), (1, 4, 6), (2, 3, 6), (2, 4, 7), (2, 5, 4), (5, 6, 1)])
    parent = dict(rows(structure.minimum_spanning_tree(other, 1)))
    assert (parent[2], parent[3], parent[4]) == (1, 1, 3)
    with pytest.raises(ValueError):
        structure.minimum_spanning_tree(other, 1, serial_edges=3)
    rng = random.Random(6)  # with many ties both ways still give one tree
    tied = Graph.from_pairs(spark, [(rng.randrange(25), rng.randrange(25), rng.randint(1, 3)) for _ in range(90)], symmetrize=True)
    assert rows(structure.minimum_spanning_tree(tied, 0)) == rows(structure.minimum_spanning_tree(tied, 0, serial_edges=0))


def test_priority_queue(spark):
    queue = PriorityQueue(spark.range(5).select("id", (F.col("id") % 2).alias("p")), "p", all_in=True)
    assert queue.dequeue_ready_set().count() == 3 and queue.current_priority() == 0
    queue.replace(queue.state.withColumn("dirty", F.col("p") == 1))
    assert queue.dequeue_ready_set().count() == 2
    queue.replace(queue.state.withColumn("dirty", F.lit(False)))
    assert queue.finished() and queue.dequeue_ready_set() is None
    queue.rounds.release()


def test_hints_and_arguments():
    schedule = Schedule().config_apply_direction("s1", "DensePull").config_apply_priority_update_delta("s1", 4).set_apply("s1", "parallel")
    assert schedule.hints("s1").delta == 4 and schedule.hints("none") == Hints()
    with pytest.raises(ValueError):
        Schedule().config_apply_direction("s1", "Sideways")
    assert atoi("150 x") == 150 and atoi("x") == 0
    with pytest.raises(ValueError):
        argument(["a"], 1)


def test_formats(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return f"file://{path}"

    read = lambda path, **k: rows(readers.read_graph(spark, path, **k).edges)
    assert read(put("a.el", "0 1 \n1  2\n\n")) == [(0, 1), (1, 2)]
    assert read(put("a.gr", "c x\np sp 2 1\na 1 2 7\n")) == [(1, 2, 7)]
    assert read(put("a.graph", "% note\n3 2\n2 3\n1\n1\n")) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert read(put("b.graph", "2 1 1\n2 9\n1 9\n")) == [(0, 1, 9), (1, 0, 9)]
    assert read(put("a.mtx", "%%MatrixMarket matrix coordinate integer symmetric\n% c\n3 3 2\n2 1 5\n3 1 6\n")) == [(0, 1, 5), (0, 2, 6), (1, 0, 5), (2, 0, 6)]
    with pytest.raises(ValueError):
        readers.read_graph(spark, put("b.mtx", "%%MatrixMarket matrix coordinate real general\n2 3 1\n1 1 1\n"))
    assert read(put("adj", "AdjacencyGraph\n3\n3\n0\n2\n2\n1\n2\n0\n")) == [(0, 1), (0, 2), (2, 0)]
    assert read(put("wadj", "WeightedAdjacencyGraph\n2\n1\n0\n1\n1\n7\n")) == [(0, 1, 7)]
    assert read(put("a.tsv", "1\t2\t3\n")) == [(1, 2, 3)]
    body = struct.pack("<II", 0x150842A7, 2) + struct.pack("<ddI", 0.5, 1.5, 1) + struct.pack("<I", 1) + struct.pack("<d", 1e-6) + struct.pack("<ddI", 0.25, 1.25, 0)
    road = put("a.bin", body)
    assert read(road) == [(0, 1, 637)]
    assert rows(readers.road_coordinates(spark, road)) == [(0, 0.5, 1.5), (1, 0.25, 1.25)]
    csr = struct.pack("<?qq", True, 2, 2) + np.array([0, 1, 2], "<i8").tobytes()
    assert read(put("a.sg", csr + np.array([1, 0], "<i4").tobytes())) == [(0, 1), (1, 0)]
    assert read(put("a.wsg", csr + np.array([1, 5, 0, 6], "<i4").tobytes())) == [(0, 1, 5), (1, 0, 6)]
    with pytest.raises(ValueError):
        readers.read_graph(spark, "x.unknown")
    g = Graph.from_pairs(spark, WEIGHTED)
    writers.write_edge_list(g, f"file://{tmp_path}/out.wel")
    assert read(f"file://{tmp_path}/out.wel") == rows(g.edges)


def test_rounds_bound_the_plan(spark):
    """A round that reads its state four times leaves a plan of one scan, and figures come with the write."""
    keep = Rounds()
    df = spark.range(3)
    for _ in range(6):
        step = df.join(df.groupBy("id").count(), "id").join(df.select("id").distinct(), "id").join(df.withColumnRenamed("id", "x"), F.col("x") == F.col("id"))
        df = keep.keep(step.select((F.col("id") + 1).alias("id")), rows=F.count(F.lit(1)), top=F.max("id"))
        assert len(df._jdf.queryExecution().analyzed().toString().splitlines()) == 1
    assert keep.figures == {"rows": 3, "top": 8}
    assert rows(keep.release(df)) == [(6,), (7,), (8,)]
    assert rows(materialize(spark.range(2))) == [(0,), (1,)]


def test_cores_sets_and_covers(spark):
    """Against serial restatements, on a graph with a hub, a clique and a path."""
    rng = random.Random(8)
    pairs = [(a, b) for a in range(6) for b in range(a)] + [(10 + k, 11 + k) for k in range(8)] + [(20, k) for k in range(20)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(40)]
    g = Graph.from_pairs(spark, pairs, symmetrize=True)
    near = {v: set() for v in range(g.n)}
    for s, d in rows(g.edges):
        near[s].add(d)
    core, left, k = {}, {v: set(x) for v, x in near.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for x in left.pop(v):
            left[x].discard(v)
    assert dict(rows(structure.k_core(g))) == core == dict(rows(structure.k_core_unordered(g)))
    chosen = set()
    for v in sorted(near, key=lambda x: ((x * 7919) % 31, x)):
        if not near[v] & chosen:
            chosen.add(v)
    assert {i for i, c in rows(structure.maximal_independent_set(g, priority=(F.col("id") * 7919) % 31)) if c} == chosen
    cover = {i for (i,) in rows(structure.set_cover(g))}
    assert set().union(*(near[v] for v in cover)) == {v for v in near if near[v]}


def test_laid_out_edges_stay_where_they_are(spark):
    g = Graph(spark.range(2000).select(F.col("id").alias("src"), (F.col("id") * 7 % 2000).alias("dst")), 2000).laid_out()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        state = materialize(g.state(x=F.col("id")))
        plan = EdgeSet(g).messages(state, [Update("x", lambda s, d, w: s.x)])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one exchange for the state, one for the combined messages, none for the edges
    assert plan.count("Exchange hashpartitioning") == 2


def test_hybrid_directions():
    hybrid = Hints(direction="SparsePush-DensePull")
    assert hybrid.sparse(1, 1000) and not hybrid.sparse(900, 1000)
    other = Hints(direction="DensePull-SparsePush")
    assert other.sparse(1, 1000) and not other.sparse(900, 1000)
    assert Hints().sparse(900, 1000) and not Hints(direction="DensePull").sparse(1, 1000)
