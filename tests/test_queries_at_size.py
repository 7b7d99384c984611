"""Queries on made lineitem tables: large ids, files in parts, trees checked by every weight."""

import pytest

from tidegraph import queries
from tidegraph.algorithms import paths, structure
from tidegraph.graph import Graph
from tidegraph.plans import loop
from tidegraph.plans.hints import Hints
from tidegraph.plans.loop import Rounds
from tidegraph.runtime import materialize


def lines(spark, path, chains):
    """A lineitem table whose orders hold these chains of (part, quantity)."""
    rows = [(o, n, part, 1, float(q)) for o, chain in enumerate(chains) for n, (part, q) in enumerate(chain)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"file://{path}/lineitem.parquet")
    return f"file://{path}"


def test_a_star_with_large_ids(spark, tmp_path):
    """The short way leads over a large id: its estimate must not exceed the way that is left."""
    sf = lines(spark, tmp_path, [[(0, 50), (7, 1)], [(0, 1), (1_500_000, 1), (7, 1)]])
    assert queries.a_star(spark, sf).first()["dist"] == 2


def test_spanning_tree_of_a_long_path(spark, monkeypatch):
    """Rounds do not follow the tree's depth: neither on a path, nor with two unreached vertices beside it."""
    g = Graph.from_pairs(spark, [(i, i + 1, 1 + i % 3) for i in range(150)] + [(0, 150, 9), (152, 153, 1)], symmetrize=True)
    count, keep = [0], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, *a, **k: (count.__setitem__(0, count[0] + 1), keep(self, *a, **k))[1])
    got = dict(structure.minimum_spanning_tree(g, 40, serial_edges=0).collect())
    assert got == {v: 40 if v == 40 else v + 1 if v < 40 else v - 1 if v <= 150 else -1 for v in range(154)}
    assert count[0] < 100


def test_every_exchange_counts(spark, monkeypatch):
    """A tree with one heavy edge too many is seen, whatever the weight."""
    g = Graph.from_pairs(spark, [(0, 1, 10), (1, 2, 20), (0, 2, 30), (2, 3, 45), (1, 3, 44), (4, 5, 1)], symmetrize=True)
    tree = lambda *e: spark.createDataFrame(e, "src long, dst long, weight int")
    light = lambda *e: sorted(map(tuple, structure.lighter_than_path(g, tree(*e)).collect()))
    assert light((0, 1, 10), (1, 2, 20), (1, 3, 44)) == []
    assert light((0, 1, 10), (1, 2, 20), (2, 3, 45)) == [(1, 3, 44)]
    assert light((1, 2, 20), (0, 2, 30), (1, 3, 44)) == [(0, 1, 10)]


def test_the_query_sees_a_heavy_tree(spark, tmp_path, monkeypatch):
    sf = lines(spark, tmp_path, [[(0, 10), (1, 1)], [(1, 20), (2, 1)], [(0, 30), (2, 1)]])
    bad = spark.createDataFrame([(0, 0), (2, 0), (1, 2)], "id long, parent long")
    monkeypatch.setattr(structure, "minimum_spanning_tree", lambda g, root: bad)
    assert queries.minimum_spanning_tree(spark, sf).first()["shorter_by_exchange"] == 1


FORMATS = ["source_adjacency", "source_matrix_market", "source_dimacs", "source_tsv", "source_el", "source_metis"]


@pytest.mark.parametrize("name", FORMATS)
def test_formats_in_many_files(spark, tmp_path, monkeypatch, name):
    """No task writes or reads a whole graph; the files are read in order."""
    chains = [[((o * 17 + n * n) % 90, 1 + (o + n) % 5) for n in range(6)] for o in range(300)]
    sf = lines(spark, tmp_path, chains)
    paths, written = [], queries._written
    monkeypatch.setattr(queries, "_written", lambda *a: paths.append(written(*a)) or paths[-1])
    monkeypatch.setattr(queries, "part_chain", lambda *a, made=queries.part_chain(spark, sf): Graph(made.edges.repartition(5, "src", "dst")))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        got = sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()))
    finally:
        spark.conf.set(conf, before)
    want = queries.part_chain().edges
    assert got == sorted(map(tuple, (want.select("src", "dst") if name == "source_el" else want).collect()))
    assert len(spark.read.text(paths[0]).inputFiles()) > 1


def test_segments_are_dealt_over_many_tasks(spark):
    edges = Hints(segments=3).spread(spark.range(5000).selectExpr("id src", "id dst"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        wide = Hints(segments=3).spread(spark.range(5000).selectExpr("id src", "id dst"))
        assert wide.rdd.getNumPartitions() == 12 and edges.count() == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_betweenness_writes_a_vertex_a_few_times(spark, monkeypatch):
    """On a path of 12 levels no level is written anew for each other one."""
    rows, real = [0], materialize

    def counted(df, name="step"):
        out = real(df, name)
        rows[0] += out.count()
        return out

    monkeypatch.setattr(paths, "materialize", counted)
    monkeypatch.setattr(loop, "materialize", counted)
    got = dict(paths.betweenness(Graph.from_pairs(spark, [(i, i + 1) for i in range(11)]), [0, 0]).collect())
    assert got == {v: 11.0 - v for v in range(12)}
    assert rows[0] <= 3 * 12


def test_triangles_of_hubs_and_cliques(spark):
    """Against counting by hand; it holds for the former plan too, whose wedges were shuffled one by one."""
    pairs = [(a, b) for a in range(9) for b in range(a)] + [(20, k) for k in range(19)] + [(k, k + 1) for k in range(9, 18)]
    g = Graph.from_pairs(spark, pairs, symmetrize=True)
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in range(21)}
    want = sum(1 for a in near for b in near[a] for c in near[a] & near[b] if a < b < c)
    assert structure.triangle_count(g) == structure.triangle_count(g, False) == want
    assert structure.triangle_count(Graph.from_pairs(spark, [(0, 1)], symmetrize=True)) == 0
