"""Queries over graphs derived from the relational test tables, with DuckDB SQL for the same rows.

PC is the chain of parts within each order: consecutive lines' parts, weight the least quantity.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .algorithms import paths, ranking, structure
from .functions.order import global_rank, running_sums
from .functions.scalar import INT_MAX, atoi, fabs, floor, great_circle_cm, int_div, log, maximum, to_double, xor
from .graph import Graph, normalize
from .operators import primitives, vertices
from .operators.edges import EdgeSet, Update
from .operators.intersect import common_neighbours, intersect_neighbours, intersection_size
from .operators.ordered import PriorityQueue
from .plans.hints import DIRECTIONS, INTERSECTIONS, Hints, Schedule
from .runtime import materialize, scratch_path
from .sources import generators, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Roots and rounds of the queries below.
ROOT, TARGET, SOURCES, RELAXATIONS, LEVELS = 0, 7, [1, 2, 3, 4, 5, 6, 7, 8], 16, 8
#: Rounds of the SQL that repeats a fixpoint; more than the tables need.
CORE_ROUNDS, SET_ROUNDS, COVER_ROUNDS = 24, 24, 60

PC = """seq AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst, l_quantity AS q FROM lineitem),
e AS MATERIALIZED (SELECT src, dst, CAST(min(q) AS INTEGER) AS weight FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
v AS MATERIALIZED (SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) AS id)"""
PCS = PC + """, es AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY src, dst)"""
DEG = "deg AS MATERIALIZED (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"


def part_chain(spark: SparkSession, sf_dir: str, symmetrize: bool = False) -> Graph:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").cast("int").alias("weight")).where("dst is not null")
    # every plan below reads the edges several times; the window over all lines runs once
    return Graph(materialize(normalize(pairs, symmetrize), "edges"), undirected=symmetrize)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


# ---- edge set


@query(f"WITH {PC} SELECT * FROM e")
def edges_load(spark, sf):
    return part_chain(spark, sf).edges


@query(f"WITH {PC} SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e WHERE src = {ROOT}) AS root_degree")
def edges_counts(spark, sf):
    g = part_chain(spark, sf)
    return one_row(spark, n=g.n, m=g.edge_count(), root_degree=g.out_degree(ROOT))


@query(f"WITH {PC}, {DEG} SELECT * FROM deg")
def edges_out_degrees(spark, sf):
    return part_chain(spark, sf).out_degrees()


@query(f"WITH {PC} SELECT dst AS id FROM e WHERE src = {ROOT}")
def edges_neighbours(spark, sf):
    return part_chain(spark, sf).neighbours(ROOT)


@query(f"WITH {PC} SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM e GROUP BY src")
def edges_neighbour_lists(spark, sf):
    return part_chain(spark, sf).neighbour_lists().select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(f"WITH {PC} SELECT dst AS src, src AS dst, weight FROM e")
def edges_transpose(spark, sf):
    return part_chain(spark, sf).transpose().edges


@query(f"WITH {PCS} SELECT * FROM es")
def edges_symmetrize(spark, sf):
    return part_chain(spark, sf, True).edges


@query(f"""WITH {PCS}, d AS MATERIALIZED (SELECT v.id, count(es.src) AS n FROM v LEFT JOIN es ON es.src = v.id GROUP BY v.id),
r AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY n DESC, id DESC) - 1 AS k FROM d)
SELECT a.k AS src, b.k AS dst, weight FROM es JOIN r a ON a.id = es.src JOIN r b ON b.id = es.dst""")
def edges_relabel(spark, sf):
    return part_chain(spark, sf, True).relabel(True).edges


@query(f"WITH {PC} SELECT (SELECT count(DISTINCT src) FROM e) AS with_out, (SELECT count(DISTINCT dst) FROM e) AS with_in, (SELECT count(*) FROM e) AS m, 0::BIGINT AS no_edge")
def edges_random_neighbours(spark, sf):
    """Who gets a neighbour, and how many of those are none: draws themselves are hashed."""
    g = part_chain(spark, sf)
    out, into = g.random_out_neighbours(1), g.random_in_neighbours(1)
    picks = out.select(F.col("id").alias("src"), F.col("neighbour").alias("dst")).unionByName(into.select(F.col("neighbour").alias("src"), F.col("id").alias("dst")))
    return one_row(spark, with_out=_long(out.count()), with_in=_long(into.count()), m=_long(g.edge_count()), no_edge=_long(picks.join(g.edges, ["src", "dst"], "left_anti").count()))


@query(f"WITH {PC} SELECT v.id, count(e.src) AS degree, count(e.src) > 20 AS busy FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def edges_unsigned_degrees(spark, sf):
    return part_chain(spark, sf).out_degrees_unsigned().withColumn("busy", F.col("degree") > 20)


def _seven(g: Graph) -> DataFrame:
    return g.vertices().select("id", (F.col("id") % 7).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"))


@query(f"WITH {PC} SELECT v.id, v.id % 7 AS x, coalesce(sum((e.src % 7) * e.weight), 0)::BIGINT AS y, 0::BIGINT AS z FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def apply_sum_to_destination(spark, sf):
    g = part_chain(spark, sf)
    return EdgeSet(g).apply(_seven(g), [Update("y", lambda s, d, w: s.x * w)])


@query(f"""WITH {PC}, k AS (SELECT * FROM e WHERE src % 7 < 2 AND dst % 7 > 3)
SELECT v.id, v.id % 7 AS x, (67 * (SELECT count(*) FROM k WHERE k.src = v.id) + 63 * (SELECT count(*) FROM k WHERE k.dst = v.id))::BIGINT AS y, 0::BIGINT AS z FROM v""")
def apply_both_ends_filtered(spark, sf):
    g = part_chain(spark, sf)
    ends = [Update("y", lambda s, d, w: F.lit(67).cast("long"), at="src"), Update("y", lambda s, d, w: F.lit(63).cast("long"))]
    return EdgeSet(g).src_filter(lambda s: s.x < 2).dst_filter(lambda d: d.x > 3).apply(_seven(g), ends)


@query(f"""WITH {PC}, k AS (SELECT * FROM e WHERE src % 10 = 0 AND dst % 2 = 1)
SELECT v.id, v.id % 7 AS x, coalesce(max(k.weight), 0)::BIGINT AS y, coalesce(min(k.src), 0)::BIGINT AS z FROM v LEFT JOIN k ON k.dst = v.id GROUP BY v.id""")
def apply_from_set_to_set(spark, sf):
    g = part_chain(spark, sf)
    some, odd = g.vertices().where("id % 10 = 0"), g.vertices().where("id % 2 = 1")
    return EdgeSet(g).from_(some).to(odd).apply(_seven(g), [Update("y", lambda s, d, w: w, "max"), Update("z", lambda s, d, w: s.id, "set")])


@query(f"""WITH {PC}, m AS (SELECT dst AS id, min(src) AS s FROM e GROUP BY dst)
SELECT v.id, least(v.id, coalesce(m.s, v.id)) AS label, coalesce(m.s < v.id, false) AS active FROM v LEFT JOIN m USING (id)""")
def apply_modified_min(spark, sf):
    g = part_chain(spark, sf)
    state = g.vertices().select("id", F.col("id").alias("label"))
    return EdgeSet(g).apply_modified(state, [Update("label", lambda s, d, w: s.label, "min")], "label")


@query(f"WITH {PC} SELECT DISTINCT dst AS id FROM e WHERE weight > 45 AND src % 7 = 3")
def apply_returning_frontier(spark, sf):
    g = part_chain(spark, sf)
    return EdgeSet(g).apply_returning(_seven(g), lambda s, d, w: (w > 45) & (s.x == 3))


# ---- vertex sets, vectors, scalars


@query(f"""WITH {PC} SELECT (SELECT sum(CASE WHEN id = 5 THEN 105 WHEN id % 3 = 0 THEN id * 2 ELSE id END) FROM v)::BIGINT AS total,
(SELECT max(CASE WHEN id = 5 THEN 105 WHEN id % 3 = 0 THEN id * 2 ELSE id END) FROM v)::BIGINT AS largest, (SELECT count(*) FROM v WHERE id % 4 = 1) AS filtered, 4::BIGINT AS appended, true AS has_five""")
def vertex_sets(spark, sf):
    g = part_chain(spark, sf)
    state = vertices.apply(g.state(a=F.col("id")), {"a": F.col("a") * 2}, where=F.col("id") % 3 == 0)
    state = vertices.atomic_add(state, 5, "a", 100)
    chosen = vertices.new_vertex_set(spark, 0, g.n)
    for v in (0, 5, 5, 2):
        chosen = vertices.add_vertex(chosen, v)
    return one_row(spark, total=vertices.total(state, "a"), largest=vertices.largest(state, "a"), filtered=F.lit(vertices.size(vertices.where(state, F.col("id") % 4 == 1))).cast("long"), appended=F.lit(vertices.size(chosen)).cast("long"), has_five=vertices.contains(chosen, 5))


@query(f"WITH {PC} SELECT id, (id % 5) * 2 + 1 AS b, (id % 5) * 2 + 1 > 4 AS active FROM v")
def vertex_filter_that_assigns(spark, sf):
    g = part_chain(spark, sf)
    return vertices.where_update(g.state(b=F.col("id") % 5), {"b": F.col("b") * 2 + 1}, F.expr("b > 4"))


@query(f"WITH {PC} SELECT id, CASE WHEN id % 10 = 0 AND id % 4 < 2 THEN 100 + id ELSE id END AS a, id % 10 = 0 AND id % 3 = 0 AS hit FROM v")
def vertex_among(spark, sf):
    """Apply and filter on the members of a set (repeats do not matter)."""
    g = part_chain(spark, sf)
    some = g.vertices().where("id % 10 = 0")
    some = some.unionAll(some)
    state = vertices.apply(g.state(a=F.col("id")), {"a": lambda: F.col("a") + 100}, where=F.col("id") % 4 < 2, among=some)
    hits = vertices.where(state, F.col("id") % 3 == 0, among=some).withColumn("hit", F.lit(True))
    return state.join(hits, "id", "left").select("id", "a", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(f"WITH {PC} SELECT id, CASE WHEN id = 3 THEN 1 WHEN id = 4 THEN 8 WHEN id % 2 = 0 THEN 9 - id % 5 ELSE 9 END::BIGINT AS p, id % 2 = 0 AND id <> 4 OR id = 3 AS dirty FROM v")
def extern_updates(spark, sf):
    """A caller's own function lowers priorities and queues what it lowered; one element is then lowered alone."""
    g = part_chain(spark, sf)
    state = g.state(p=F.lit(9).cast("long"), dirty=F.lit(False))

    def lower(state: DataFrame, members: DataFrame) -> DataFrame:
        return vertices.apply(state, {"p": F.lit(9) - F.col("id") % 5}, among=members)

    even = g.vertices().where("id % 2 = 0")
    state = vertices.apply_update_priority_extern(state, even, lower, "p")
    state = state.withColumns({"dirty": F.col("dirty") | ((F.col("id") % 10 == 0) & (F.col("id") % 2 == 0)), "p": F.when(F.col("id") == 4, 9).otherwise(F.col("p")).cast("long")})
    state, changed = vertices.write_min(state, 3, "p", 1)
    state = state.withColumn("dirty", F.col("dirty") | ((F.col("id") == 3) & F.lit(changed)))
    state, _ = vertices.write_min(state, 4, "p", 8)
    return state.withColumn("dirty", F.when(F.col("id") == 4, False).otherwise(F.col("dirty")))


@query(f"WITH {PC} SELECT id % 5 AS bucket, count(*) AS n, id % 5 = 4 AS last FROM v GROUP BY id % 5")
def queue_protocol(spark, sf):
    """Ready sets in order of priority until the queue is finished."""
    g = part_chain(spark, sf)
    queue, seen = PriorityQueue(g.state(p=F.col("id") % 5), "p", all_in=True), []
    while not queue.finished():
        n = queue.dequeue_ready_set().count()
        queue.replace(queue.state.withColumn("dirty", F.col("dirty") & ~queue.ready()))
        seen.append((queue.current_priority(), n, queue.finished()))
    return spark.createDataFrame(seen, "bucket long, n long, last boolean")


def _schedules() -> list[Schedule]:
    """Every option once; none may change a row."""
    directions = [Schedule().config_apply_direction("s1", d) for d in DIRECTIONS]
    one = Schedule().config_apply_parallelization("s1", "edge-aware-dynamic-vertex-parallel", 64).config_apply_dense_vertex_set("s1", "bitvector").config_apply_num_ssg("s1", "fixed-vertex-count", 3).config_apply_numa("s1", "static-parallel")
    two = Schedule().config_apply_priority_update("s1", "eager_priority_update_with_merge").config_apply_priority_update_delta("s1", 3).config_bucket_merge_threshold("s1", 10).config_num_open_buckets("s1", 8).config_par_for_grain_size("s1", 16)
    old = Schedule().set_apply("s1", "pull").set_apply("s1", "num_segment", 2).set_apply("s1", "disable_deduplication").set_vertex_set("s1", "sparse").fuse_fields("s1", "x", "y").fuse_for_loop("s1", "a", "b").split_for_loop("s1", 1, 2).fuse_apply_functions("s1", "f", "g")
    return [*directions, one, two, old]


@query(f"WITH {PC} SELECT i::INTEGER AS schedule, v.id, coalesce(sum(e.weight), 0)::BIGINT AS y FROM (SELECT unnest(range({len(DIRECTIONS) + 3})) AS i) CROSS JOIN v LEFT JOIN e ON e.dst = v.id AND e.src % 3 = 0 GROUP BY i, v.id")
def schedules(spark, sf):
    g = part_chain(spark, sf)
    state = materialize(g.state(y=F.lit(0).cast("long"), active=F.col("id") % 3 == 0))
    out = None
    for i, schedule in enumerate(_schedules()):
        one = EdgeSet(g, schedule.hints("s1")).frontier(g.n // 3).apply(state, [Update("y", lambda s, d, w: w)]).select(F.lit(i).alias("schedule"), "id", "y")
        one = materialize(one, "schedule")  # a union of equal partitionings would do all schedules in one task
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PCS} SELECT a.kind, (SELECT count(*) FROM es x JOIN es y ON x.dst = y.dst WHERE x.src = 1 AND y.src = 2) AS common FROM (SELECT unnest({list(INTERSECTIONS)}) AS kind) a")
def intersection_schedules(spark, sf):
    g = part_chain(spark, sf, True)
    found = [(kind, intersect_neighbours(g, 1, 2)) for kind in INTERSECTIONS if Schedule().config_intersection("s1", kind).hints("s1").intersection == kind]
    return spark.createDataFrame(found, "kind string, common long")


@query("""SELECT c_custkey AS id, CAST(trunc((c_custkey - 40) / 7) AS BIGINT) AS q, round(ln(c_custkey + 1), 9) AS l, floor(c_acctbal)::BIGINT AS f, abs(c_acctbal) AS a,
CAST(greatest(trunc(c_acctbal), c_custkey) AS BIGINT) AS m, (c_custkey % 2 = 0) <> (c_custkey % 3 = 0) AS x, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS i FROM customer""")
def scalar_functions(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    digits = F.regexp_extract("c_name", "[0-9]+", 0)
    return c.select(k.alias("id"), int_div(k - 40, F.lit(7)).alias("q"), F.round(log(to_double(k + 1)), 9).alias("l"), floor(b).alias("f"), fabs(b).alias("a"), maximum(b, k).cast("long").alias("m"), xor(k % 2 == 0, k % 3 == 0).alias("x"), atoi(digits).alias("i"))


@query("""WITH p AS (SELECT s_suppkey AS id, radians((s_suppkey % 90)::DOUBLE) AS lat, radians((s_suppkey % 180)::DOUBLE) AS lon FROM supplier), h AS (SELECT id, sin(lat - 0.5) AS y, sin(lon - 1.0) AS x, lat FROM p),
a AS (SELECT id, y * y + x * x * cos(lat) * cos(0.5) AS a FROM h)
SELECT id, CAST(trunc(2 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))) * 637100000.0 / 1000) AS BIGINT) AS metres_10 FROM a""")
def great_circle(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    p = s.select("id", F.radians((F.col("id") % 90).cast("double")).alias("lat"), F.radians((F.col("id") % 180).cast("double")).alias("lon"))
    return p.select("id", int_div(great_circle_cm(F.col("lat"), F.col("lon"), F.lit(0.5), F.lit(1.0)).cast("long"), F.lit(1000)).alias("metres_10"))


# ---- intersections and primitives


@query(f"""WITH {PCS} SELECT a.src, a.dst, count(*) AS common FROM es a JOIN es b ON b.src = a.src JOIN es c ON c.src = a.dst AND c.dst = b.dst
WHERE a.dst < a.src AND b.dst <= a.dst GROUP BY a.src, a.dst""")
def intersect_bounded(spark, sf):
    g = part_chain(spark, sf, True)
    return common_neighbours(g, g.edges.where("dst < src"))


@query(f"""WITH {PC} SELECT (SELECT count(*) FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = 1 AND b.src = 2) AS pair,
(SELECT coalesce(sum(CASE WHEN a.dst <= 500 THEN 1 ELSE 0 END), 0) FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = 1 AND b.src = 2)::BIGINT AS bounded""")
def intersect_one_pair(spark, sf):
    g = part_chain(spark, sf)
    lists = g.neighbour_lists()
    one, two = lists.where("id = 1").select(F.col("neighbours").alias("a")), lists.where("id = 2").select(F.col("neighbours").alias("b"))
    pair = intersect_neighbours(g, 1, 2)
    # two rows meet
    return one.join(two).select(F.lit(pair).cast("long").alias("pair"), intersection_size(F.col("a"), F.col("b"), 500).cast("long").alias("bounded"))


@query(f"""WITH {PC} SELECT s.id, s.kept, r.value, c.value AS reached FROM (SELECT v.id, count(e.src) AS kept FROM v LEFT JOIN e ON e.src = v.id AND e.dst % 2 = 0 WHERE v.id % 3 = 0 GROUP BY v.id) s
JOIN (SELECT dst AS id, max(src)::BIGINT AS value FROM e GROUP BY dst) r USING (id) JOIN (SELECT dst AS id, count(*) AS value FROM e WHERE src % 3 = 0 GROUP BY dst) c USING (id)""")
def primitives_edge_map(spark, sf):
    g = part_chain(spark, sf)
    third = g.vertices().where("id % 3 = 0")
    counts, _ = primitives.edge_map_filter(g, third, lambda s, d, w: d.id % 2 == 0)
    best = primitives.edge_map_reduce(g, g.state(), lambda s, d, w: s.id, "max")
    reached = primitives.edge_map_count(primitives.edge_map_induced(g, third)).withColumnRenamed("value", "reached")
    return counts.withColumnRenamed("count", "kept").join(best, "id").join(reached, "id").select("id", "kept", "value", "reached")


# ---- algorithms


def _chain(first: str, step: Callable[[str], str], rounds: int, name: str = "r") -> str:
    """Unrolled rounds as materialised common tables; the last is named ``name`` and the number of rounds."""
    parts = [f"{name}0 AS MATERIALIZED ({first})"]
    parts += [f"{name}{i} AS MATERIALIZED ({step(f'{name}{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(parts)


def _pagerank_sql(rounds: int) -> str:
    step = lambda r: f"""SELECT o.id, n.new AS rank, abs(n.new - o.rank) AS error FROM {r} o JOIN (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(s.s, 0) AS new FROM v LEFT JOIN
(SELECT e.dst AS id, sum(p.rank / deg.degree) AS s FROM e JOIN {r} p ON p.id = e.src JOIN deg ON deg.id = e.src GROUP BY e.dst) s USING (id)) n USING (id)"""  # noqa: E731
    first = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank, 0.0::DOUBLE AS error FROM v"
    return f"WITH {PC}, {DEG}, {_chain(first, step, rounds)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(10))
def pagerank(spark, sf):
    return ranking.pagerank(part_chain(spark, sf), 10).select("id", F.round("rank", 9).alias("rank"))


def _delta_sql(rounds: int) -> str:
    n = "(SELECT count(*) FROM v)"
    sums = lambda r: f"SELECT e.dst AS id, sum(p.delta / deg.degree) AS s FROM e JOIN {r} p ON p.id = e.src AND p.active JOIN deg ON deg.id = e.src GROUP BY e.dst"

    def step(r: str) -> str:
        if r == "r0":
            inner = f"SELECT o.id, o.rank + (0.85 * coalesce(s, 0) + 0.15 / {n}) AS rank, 0.85 * coalesce(s, 0) + 0.15 / {n} - 1.0 / {n} AS delta"
        else:
            inner = "SELECT o.id, o.rank + 0.85 * coalesce(s, 0) AS rank, 0.85 * coalesce(s, 0) AS delta"
        return f"SELECT id, rank, delta, abs(delta) > 0.1 * rank AS active FROM ({inner} FROM {r} o LEFT JOIN ({sums(r)}) m USING (id))"

    first = f"SELECT id, 0.0::DOUBLE AS rank, 1.0::DOUBLE / {n} AS delta, true AS active FROM v"
    return f"WITH {PC}, {DEG}, {_chain(first, step, rounds)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_delta_sql(5))
def pagerank_delta(spark, sf):
    return ranking.pagerank_delta(part_chain(spark, sf), 5).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH {PC}, {_chain("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v", lambda r: f"SELECT v.id, coalesce(s.s, 0) AS x FROM v LEFT JOIN (SELECT e.dst AS id, sum(p.x) AS s FROM e JOIN {r} p ON p.id = e.src GROUP BY e.dst) s USING (id)", 5)}
SELECT id, round(x, 6) AS score FROM r5""")
def eigenvector_centrality(spark, sf):
    return ranking.eigenvector_centrality(part_chain(spark, sf), 5).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {PC} SELECT v.id, coalesce(sum(e.weight * (e.dst % 10)), 0)::DOUBLE AS value FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def spmv(spark, sf):
    g = part_chain(spark, sf)
    return ranking.spmv(g, g.state(value=(F.col("id") % 10).cast("double")))


def _cf_sql(rounds: int) -> str:
    sums = lambda r: f"SELECT e.dst AS id, sum(s.a * (e.weight - (s.a * d.a + s.b * d.b))) AS x, sum(s.b * (e.weight - (s.a * d.a + s.b * d.b))) AS y FROM e JOIN {r} s ON s.id = e.src JOIN {r} d ON d.id = e.dst GROUP BY e.dst"
    step = lambda r: f"SELECT o.id, o.a + 0.0001 * (coalesce(m.x, 0) - 0.001 * o.a) AS a, o.b + 0.0001 * (coalesce(m.y, 0) - 0.001 * o.b) AS b FROM {r} o LEFT JOIN ({sums(r)}) m USING (id)"
    return f"WITH {PC}, {_chain('SELECT id, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b FROM v', step, rounds)} SELECT id, round(a, 8) AS a, round(b, 8) AS b FROM r{rounds}"


@query(_cf_sql(3))
def collaborative_filtering(spark, sf):
    out = ranking.collaborative_filtering(part_chain(spark, sf), 2, 0.0001, 0.001, 3)
    return out.select("id", F.round(F.col("latent")[0], 8).alias("a"), F.round(F.col("latent")[1], 8).alias("b"))


_REACH = f"""reach AS (SELECT {ROOT}::BIGINT AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM reach JOIN e ON e.src = reach.id WHERE depth < {LEVELS}),
dep AS MATERIALIZED (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"""


@query(f"""WITH RECURSIVE {PC}, {_REACH}, p AS (SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN dep a ON a.id = e.src JOIN dep b ON b.id = e.dst AND b.depth = a.depth + 1 GROUP BY e.dst)
SELECT v.id, CASE WHEN v.id = {ROOT} THEN {ROOT} ELSE coalesce(p.parent, -1) END::BIGINT AS parent, coalesce(dep.depth, -1) AS depth FROM v LEFT JOIN dep USING (id) LEFT JOIN p USING (id)""")
def bfs(spark, sf):
    return paths.bfs(part_chain(spark, sf), ROOT)


_SSSP = _chain(f"SELECT id, CASE WHEN id = {ROOT} THEN 0 ELSE {INT_MAX} END::BIGINT AS dist FROM v", lambda r: f"SELECT o.id, least(o.dist, coalesce(m.d, {INT_MAX}))::BIGINT AS dist FROM {r} o LEFT JOIN (SELECT e.dst AS id, min(p.dist + e.weight) AS d FROM e JOIN {r} p ON p.id = e.src AND p.dist < {INT_MAX} GROUP BY e.dst) m USING (id)", RELAXATIONS)


@query(f"WITH {PC}, {_SSSP} SELECT * FROM r{RELAXATIONS}")
def bellman_ford(spark, sf):
    return paths.bellman_ford(part_chain(spark, sf), ROOT, Hints(direction="DensePull"))[0]


@query(f"WITH {PC}, {_SSSP} SELECT * FROM r{RELAXATIONS}")
def delta_stepping(spark, sf):
    return paths.delta_stepping(part_chain(spark, sf), ROOT, 8)


@query(f"WITH {PC}, {_SSSP} SELECT {ROOT}::BIGINT AS source, {TARGET}::BIGINT AS target, dist FROM r{RELAXATIONS} WHERE id = {TARGET}")
def point_to_point(spark, sf):
    return one_row(spark, source=F.lit(ROOT).cast("long"), target=F.lit(TARGET).cast("long"), dist=F.lit(paths.point_to_point(part_chain(spark, sf), ROOT, TARGET, 4)).cast("long"))


@query(f"WITH {PC}, {_SSSP} SELECT {TARGET}::BIGINT AS target, dist FROM r{RELAXATIONS} WHERE id = {TARGET}")
def a_star(spark, sf):
    g = part_chain(spark, sf)
    # estimates of 0 or 1 cm however many vertices there are: admissible and consistent for weights of 1 and more
    where = g.vertices().select("id", F.lit(0.0).alias("lat"), (F.col("id") * (2e-9 / max(g.n, 1))).alias("lon"))
    return one_row(spark, target=F.lit(TARGET).cast("long"), dist=F.lit(paths.a_star(g, where, ROOT, TARGET, 4)).cast("long"))


@query(f"WITH {PC}, {_SSSP} SELECT {ROOT}::BIGINT AS source, sum(dist)::BIGINT AS score FROM r{RELAXATIONS} WHERE dist < {INT_MAX}")
def closeness_weighted(spark, sf):
    return one_row(spark, source=F.lit(ROOT).cast("long"), score=F.lit(paths.closeness_weighted(part_chain(spark, sf), ROOT)).cast("long"))


_RUNS = f"""reach AS (SELECT s::BIGINT AS run, s::BIGINT AS id, 0 AS depth FROM (SELECT unnest({SOURCES}) AS s) UNION SELECT run, e.dst, depth + 1 FROM reach JOIN e ON e.src = reach.id WHERE depth < {LEVELS}),
dep AS MATERIALIZED (SELECT run, id, min(depth) AS depth FROM reach GROUP BY run, id)"""


@query(f"WITH RECURSIVE {PC}, {_RUNS} SELECT run AS id, sum(depth)::BIGINT AS score FROM dep GROUP BY run")
def closeness(spark, sf):
    return paths.closeness(part_chain(spark, sf), SOURCES)


def _betweenness_sql(sources: list[int], normalize: bool) -> str:
    runs = _RUNS.replace(str(SOURCES), str(sources))
    level = "l AS MATERIALIZED (SELECT a.run, e.src, e.dst, a.depth AS d FROM e JOIN dep a ON a.id = e.src JOIN dep b ON b.run = a.run AND b.id = e.dst AND b.depth = a.depth + 1)"
    forward, backward = [], []
    forward.append("p0 AS MATERIALIZED (SELECT run, id, depth, CASE WHEN depth = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS paths FROM dep)")
    for i in range(LEVELS):
        forward.append(f"p{i + 1} AS MATERIALIZED (SELECT o.run, o.id, o.depth, o.paths + coalesce(m.s, 0) AS paths FROM p{i} o LEFT JOIN (SELECT l.run, l.dst AS id, sum(p.paths) AS s FROM l JOIN p{i} p ON p.run = l.run AND p.id = l.src WHERE l.d = {i} GROUP BY l.run, l.dst) m ON m.run = o.run AND m.id = o.id)")
    backward.append(f"q{LEVELS} AS MATERIALIZED (SELECT run, id, paths, 1.0 / paths AS dep FROM p{LEVELS})")
    for i in range(LEVELS - 1, -1, -1):
        backward.append(f"q{i} AS MATERIALIZED (SELECT o.run, o.id, o.paths, o.dep + coalesce(m.s, 0) AS dep FROM q{i + 1} o LEFT JOIN (SELECT l.run, l.src AS id, sum(q.dep) AS s FROM l JOIN q{i + 1} q ON q.run = l.run AND q.id = l.dst WHERE l.d = {i} GROUP BY l.run, l.src) m ON m.run = o.run AND m.id = o.id)")
    own = "f AS MATERIALIZED (SELECT v.id, coalesce(sum((q0.dep - 1.0 / q0.paths) * q0.paths), 0) AS score FROM v LEFT JOIN q0 USING (id) GROUP BY v.id)"
    score = "score / (SELECT max(score) FROM f)" if normalize else "score"
    return f"WITH RECURSIVE {PC}, {runs}, {level}, {', '.join(forward)}, {', '.join(backward)}, {own} SELECT id, round({score}, 6) AS score FROM f"


@query(_betweenness_sql([ROOT], False))
def betweenness(spark, sf):
    return paths.betweenness(part_chain(spark, sf), [ROOT]).select("id", F.round("score", 6).alias("score"))


@query(_betweenness_sql(SOURCES, True))
def betweenness_many_sources(spark, sf):
    return paths.betweenness(part_chain(spark, sf), SOURCES, True).select("id", F.round("score", 6).alias("score"))


_CC = _chain("SELECT id, id AS label FROM v", lambda r: f"SELECT o.id, least(o.label, coalesce(m.l, o.label)) AS label FROM {r} o LEFT JOIN (SELECT es.dst AS id, min(p.label) AS l FROM es JOIN {r} p ON p.id = es.src GROUP BY es.dst) m USING (id)", RELAXATIONS)


@query(f"WITH {PCS}, {_CC} SELECT * FROM r{RELAXATIONS}")
def connected_components(spark, sf):
    return structure.connected_components(part_chain(spark, sf, True))


@query(f"WITH {PCS}, {_CC} SELECT * FROM r{RELAXATIONS}")
def connected_components_jumping(spark, sf):
    return structure.connected_components_jumping(part_chain(spark, sf, True))


_TC = f"WITH {PCS} SELECT count(*) AS triangles FROM es a JOIN es b ON b.src = a.src JOIN es c ON c.src = a.dst AND c.dst = b.dst WHERE a.dst < a.src AND b.dst < a.dst"


@query(_TC)
def triangle_count(spark, sf):
    return one_row(spark, triangles=F.lit(structure.triangle_count(part_chain(spark, sf, True))).cast("long"))


@query(_TC)
def triangle_count_by_id(spark, sf):
    return one_row(spark, triangles=F.lit(structure.triangle_count(part_chain(spark, sf, True), False)).cast("long"))


def _h_index(r: str) -> str:
    """One round: the h-index of the neighbours' numbers, capped by the own one."""
    counts = f"SELECT es.dst AS id, p.core AS x, count(*) AS n FROM es JOIN {r} p ON p.id = es.src GROUP BY es.dst, p.core"
    own = f"SELECT id, max(least(x, c)) AS h FROM (SELECT id, x, sum(n) OVER (PARTITION BY id ORDER BY x DESC) AS c FROM ({counts})) GROUP BY id"
    return f"SELECT o.id, least(o.core, coalesce(h.h, 0))::BIGINT AS core FROM {r} o LEFT JOIN ({own}) h USING (id)"


_CORES = f"WITH {PCS}, {_chain('SELECT v.id, count(es.src) AS core FROM v LEFT JOIN es ON es.src = v.id GROUP BY v.id', _h_index, CORE_ROUNDS)} SELECT * FROM r{CORE_ROUNDS}"


@query(_CORES)
def k_core(spark, sf):
    return structure.k_core(part_chain(spark, sf, True))


@query(_CORES)
def k_core_unordered(spark, sf):
    return structure.k_core_unordered(part_chain(spark, sf, True))


def _independent(r: str) -> str:
    first = f"SELECT es.dst AS id, min(s.p) AS m FROM es JOIN {r} s ON s.id = es.src AND s.open GROUP BY es.dst"
    fresh = f"SELECT o.id FROM {r} o LEFT JOIN ({first}) f USING (id) WHERE o.open AND (f.m IS NULL OR o.p < f.m)"
    return f"""SELECT o.id, o.p, o.chosen OR o.id IN ({fresh}) AS chosen,
o.open AND o.id NOT IN ({fresh}) AND o.id NOT IN (SELECT dst FROM es WHERE src IN ({fresh})) AS open FROM {r} o"""


# priorities that differ: the rank modulo a prime, then the id
@query(f"WITH {PCS}, {_chain('SELECT id, ((id * 7919) % 10007) * 1000000000 + id AS p, false AS chosen, true AS open FROM v', _independent, SET_ROUNDS)} SELECT id, chosen FROM r{SET_ROUNDS}")
def maximal_independent_set(spark, sf):
    return structure.maximal_independent_set(part_chain(spark, sf, True), priority=(F.col("id") * 7919) % 10007 * 1000000000 + F.col("id"))


@query(f"WITH {PCS} SELECT (SELECT count(*) FROM v) AS vertices, 0::BIGINT AS linked, 0::BIGINT AS uncovered")
def independent_set_hashed(spark, sf):
    """With hashed priorities: no two members are neighbours, and every other vertex has one."""
    g = part_chain(spark, sf, True)
    state = materialize(structure.maximal_independent_set(g, 3))
    members = state.where("chosen").select("id")
    linked = EdgeSet(g).from_(members).to(members).rows(None)[0].count()
    reached = EdgeSet(g).from_(members).apply_returning(None, lambda s, d, w: F.lit(True))
    return one_row(spark, vertices=_long(g.n), linked=_long(linked), uncovered=_long(state.where("not chosen").join(reached, "id", "left_anti").count()))


@query(f"WITH {PCS}, {_chain('SELECT id, id AS label FROM v', lambda r: f'SELECT o.id, least(o.label, coalesce(m.l, o.label)) AS label FROM {r} o LEFT JOIN (SELECT es.dst AS id, min(p.label) AS l FROM es JOIN {r} p ON p.id = es.src GROUP BY es.dst) m USING (id)', RELAXATIONS)} SELECT count(*) FILTER (label = {ROOT}) AS reached, count(*) FILTER (label = {ROOT}) - 1 AS tree_edges, 0::BIGINT AS not_an_edge, 0::BIGINT AS shorter_by_exchange FROM r{RELAXATIONS}")
def minimum_spanning_tree(spark, sf):
    """The tree by its properties: it reaches the root's component with edges of the graph, and no edge of the
    graph is lighter than any on the tree's path between its ends (so no exchange helps)."""
    g = part_chain(spark, sf, True)
    tree = materialize(structure.minimum_spanning_tree(g, ROOT)).where("parent >= 0")
    own = tree.where("id <> parent").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    weighted = materialize(own.join(g.edges, ["src", "dst"]))
    worse = structure.lighter_than_path(g, weighted).count()
    return one_row(spark, reached=_long(tree.count()), tree_edges=_long(own.count()), not_an_edge=_long(own.count() - weighted.count()), shorter_by_exchange=_long(worse))


def _cover_sql(rounds: int) -> str:
    """A round of the cover with buckets of powers of two."""
    parts = [f"WITH {PCS}, t0 AS MATERIALIZED (SELECT src, dst FROM es)"]
    for i in range(rounds):
        parts.append(f"n{i} AS MATERIALIZED (SELECT src, floor(log2(count(*)))::BIGINT AS b FROM t{i} GROUP BY src)")
        parts.append(f"k{i} AS MATERIALIZED (SELECT dst, min(t.src) AS src, any_value(b) AS b FROM t{i} t JOIN n{i} n ON n.src = t.src AND b = (SELECT max(b) FROM n{i}) GROUP BY dst)")
        parts.append(f"w{i} AS MATERIALIZED (SELECT src FROM k{i} GROUP BY src, b HAVING count(*) >= greatest(ceil(pow(2, b - 1)), 1))")
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT src, dst FROM t{i} WHERE dst NOT IN (SELECT dst FROM k{i} WHERE src IN (SELECT src FROM w{i})) AND src NOT IN (SELECT src FROM w{i}))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT src AS id FROM w{i}" for i in range(rounds))


@query(_cover_sql(COVER_ROUNDS))
def set_cover(spark, sf):
    return structure.set_cover(part_chain(spark, sf, True), 1.0)


@query(f"""WITH {PCS}, r AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY (id * 7919) % 1009 DESC, id) - 1 AS rank FROM v),
per AS (SELECT a.rank, count(*) AS vol, sum(CASE WHEN b.rank < a.rank THEN -1 ELSE 1 END) AS cr FROM es JOIN r a ON a.id = es.src JOIN r b ON b.id = es.dst GROUP BY a.rank),
s AS (SELECT r.rank, sum(coalesce(vol, 0)) OVER (ORDER BY r.rank) AS vol, sum(coalesce(cr, 0)) OVER (ORDER BY r.rank) AS cr FROM r LEFT JOIN per USING (rank)),
c AS (SELECT rank, CASE WHEN cr = 0 OR least(vol, (SELECT count(*) FROM es) - vol) = 0 THEN 1.0 ELSE cr::DOUBLE / least(vol, (SELECT count(*) FROM es) - vol) END AS c FROM s)
SELECT id, rank FROM r WHERE rank < (SELECT rank FROM c ORDER BY c, rank LIMIT 1)""")
def sweep_cut(spark, sf):
    g = part_chain(spark, sf, True)
    return structure.sweep_cut(g, g.vertices().select("id", ((F.col("id") * 7919) % 1009).alias("score")))


# ---- sources and sinks


@query(f"WITH {PC} SELECT * FROM e")
def source_edge_list(spark, sf):
    path = scratch_path(spark, "wel") + ".wel"
    writers.write_edge_list(part_chain(spark, sf), path)
    return readers.read_graph(spark, path).edges


def _written(spark: SparkSession, lines: DataFrame, suffix: str) -> str:
    """A folder of text files, one a partition: readers take them in order of their names."""
    path = scratch_path(spark, "graph") + suffix
    lines.write.text(path)
    return path


@query(f"WITH {PC} SELECT * FROM e")
def source_dimacs(spark, sf):
    return readers.read_graph(spark, _written(spark, part_chain(spark, sf).edges.select(F.concat_ws(" ", F.lit("a"), "src", "dst", "weight")), ".gr")).edges


@query(f"WITH {PC} SELECT * FROM e")
def source_parquet(spark, sf):
    path = scratch_path(spark, "edges") + ".parquet"
    writers.write_parquet(part_chain(spark, sf), path)
    return readers.read_graph(spark, path).edges


@query(f"WITH {PC} SELECT * FROM e")
def source_tsv(spark, sf):
    return readers.read_graph(spark, _written(spark, part_chain(spark, sf).edges.select(F.concat_ws("\t", "src", "dst", "weight")), ".tsv")).edges


def _file(spark: SparkSession, data: bytes, suffix: str) -> str:
    """A file of the shared folder with these bytes."""
    path = scratch_path(spark, "graph") + suffix
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()
    return path


@query(f"WITH {PC} SELECT src, dst FROM e")
def source_el(spark, sf):
    return readers.read_graph(spark, _written(spark, part_chain(spark, sf).edges.select(F.concat_ws("  ", "src", "dst")), ".el")).edges


@query(f"WITH {PC} SELECT src, dst, weight FROM e")
def source_metis(spark, sf):
    """Header, a comment, then a line of neighbours and weights for each vertex."""
    g = part_chain(spark, sf)
    own = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "weight"))), lambda x: F.concat_ws(" ", x["dst"] + 1, x["weight"])), " ").alias("t"))
    lines = g.vertices().join(own, "id", "left").select("id", F.coalesce("t", F.lit("")).alias("t"))
    head = spark.createDataFrame([(-2, "% a comment"), (-1, f"{g.n} {g.edge_count()} 1")], "id long, t string")
    return readers.read_graph(spark, _written(spark, head.unionByName(lines).orderBy("id").select("t"), ".graph")).edges


@query(f"WITH {PC} SELECT src, dst, weight FROM e")
def source_matrix_market(spark, sf):
    g = part_chain(spark, sf)
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), ("% a comment",), (f"{g.n} {g.n} {g.edge_count()}",)], "t string").coalesce(1)
    # the header's partition comes first, so its file does
    lines = head.unionByName(g.edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "weight").alias("t")))
    return readers.read_graph(spark, _written(spark, lines, ".mtx")).edges


@query(f"WITH {PC} SELECT src, dst, weight FROM e")
def source_adjacency(spark, sf):
    """Name, vertices, edges, offsets, targets, weights; one number a line."""
    g = part_chain(spark, sf)
    placed = materialize(global_rank(g.edges, "src", "dst", name="k"))
    offsets = running_sums(g.out_degrees().select("id", F.col("degree").alias("upto"), F.col("degree").alias("own")), "id", ["upto"])
    part = lambda df, i, k, t: df.select(F.lit(i).alias("i"), F.col(k).cast("long").alias("k"), F.col(t).cast("string").alias("t"))
    lines = spark.createDataFrame([(0, 0, "WeightedAdjacencyGraph"), (0, 1, str(g.n)), (0, 2, str(g.edge_count()))], "i int, k long, t string")
    for more in (part(offsets.withColumn("begin", F.col("upto") - F.col("own")), 1, "id", "begin"), part(placed, 2, "k", "dst"), part(placed, 3, "k", "weight")):
        lines = lines.unionByName(more)
    return readers.read_graph(spark, _written(spark, lines.orderBy("i", "k").select("t"), "")).edges


#: Binary formats are tried on the edges among so many vertices: the driver makes the file.
BINARY_IDS = 500


def _few(spark: SparkSession, sf: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, src, dst, weight) of the chain's edges among the first vertices, sorted."""
    rows = part_chain(spark, sf).edges.where(f"src < {BINARY_IDS} and dst < {BINARY_IDS}").orderBy("src", "dst").toPandas()
    src = rows["src"].to_numpy()
    return np.searchsorted(src, np.arange(BINARY_IDS + 1)), src, rows["dst"].to_numpy(), rows["weight"].to_numpy()


_FEW = f"WITH {PC} SELECT src, dst{{}} FROM e WHERE src < {BINARY_IDS} AND dst < {BINARY_IDS}"


def _serialized(offsets: np.ndarray, rows: np.ndarray) -> bytes:
    return b"\x01" + np.array([len(rows), len(offsets) - 1], "<i8").tobytes() + offsets.astype("<i8").tobytes() + rows.astype("<i4").tobytes()


@query(_FEW.format(""))
def source_sg(spark, sf):
    offsets, _, dst, _ = _few(spark, sf)
    return readers.read_graph(spark, _file(spark, _serialized(offsets, dst), ".sg")).edges


@query(_FEW.format(", weight"))
def source_wsg(spark, sf):
    offsets, _, dst, weight = _few(spark, sf)
    return readers.read_graph(spark, _file(spark, _serialized(offsets, np.stack([dst, weight], axis=1)), ".wsg")).edges


@query(_FEW.format(""))
def source_csr_arrays(spark, sf):
    offsets, _, dst, _ = _few(spark, sf)
    return Graph.from_csr(spark, offsets, dst).edges


def _road_file(spark: SparkSession, sf: str) -> str:
    offsets, _, dst, weight = _few(spark, sf)
    out = [np.array([readers.ROAD_MAGIC, BINARY_IDS], "<u4").tobytes()]
    for v in range(BINARY_IDS):
        a, b = offsets[v], offsets[v + 1]
        out += [np.array([v / 1000, v / 500], "<f8").tobytes(), np.array([b - a], "<u4").tobytes(), dst[a:b].astype("<u4").tobytes(), ((weight[a:b] + 0.5) / readers.ROAD_CM).astype("<f8").tobytes()]
    return _file(spark, b"".join(out), ".bin")


@query(_FEW.format(", weight"))
def source_road(spark, sf):
    return readers.read_graph(spark, _road_file(spark, sf)).edges


@query(f"SELECT i AS id, i / 1000.0::DOUBLE AS lat, i / 500.0::DOUBLE AS lon FROM (SELECT unnest(range({BINARY_IDS})) AS i)")
def source_road_coordinates(spark, sf):
    return readers.road_coordinates(spark, _road_file(spark, sf))


def _generated(spark: SparkSession, graph: Graph, most: int) -> DataFrame:
    """What every generated graph has: both directions of each edge, once, no loops, ids in range."""
    e = materialize(graph.edges.select("src", "dst"))
    return one_row(
        spark, n=_long(graph.n), loops=_long(e.where("src = dst").count()), repeats=_long(e.count() - e.distinct().count()),
        one_way=_long(e.join(e.selectExpr("dst src", "src dst"), ["src", "dst"], "left_anti").count()),
        outside=_long(e.where(f"src < 0 or dst < 0 or src >= {graph.n} or dst >= {graph.n}").count()), within=F.lit(most // 2 < e.count() <= most),
    )


_GENERATED = "SELECT 1024::BIGINT AS n, 0::BIGINT AS loops, 0::BIGINT AS repeats, 0::BIGINT AS one_way, 0::BIGINT AS outside, true AS within"


@query(_GENERATED)
def source_uniform(spark, sf):
    return _generated(spark, generators.uniform(spark, 10, 8), 16 << 10)


@query(_GENERATED)
def source_rmat(spark, sf):
    return _generated(spark, generators.rmat(spark, 10, 8), 16 << 10)


@query(f"WITH {PCS} SELECT count(*) AS m, 0::BIGINT AS outside, 0::BIGINT AS differ FROM es")
def random_weights(spark, sf):
    """Weights of 1 to 255, the same for both directions of an edge."""
    e = materialize(generators.random_weights(part_chain(spark, sf, True).edges))
    back = e.selectExpr("dst src", "src dst", "weight back")
    return one_row(spark, m=_long(e.count()), outside=_long(e.where("weight < 1 or weight > 255").count()), differ=_long(e.join(back, ["src", "dst"]).where("weight <> back").count()))
