"""Graphs as DataFrames of edges, and the edge-set operators that need no vertex state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.order import global_rank
from .runtime import scratch_path


def normalize(edges: DataFrame, symmetrize: bool = False) -> DataFrame:
    """Both directions if asked; no self-loops; of repeated edges one, with the smallest weight."""
    weighted = "weight" in edges.columns
    if symmetrize:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if weighted else [])))
    edges = edges.where("src <> dst")
    return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if weighted else edges.distinct()


class Graph:
    """An edge set (src, dst[, weight]) over the vertices 0 .. n - 1."""

    def __init__(self, edges: DataFrame, n: int | None = None, undirected: bool = False):
        weighted = "weight" in edges.columns
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *([F.col("weight").cast("int").alias("weight")] if weighted else []))
        self.weighted, self.undirected, self._n, self.placed = weighted, undirected, n, False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def n(self) -> int:
        """Number of vertices: given, or one more than the largest id (0 without edges)."""
        if self._n is None:
            top = self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            self._n = 0 if top is None else top + 1
        return self._n

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: list[tuple], symmetrize: bool = False, clean: bool = True, n: int | None = None) -> Graph:
        """From a literal list of (src, dst) or (src, dst, weight)."""
        weighted = bool(pairs) and len(pairs[0]) == 3
        edges = spark.createDataFrame(pairs, "src long, dst long" + (", weight int" if weighted else ""))
        return cls(normalize(edges, symmetrize) if clean else edges, n, symmetrize)

    @classmethod
    def from_csr(cls, spark: SparkSession, indptr, indices, data=None) -> Graph:
        """From compressed sparse rows in memory, as they are (nothing is cleaned)."""
        import numpy as np
        import pandas as pd

        indptr = np.asarray(indptr, np.int64)
        frame = {"src": np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), "dst": np.asarray(indices, np.int64)}
        if data is not None:
            frame["weight"] = np.asarray(data, np.int32)
        return cls(spark.createDataFrame(pd.DataFrame(frame)), len(indptr) - 1)

    def persist(self) -> Graph:
        self.edges = self.edges.persist()
        return self

    def laid_out(self) -> Graph:
        """The same graph with its edges written once, bucketed and sorted by source.

        A traversal then joins them with a state where they lie: rounds shuffle the state and the combined
        messages, never the edges. The table lives in the shared folder until the application ends.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch_path(self.spark, "edges")
        name = "tidegraph_" + path.rsplit("-", 1)[-1]
        self.edges.repartition(parts, "src").write.bucketBy(parts, "src").sortBy("src").option("path", path).saveAsTable(name)
        out = Graph(self.spark.table(name), self._n, self.undirected)
        out.placed = True
        return out

    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    def state(self, **columns) -> DataFrame:
        """Vertex state (id, ...): a value or Column for each named property."""
        return self.vertices().select("id", *[(c if not isinstance(c, (int, float, bool, str, type(None))) else F.lit(c)).alias(k) for k, c in columns.items()])

    def edge_count(self) -> int:
        return self.edges.count()

    def out_degrees(self, name: str = "degree") -> DataFrame:
        """(id, degree) of all vertices, 0 included."""
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices().join(counts, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def out_degrees_unsigned(self, name: str = "degree") -> DataFrame:
        """The same numbers: a Spark long holds every unsigned 32-bit degree."""
        return self.out_degrees(name)

    def out_degree(self, v: int) -> int:
        return self.edges.where(F.col("src") == v).count()

    def neighbours(self, v: int) -> DataFrame:
        """Out-neighbours of one vertex, as a vertex set (id)."""
        return self.edges.where(F.col("src") == v).select(F.col("dst").alias("id")).distinct()

    def neighbour_lists(self) -> DataFrame:
        """(id, neighbours): the sorted out-neighbours of every vertex that has any."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))

    def transpose(self) -> Graph:
        more = ["weight"] if self.weighted else []
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more), self._n, self.undirected)

    def symmetrized(self) -> Graph:
        return Graph(normalize(self.edges, True), self._n, True)

    def degree_order(self) -> DataFrame:
        """(id, new_id): vertices by descending degree, equal degrees by descending id."""
        return global_rank(self.out_degrees(), F.col("degree").desc(), F.col("id").desc(), name="new_id").select("id", "new_id")

    def relabel(self, force: bool | None = None) -> Graph:
        """Renumber by descending degree where degrees are skewed (or ``force`` says so); undirected only.

        Skewed: average degree at least 10 and mean / 1.3 above the median. The whole degree table decides,
        not a sample, so the decision is the same every time.
        """
        if not self.undirected:
            raise ValueError("relabel needs an undirected graph")
        if force is None:
            mean, median = self.out_degrees().agg(F.avg("degree"), F.percentile_approx("degree", 0.5)).first()
            force = bool(mean is not None and mean >= 10 and mean / 1.3 > median)
        if not force:
            return self
        names = self.degree_order()
        one = names.select(F.col("id").alias("src"), F.col("new_id").alias("s"))
        two = names.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
        edges = self.edges.join(one, "src").join(two, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *(["weight"] if self.weighted else []))
        return Graph(edges, self.n, True)

    def _random(self, here: str, there: str, seed: int) -> DataFrame:
        key = F.xxhash64(F.lit(seed), "src", "dst")
        return self.edges.groupBy(F.col(here).alias("id")).agg(F.min_by(there, key).alias("neighbour"))

    def random_out_neighbours(self, seed: int = 0) -> DataFrame:
        """(id, neighbour): one out-neighbour of every vertex that has any, uniform over seeds."""
        return self._random("src", "dst", seed)

    def random_in_neighbours(self, seed: int = 0) -> DataFrame:
        return self._random("dst", "src", seed)

    def random_out_neighbour(self, v: int, seed: int = 0) -> int:
        row = Graph(self.edges.where(F.col("src") == v), self._n).random_out_neighbours(seed).first()
        if row is None:
            raise ValueError(f"vertex {v} has no out-neighbour")
        return row["neighbour"]
