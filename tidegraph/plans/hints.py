"""Execution hints. They choose among plans with equal results, never the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The accepted spellings.
DIRECTIONS = ("SparsePush", "DensePush", "DensePull", "SparsePush-DensePull", "DensePush-SparsePush", "DensePull-SparsePush", "SparsePush-DensePush")
PARALLEL = ("serial", "dynamic-vertex-parallel", "static-vertex-parallel", "edge-aware-dynamic-vertex-parallel")
DENSE_SETS = ("boolean-array", "bitvector")
NUMA = ("serial", "static-parallel", "dynamic-parallel")
PRIORITY_UPDATES = ("lazy_priority_update", "eager_priority_update", "eager_priority_update_with_merge", "constant_sum_reduce_before_update")
INTERSECTIONS = ("HiroshiIntersection", "MultiskipIntersection", "CombinedIntersection", "BinarySearchIntersection", "NaiveIntersection")
#: A frontier is broadcast up to so many ids (8 bytes each).
BROADCAST_IDS = 1_000_000
#: A hybrid direction is sparse up to this share of active vertices.
SPARSE_SHARE = 0.05


@dataclass(frozen=True)
class Hints:
    """One schedule: defaults are push, reduce before update, delta 1.

    direction, delta, segments and duplicates reach the plan; the others are checked and kept, as Spark's own
    adaptive execution, code generation and partial aggregation decide what they would.
    """

    direction: str = "SparsePush"
    parallel: str = "dynamic-vertex-parallel"
    dense_set: str = "boolean-array"
    segments: int | None = None
    numa: str = "serial"
    priority_update: str = "lazy_priority_update"
    delta: int = 1
    merge_threshold: int = 1000
    open_buckets: int = 128
    intersection: str = "NaiveIntersection"
    grain_size: int | None = None
    fuse: tuple[str, ...] = ()
    deduplicate: bool = True
    fused: tuple[str, ...] = ()
    split: tuple[int, ...] = ()

    def __post_init__(self):
        for name, known in (("direction", DIRECTIONS), ("parallel", PARALLEL), ("dense_set", DENSE_SETS), ("numa", NUMA), ("priority_update", PRIORITY_UPDATES), ("intersection", INTERSECTIONS)):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)!r}")
        if self.delta < 1:
            raise ValueError("delta must be at least 1")

    def sparse(self, active: int | None, n: int) -> bool:
        """Whether a round starts from the frontier: always for a sparse push, never for a pull or a dense one.

        A hybrid takes its first word while at most SPARSE_SHARE of the vertices are active, then its second.
        Without a known number of active vertices it takes the first.
        """
        words = self.direction.split("-")
        word = words[0] if len(words) == 1 or active is None else words[0 if ("Sparse" in words[0]) == (active <= SPARSE_SHARE * n) else 1]
        return word == "SparsePush"

    def semi_join(self, edges: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        """Edges whose ``key`` is in ``ids``. Push directions broadcast ids whose number was checked."""
        right = ids.select(F.col("id").alias(key))
        if "Push" in self.direction.split("-")[0] and right.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            right = F.broadcast(right)
        return edges.join(right, key, "left_semi")

    def spread(self, edges: DataFrame) -> DataFrame:
        """Segments of sources, each dealt over as many tasks as it takes to reach the shuffle's partitions."""
        if not self.segments:
            return edges
        each = -(-int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // self.segments)
        return edges.repartitionByRange(self.segments * each, "src")


DEFAULT = Hints()


class Schedule:
    """Hints by statement label, as a program's schedule gives them; chainable."""

    def __init__(self):
        self._by_label: dict[str, dict] = {}

    def _set(self, label: str, **values) -> Schedule:
        self._by_label[label] = self._by_label.get(label, {}) | values
        Hints(**self._by_label[label])
        return self

    def config_apply_direction(self, label: str, direction: str) -> Schedule:
        return self._set(label, direction=direction)

    def config_apply_parallelization(self, label: str, kind: str, grain_size: int | None = None) -> Schedule:
        return self._set(label, parallel=kind, grain_size=grain_size)

    def config_apply_dense_vertex_set(self, label: str, kind: str) -> Schedule:
        return self._set(label, dense_set=kind)

    def config_apply_num_ssg(self, label: str, kind: str, segments: int) -> Schedule:
        if kind not in ("fixed-vertex-count", "edge-aware-vertex-count"):
            raise ValueError(f"unknown segment kind: {kind!r}")
        return self._set(label, segments=segments)

    def config_apply_numa(self, label: str, kind: str) -> Schedule:
        return self._set(label, numa=kind)

    def config_apply_priority_update(self, label: str, kind: str) -> Schedule:
        return self._set(label, priority_update=kind)

    def config_apply_priority_update_delta(self, label: str, delta: int) -> Schedule:
        return self._set(label, delta=delta)

    def config_bucket_merge_threshold(self, label: str, threshold: int) -> Schedule:
        return self._set(label, merge_threshold=threshold)

    def config_num_open_buckets(self, label: str, buckets: int) -> Schedule:
        return self._set(label, open_buckets=buckets)

    def config_intersection(self, label: str, kind: str) -> Schedule:
        return self._set(label, intersection=kind)

    def config_par_for_grain_size(self, label: str, size: int) -> Schedule:
        return self._set(label, grain_size=size)

    def fuse_fields(self, label: str, *columns: str) -> Schedule:
        return self._set(label, fuse=columns)

    def fuse_for_loop(self, label: str, *loops: str) -> Schedule:
        """Accepted: Catalyst fuses what one plan holds."""
        return self._set(label, fused=tuple(loops))

    def split_for_loop(self, label: str, *parts: int) -> Schedule:
        """Accepted: a loop's rounds are separate jobs already."""
        return self._set(label, split=tuple(parts))

    def fuse_apply_functions(self, label: str, *functions: str) -> Schedule:
        """Accepted: several updates of one traversal always share its pass."""
        return self._set(label, fused=tuple(functions))

    def set_vertex_set(self, label: str, kind: str) -> Schedule:
        """The older spelling of a frontier's layout."""
        if kind not in ("sparse", "dense", "bitvector", "boolean-array"):
            raise ValueError(f"unknown vertex set: {kind!r}")
        return self._set(label, dense_set="bitvector" if kind == "bitvector" else "boolean-array")

    def set_apply(self, label: str, option: str, value: int | None = None) -> Schedule:
        """The older single-word options."""
        old = {
            "push": {"direction": "SparsePush"}, "pull": {"direction": "DensePull"}, "hybrid_dense": {"direction": "SparsePush-DensePull"}, "hybrid_dense_forward": {"direction": "DensePush-SparsePush"},
            "serial": {"parallel": "serial"}, "parallel": {"parallel": "dynamic-vertex-parallel"}, "enable_deduplication": {"deduplicate": True}, "disable_deduplication": {"deduplicate": False},
            "sliding_queue": {}, "pull_frontier_bitvector": {"dense_set": "bitvector"}, "pull_edge_based_load_balance": {"parallel": "edge-aware-dynamic-vertex-parallel"}, "numa_aware": {"numa": "static-parallel"},
            "num_segment": {"segments": value}, "delta": {"delta": value}, "grain_size": {"grain_size": value}, "sparse": {}, "dense": {},
        }
        if option not in old:
            raise ValueError(f"unknown option: {option!r}")
        return self._set(label, **old[option])

    def hints(self, label: str) -> Hints:
        return Hints(**self._by_label.get(label, {}))
