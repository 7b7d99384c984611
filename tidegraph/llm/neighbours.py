"""Approximate nearest neighbours with a forest of hash prefixes.

Every vector has, in each tree, a hash string of BITS bits (signs of random projections around the sample's
medians). Vectors are dealt to blocks; in a block each tree is a sorted array of hash strings. A query
descends every tree to its longest matching prefix and then ascends all trees together, one bit at a time,
until the prefixes' ranges hold enough candidates; those are ranked by exact distance. The stated query set
meets all blocks, in blocks of queries; nothing is collected or broadcast but the fitted projections.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

TREES, BITS, SEED = 16, 32, 7
#: The projections are fitted on so many vectors at most; every vector is indexed.
SAMPLE = 4096
BLOCK, QUERY_BLOCK = 8192, 1024
#: Ascend until the ranges hold this share of a block (counted over all trees), and at least so many.
ENOUGH_SHARE, ENOUGH_LEAST = 1.25, 512


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): finite, non-zero vectors without null components, as doubles."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return out.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _vectors(table: pa.Table, name: str, dim: int) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(data: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Projections and medians for each dimension, from the SAMPLE vectors with the smallest hashed ids."""
    sample: dict[int, list] = {}
    for row in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(row["dim"], []).append(row["v"])
    out = {}
    for dim, rows in sample.items():
        planes = np.random.default_rng([SEED, dim]).standard_normal((dim, TREES * BITS))
        out[dim] = planes, np.median(np.array(rows) @ planes, axis=0)
    return out


def _codes(v: np.ndarray, fitted) -> np.ndarray:
    """(trees, vectors) hash strings as unsigned 32-bit numbers, first bit highest."""
    planes, medians = fitted.get(v.shape[1]) or (np.random.default_rng([SEED, v.shape[1]]).standard_normal((v.shape[1], TREES * BITS)), 0.0)
    bits = ((v @ planes) > medians).reshape(len(v), TREES, BITS)
    return np.ascontiguousarray(np.packbits(bits, axis=2).view(">u4")[:, :, 0].T.astype(np.uint32))


def search_block(ids: np.ndarray, v: np.ndarray, codes: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, k: int):
    """(query position, vector position, distance) of each query's k nearest candidates in one block."""
    trees = [np.argsort(c, kind="stable") for c in codes]
    ordered = [c[t].astype(np.uint64) for c, t in zip(codes, trees, strict=True)]
    enough = min(len(ids) * len(trees), max(ENOUGH_LEAST, round(ENOUGH_SHARE * len(ids))))
    level = np.full(len(q_ids), -1)
    low = np.zeros((len(trees), len(q_ids)), np.int64)
    high = np.zeros_like(low)
    # longest prefixes first; all trees ascend together
    for bits in range(BITS, -1, -1):
        open_ = np.flatnonzero(level < 0)
        if not len(open_):
            break
        shift = np.uint64(BITS - bits)
        total = np.zeros(len(open_), np.int64)
        for t in range(len(trees)):
            prefix = q_codes[t][open_].astype(np.uint64) >> shift
            low[t, open_] = np.searchsorted(ordered[t], prefix << shift)
            high[t, open_] = np.searchsorted(ordered[t], (prefix + np.uint64(1)) << shift)
            total += high[t, open_] - low[t, open_]
        level[open_[(total >= enough) | (bits == 0)]] = bits
    for i in range(len(q_ids)):
        mark = np.zeros(len(ids), dtype=bool)
        for t, own in enumerate(trees):
            mark[own[low[t, i] : high[t, i]]] = True
        mark[ids == q_ids[i]] = False
        found = np.flatnonzero(mark)
        distance = np.sqrt(((v[found] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[found], distance))[:k]
        yield i, found[best], distance[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found of all other vectors.

    Smallest Euclidean distance first, ties to the smaller vec_id. Unusable vectors take no part on either
    side; vectors of another length are no candidates; of rows with one id the smallest vector counts; an
    empty table gives no rows.
    """
    data = usable(vectors, column)
    asked = usable(queries, column).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = data.count()
    blocks = max(1, -(-n // BLOCK))
    fitted = data.sparkSession.sparkContext.broadcast(fit(data))  # SAMPLE bounds it

    def index(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids, v = table.column("vec_id").to_numpy(), _vectors(table, "v", dim)
        order = np.lexsort((*v.T[::-1], ids))
        keep = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
        ids, v = ids[keep], v[keep]
        row = {"block": [table.column("block")[0].as_py()], "dim": [dim], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "codes": [_codes(v, fitted.value).tobytes()]}
        return pa.table(row, pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary())]))

    kind = "block long, dim int, ids binary, vectors binary, codes binary"
    dealt = lambda df, parts: df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    forest = materialize(dealt(data, blocks).groupBy("block", "dim").applyInArrow(index, kind), "forest")
    n_asked = asked.count()
    ask = materialize(dealt(asked, max(1, -(-n_asked // QUERY_BLOCK))).groupBy("block", "dim").applyInArrow(index, kind), "asked")
    ask = ask.selectExpr("dim", "ids q_ids", "vectors q_vectors", "codes q_codes", f"explode(sequence(0L, {blocks - 1}L)) block")
    meet = forest.repartition(max(blocks, 1), "block", "dim").join(ask, ["block", "dim"]).select("dim", "ids", "vectors", "codes", "q_ids", "q_vectors", "q_codes")

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                v, q = np.frombuffer(r["vectors"]).reshape(-1, r["dim"]), np.frombuffer(r["q_vectors"]).reshape(-1, r["dim"])
                codes, q_codes = np.frombuffer(r["codes"], np.uint32).reshape(TREES, -1), np.frombuffer(r["q_codes"], np.uint32).reshape(TREES, -1)
                a, b, d = [], [], []
                for i, found, distance in search_block(ids, v, codes, q_ids, q, q_codes, k):
                    a.append(np.full(len(found), q_ids[i]))
                    b.append(ids[found])
                    d.append(distance)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, d)], ["query_id", "vec_id", "score"])

    found = meet.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
