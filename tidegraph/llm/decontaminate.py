"""Benchmark decontamination: short test items inside long documents, with DataFrame functions alone.

Items are partitioned by their number of distinct shingles. In each partition an item is searched by the
MinHash sketch (its smallest shingle hashes) just long enough that a document which holds the asked share of
the item must hold one of the sketch: an item of s shingles that may miss s - r of them needs s - r + 1.
So long documents need no signature at all, and the search misses nothing. An item of fewer words than a
shingle is one shingle of all its words. Candidates are then verified by exact containment of the strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import let

SHINGLE, CONTAINMENT = 5, 0.8
#: The sketch table is broadcast up to so many rows (16 bytes each); above, the join shuffles.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _spots(w: Column, k: int) -> Column:
    """Positions (from 1) of the shingles: one for the whole text if it has 1 to k words."""
    n = F.size(w)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles, by position. A text shorter than k words has one, of all its words."""
    return let(w, lambda w: F.transform(_spots(w, k), lambda i: F.xxhash64(*[F.get(w, i - 1 + j) for j in range(k)])))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    return F.array_distinct(let(w, lambda w: F.transform(_spots(w, k), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(k))))))


def _sized(items: DataFrame, k: int) -> DataFrame:
    """(item_id, w, k): words of the items that have any, and the length of their shingles: k words, or all."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return own.withColumn("k", F.least(F.size("w"), F.lit(k)))


def _by_length(w: Column, k: Column, lengths: list[int], shingled) -> Column:
    """``shingled(w, n)`` for the row's own shingle length n, one of ``lengths``."""
    out = None
    for n in lengths:
        out = F.when(k == n, shingled(w, n)) if out is None else out.when(k == n, shingled(w, n))
    return out


def sketches(items: DataFrame, k: int = SHINGLE, share: float = CONTAINMENT) -> DataFrame:
    """(item_id, k, h): the MinHash sketch of each item, its length set by the item's size partition."""
    every = list(range(1, k + 1))
    hashes = _by_length(F.col("w"), F.col("k"), every, shingle_hashes)
    sized = _sized(items, k).select("item_id", "k", F.array_sort(F.array_distinct(hashes)).alias("hashes")).withColumn("size", F.size("hashes"))
    # partitions by powers of two; a sketch is as long as the partition's largest size asks for
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size")))).cast("int")
    most = F.floor(top * F.lit(1 - share) + F.lit(1e-9)).cast("int") + 1
    return sized.select("item_id", "k", F.explode(F.slice("hashes", F.lit(1), F.least(F.col("size"), most))).alias("h"))


def _contaminated(docs: DataFrame, items: DataFrame, k: int, share: float) -> DataFrame:
    """(key, item_id, n_shared, n_item, containment) of all pairs, for ``docs(key, text)``."""
    table = materialize(sketches(items, k, share), "sketches")
    figures = table.agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("k")).alias("lengths")).first()  # at most k lengths
    lengths, small = figures["lengths"] or [k], figures["rows"] <= BROADCAST_ROWS
    # a document is read once, with a set of hashes for each shingle length that an item has
    each = lambda w: F.flatten(F.array(*[_named(w, n) for n in lengths]))
    probe = docs.select("key", F.explode(let(words(F.col("text")), each)).alias("s")).select("key", "s.k", "s.h")
    found = probe.join(F.broadcast(table) if small else table, ["k", "h"]).select("key", "item_id", "k").distinct()
    pairs = materialize(found, "pairs")
    # only the texts of candidates are read again: by a broadcast of pairs of a checked number, else by a join
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    exact = _sized(items, k).select("item_id", _by_length(F.col("w"), F.col("k"), lengths, shingles).alias("item"))
    hits = docs.join(F.broadcast(pairs) if few else pairs, "key")
    own = _by_length(F.col("w"), F.col("k"), lengths, shingles)
    hits = hits.select("key", "item_id", "k", words(F.col("text")).alias("w")).select("key", "item_id", own.alias("doc"))
    hits = hits.join(exact, "item_id").select("key", "item_id", F.size(F.array_intersect("item", "doc")).cast("long").alias("n_shared"), F.size("item").cast("long").alias("n_item"))
    best = hits.groupBy("key", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    best = best.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= share - 1e-12)
    # an item id can stand on several texts: the best counts
    return best.groupBy("key", "item_id").agg(F.max_by(F.struct("n_shared", "n_item", "containment"), F.struct("containment", "n_item")).alias("b")).select("key", "item_id", "b.*")


def _whole(w: Column, k: int) -> Column:
    """Hashes of the shingles of k words, none if the text is shorter."""
    return F.when(F.size(w) >= k, shingle_hashes(w, k)).otherwise(F.array().cast("array<bigint>"))


def _named(w: Column, k: int) -> Column:
    return F.transform(F.array_distinct(_whole(w, k)), lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of all pairs with containment >= share.

    Shingles of k words, as sets; an item of fewer words has one, of all its words, and is found wherever they
    stand in a row. Items without words match nothing. Pairs need ids: rows without one are reported by
    :func:`clean` alone. Equal rows count once; texts of one id are judged each by itself and the best counts.
    Empty tables give no rows; texts of any length are read whole; extra columns are ignored.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return _contaminated(docs, items, k, share).withColumnRenamed("key", "doc_id")


def clean(docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, and the rows of an id one of whose texts does.

    A row without an id is judged by its own text, an item without an id counts too. All columns, whatever
    their names, come out as they went in.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    texts = items.select(F.col("text").cast("string").alias("text")).distinct().select(F.xxhash64("text").alias("item_id"), "text")
    found = _contaminated(rows.select("key", F.col("whole.text").cast("string").alias("text")), texts, k, share).select("key").distinct()
    return rows.join(found, "key", "left_anti").select("whole.*")
