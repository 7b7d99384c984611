"""Language-model scoring with a bigram model held as Elias-Fano tries.

Level one of a trie holds the contexts, with monotone pointers into level two, which holds each context's
successors relative to it; both are Elias-Fano sequences, and every successor carries a 16-bit quantised
count from which the smoothed probability follows. Tries are shards by hash: no task holds the whole model.
Texts travel as compressed blocks: a block names its distinct tokens and bigrams once to the shards, which
learn from the training texts among them, build their trie, answer every name, and forget; the block then
scores its texts from the answers. Nothing per token is exchanged one row at a time, and what is gathered
grows with the corpus.

The model: P(w | v) = (q(v, w) + MU * P0(w)) / (c(v) + MU), Dirichlet smoothing of the bigram counts towards
the base P0(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). q is the quantised count: exact up to
1024, beyond at most a thousandth below it, whatever the count.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import blocks, mix64, pack_columns, prefix_hash, span_hash, unpack, unpack_columns, words_of

FOLDS, HELD_OUT = 5, 1
MU = 100.0
#: Hash of the token that ends every text, and stands before its first word.
END = np.uint64(0x2545F4914F6CDD1D)
CONTEXT_BITS, SUCCESSOR_BITS = 24, 32
BLOCKS_PER_BUCKET = 6
#: Quantised counts: themselves up to 1024, then steps of 1/1024, rounded down, up to the largest 64-bit count.
CODES = np.concatenate([np.arange(1025.0), np.floor(1024 * (1025 / 1024) ** np.arange(1, 37_650))])


def quantise(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(CODES, counts, side="right") - 1).astype("<u2")


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bytes as they are, high parts in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int):
        self.low, self.n = low, n
        bits = np.unpackbits(high, bitorder="little")
        self.high = np.flatnonzero(bits)[:n] - np.arange(n)
        self.width = low.shape[1]
        last = int(self.high[-1]) if n else 0
        # where each high part's values begin
        self.begin = np.searchsorted(self.high, np.arange(last + 2))

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(range(1, 8), key=lambda w: n * 8 * w + n + (top >> (8 * w)))
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        bits = np.zeros((int(high[-1]) + n + 1) if n else 0, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        return struct.pack("<IBQ", n, width, len(packed)) + low.tobytes() + packed.tobytes()

    @staticmethod
    def view(buffer, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at ``at`` of a buffer (bytes or a memory map), and where it ends."""
        n, width, size = struct.unpack_from("<IBQ", buffer, at)
        at += struct.calcsize("<IBQ")
        low = np.frombuffer(buffer, np.uint8, n * width, at).reshape(n, width)
        high = np.frombuffer(buffer, np.uint8, size, at + n * width)
        return EliasFano(low, high, n), at + n * width + size

    def _low(self, at) -> np.ndarray:
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.width] = self.low[at]
        return wide.view("<u8")[:, 0]

    def values(self) -> np.ndarray:
        return (self.high.astype(np.uint64) << np.uint64(8 * self.width)) | self._low(np.arange(self.n))

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first value >= each wanted one; n if there is none."""
        wanted = np.asarray(wanted, np.uint64)
        part = (wanted >> np.uint64(8 * self.width)).astype(np.int64)
        beyond = part >= len(self.begin) - 1
        part[beyond] = 0
        lo, hi = self.begin[part].copy(), self.begin[part + 1].copy()
        target = wanted & np.uint64((1 << (8 * self.width)) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < target[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        lo[beyond] = self.n
        return lo

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, or -1."""
        at = self.successor(wanted)
        there = np.flatnonzero(at < self.n)
        same = np.zeros(len(at), dtype=bool)
        i = at[there]
        same[there] = ((self.high[i].astype(np.uint64) << np.uint64(8 * self.width)) | self._low(i)) == np.asarray(wanted, np.uint64)[there]
        return np.where(same, at, -1)


class Trie:
    """Contexts -> successors -> quantised counts, over one buffer that can be a memory map."""

    def __init__(self, buffer):
        self.contexts, at = EliasFano.view(buffer)
        self.pointers, at = EliasFano.view(buffer, at)
        self.successors, at = EliasFano.view(buffer, at)
        self.codes = np.frombuffer(buffer, "<u2", self.successors.n, at)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
        """From sorted distinct keys (context above SUCCESSOR_BITS, successor below) and their counts."""
        context = keys >> np.uint64(SUCCESSOR_BITS)
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
        rank = np.cumsum(new) - 1
        relative = (rank.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | (keys & np.uint64((1 << SUCCESSOR_BITS) - 1))
        pointers = np.append(np.flatnonzero(new), len(keys))
        return EliasFano.encode(context[new]) + EliasFano.encode(pointers) + EliasFano.encode(relative) + quantise(counts).tobytes()

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Codes of the counts; 0 for an absent bigram. Searches successors relative to their context."""
        keys = np.asarray(keys, np.uint64)
        context = self.contexts.find(keys >> np.uint64(SUCCESSOR_BITS))
        out = np.zeros(len(keys), np.uint16)
        known = np.flatnonzero(context >= 0)
        wanted = (context[known].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | (keys[known] & np.uint64((1 << SUCCESSOR_BITS) - 1))
        at = self.successors.find(wanted)
        out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def following(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """(successors, codes) of one context, by its pointers."""
        i = int(self.contexts.find(np.array([context], np.uint64))[0])
        if i < 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        a, b = (int(x) for x in self.pointers.values()[i : i + 2])
        return self.successors.values()[a:b] & np.uint64((1 << SUCCESSOR_BITS) - 1), self.codes[a:b]


def token_hashes(norm: np.ndarray, starts: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words; hashed a slice at a time, so a long text needs no long tables."""
    out = np.empty(len(starts) - 1, np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + step, side="right")) - 1)
        a = starts[i]
        prefix = prefix_hash(norm[a : starts[j]])
        out[i:j] = span_hash(prefix, starts[i:j] - a, starts[i + 1 : j + 1] - 1 - a)
        i = j
    return out


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class _Tokens:
    """A block's tokens: words and one end each text, with the distinct ones and the distinct bigrams."""

    def __init__(self, row: dict):
        self.ids, offsets, data = unpack(row)
        norm, starts, before = words_of(data, offsets)
        words = token_hashes(norm, starts)
        texts = len(self.ids)
        self.each = np.diff(before) + 1
        self.end = np.cumsum(self.each)
        self.token = np.empty(int(self.end[-1]) if texts else 0, np.uint64)
        is_end = np.zeros(len(self.token), dtype=bool)
        is_end[self.end - 1] = True
        self.token[is_end], self.token[~is_end] = END, words
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        if texts:
            self.before[0] = END  # an end also stands before the next text
        pair = mix64(self.before * np.uint64(0x9E3779B97F4A7C15) + self.token) & np.uint64((1 << SUCCESSOR_BITS) - 1)
        self.pair = ((self.before >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(SUCCESSOR_BITS)) | pair
        self.held = np.array([held_out(i) for i in self.ids.tolist()], dtype=bool)
        self.learn = ~np.repeat(self.held, self.each)

    def distinct(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, inverse = np.unique(values, return_inverse=True)
        return keys, inverse, np.bincount(inverse, self.learn, len(keys)).astype(np.int64)


UNIGRAM, BIGRAM = 0, 1


def _shard(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    return ((mix64(keys + np.uint64(kind)) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def _shards(keys: np.ndarray, kind: int, buckets: int):
    """(bucket, indices of its keys): the same in every stage."""
    at = _shard(keys, kind, buckets)
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(buckets + 1))
    for bucket in range(buckets):
        if edge[bucket] < edge[bucket + 1]:
            yield bucket, order[edge[bucket] : edge[bucket + 1]]


def score(docs: DataFrame, mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row with an id.

    Null texts count as empty: their only token is the end. An empty table gives no rows; without training
    texts every token is unknown and the model equals the base.
    """
    packed = materialize(blocks(docs), "blocks")
    buckets = max(8, packed.count() // BLOCKS_PER_BUCKET)

    def names(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _Tokens(row)
                for kind, values in ((UNIGRAM, tokens.token), (BIGRAM, tokens.pair)):
                    keys, _, counts = tokens.distinct(values)
                    for bucket, own in _shards(keys, kind, buckets):
                        blob = EliasFano.encode(keys[own])
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), pa.array([pack_columns(np.minimum(counts[own], 0xFFFFFFFF).astype(np.uint32))], pa.binary())], ["bucket", "block", "kind", "names", "counts"])

    def answers(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, kind = rows[0]["bucket"], rows[0]["kind"]
        keys = [EliasFano.view(r["names"])[0].values() for r in rows]
        counts = [unpack_columns(r["counts"])[0].astype(np.int64) for r in rows]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every = every[order]
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        total = np.add.reduceat(np.concatenate(counts)[order], new)
        every = every[new]
        if kind == UNIGRAM:
            told = [pack_columns(total[np.searchsorted(every, k)]) for k in keys]
        else:
            trie = Trie(Trie.build(every[total > 0], total[total > 0]))
            told = [pack_columns(trie.counts(k)) for k in keys]
        n, v = int(total.sum()), int((total > 0).sum())
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int64()),
            "n": pa.array([n * (i == 0) for i in range(len(rows))], pa.int64()), "v": pa.array([v * (i == 0) for i in range(len(rows))], pa.int64()), "blob": pa.array(told, pa.binary()),
        })

    asked = packed.mapInArrow(names, "bucket long, block long, kind int, names binary, counts binary")
    found = materialize(asked.groupBy("bucket", "kind").applyInArrow(answers, "block long, kind int, bucket long, n long, v long, blob binary"), "answers")
    totals = found.where(F.col("kind") == UNIGRAM).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, v_train = int(totals["n"] or 0), int(totals["v"] or 0)

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        told = {(r["kind"], r["bucket"]): unpack_columns(r["blob"])[0] for r in right.to_pylist()}
        out = []
        for row in left.to_pylist():
            tokens = _Tokens(row)
            got = {}
            for kind, values in ((UNIGRAM, tokens.token), (BIGRAM, tokens.pair)):
                keys, inverse, _ = tokens.distinct(values)
                value = np.zeros(len(keys), np.int64)
                for bucket, own in _shards(keys, kind, buckets):
                    value[own] = told[kind, bucket]
                got[kind] = value[inverse]
            c, first = got[UNIGRAM], np.concatenate([[0], tokens.end[:-1]])
            base = (c + 0.5) / (n_train + 0.5 * (v_train + 1))
            ends = c[tokens.end[:1] - 1] if len(c) else 0
            before = np.empty_like(c)
            before[1:] = c[:-1]
            if len(c):
                before[first] = ends
            model = (CODES[got[BIGRAM]] + mu * base) / (before + mu)
            out.append(pa.table({
                "doc_id": tokens.ids, "held_out": tokens.held, "n_tokens": tokens.each, "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "train_tokens": np.full(len(first), n_train),
                "base_score": np.add.reduceat(np.log10(base), first), "score": np.add.reduceat(np.log10(model), first),
            }))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(found.drop("n", "v").groupBy("block")).applyInArrow(judge, schema)
