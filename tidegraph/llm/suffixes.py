"""Exact removal of repeated substrings with difference-cover suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus (smaller doc_id,
or the same document, earlier). Sorting every suffix of the corpus would move it many times over, so the
suffixes that cannot matter are left out first, without loss:

1. Each window of ``length`` bytes names an anchor, the K-gram in it with the smallest hash; equal windows
   name equal anchors at equal places, so only anchors that occur twice can stand in a repeat.
2. Occurrences of an anchor whose whole context (all windows that hold it) is equal form a class; all but the
   first of a class are repeats throughout, and only the first goes on.
3. Where an anchor has several contexts, the first of each class are brought together and their suffixes are
   sorted by the difference-cover algorithm (sort sampled triples, recurse on names, merge the remaining
   suffixes); adjacent suffixes with a common prefix of ``length`` bytes are equal windows.

An anchor with more than CROWD contexts is spread out instead: its windows are dealt by their own hash.
Blocks of texts, not rows, travel between the stages. No stage gathers more than a bounded batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import blocks, mix64, pack_columns, prefix_hash, span_hash, unpack, unpack_columns

LENGTH = 100
GRAM = 40
#: Contexts of one anchor that are sorted together; suffix-sorted bytes of one batch; blocks for a bucket.
CROWD, BATCH_BYTES, BLOCKS_PER_BUCKET = 2048, 1 << 20, 6
#: Bytes hashed at a time; slices overlap so that no window is missed.
SLICE = 1 << 20


def _order(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys, first one first; small keys are packed into one 64-bit number."""
    bits = [max(int(k.max(initial=0)).bit_length(), 1) for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    packed = keys[0]
    for k, b in zip(keys[1:], bits[1:], strict=True):
        packed = (packed << b) | k
    return np.argsort(packed)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])
    # sampled suffixes, sorted by their triples; names are ranks of triples
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    middle = len(np.arange(1, n + (n % 3 == 1), 3))
    order = sample[_order(s[sample], s[sample + 1], s[sample + 2])]
    new = np.concatenate([[1], ((s[order[1:]] != s[order[:-1]]) | (s[order[1:] + 1] != s[order[:-1] + 1]) | (s[order[1:] + 2] != s[order[:-1] + 2])).astype(np.int64)])
    name = np.cumsum(new)
    rank = np.zeros(n + 3, np.int64)
    rank[order] = name
    if name[-1] < len(sample):
        deeper = suffix_array(rank[sample])
        order = sample[deeper]
        rank[:] = 0
        rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    rank[n:] = 0
    # remaining suffixes by first element and the sampled rank behind it
    rest = order[order % 3 == 1] - 1
    if n % 3 == 1:
        rest = np.concatenate([[n - 1], rest[rest != n - 1]])
    rest = rest[np.argsort(s[rest], kind="stable")]
    # merge: every remaining suffix finds its place among the sampled ones, by residue of these
    place = np.zeros(len(rest), np.int64)
    for residue, own in ((1, order[order % 3 == 1]), (2, order[order % 3 == 2])):
        if not len(own):
            continue
        if residue == 1:
            left = (s[own], rank[own + 1])
            right = (s[rest], rank[rest + 1])
        else:
            left = (s[own], s[own + 1], rank[own + 2])
            right = (s[rest], s[rest + 1], rank[rest + 2])
        both = [np.concatenate(x) for x in zip(left, right, strict=True)]
        mixed = _order(*both)
        before = np.empty(len(mixed), np.int64)
        before[mixed] = np.cumsum(mixed < len(own))
        place += before[len(own) :]
    out = np.empty(n, np.int64)
    at = place + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = order
    return out


def equal_windows(texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, text, start) of every window of ``length`` bytes that equals another window."""
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size + 1) - size - 1
    joined = np.zeros(int((size + 1).sum()), np.int64)
    text = np.repeat(np.arange(len(texts)), size + 1)
    for k, t in enumerate(texts):
        joined[first[k] : first[k] + size[k]] = t
    joined[first + size] = 256 + np.arange(len(texts))  # ends no common prefix crosses
    inside = np.arange(len(joined)) - first[text]
    order = suffix_array(joined)
    order = order[inside[order] + length <= size[text[order]]]
    # eight bytes at a time; the last step overlaps the one before
    plain = np.concatenate([np.minimum(joined, 255).astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((len(joined),), "<u8", plain.tobytes(), strides=(1,))
    same = np.arange(max(len(order) - 1, 0))
    for k in [*range(0, length - 7, 8), max(length - 8, 0)]:
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    linked = np.zeros(len(order) + 1, dtype=bool)
    linked[same + 1] = True  # equal to the one before
    member = linked[:-1] | linked[1:]
    group = np.cumsum(~linked[:-1])
    chosen = order[member]
    return group[member], text[chosen], inside[chosen]


def _sliding(values: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, context, text, position) of the anchors of all windows in a block."""
    found = []
    reach, step = length - gram, SLICE
    for low in range(0, max(len(data) - gram + 1, 0), step):
        # a slice sees as much on either side as its anchors' windows and contexts can reach
        a, b = max(0, low - length), min(len(data), low + step + 2 * length)
        part = data[a:b]
        prefix = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        h = span_hash(prefix, at, at + gram)
        if len(h) > reach:
            least = _sliding(h, reach + 1, np.minimum)
            pad = np.zeros(reach, np.uint64)
            best = _sliding(np.concatenate([pad, least, pad]), reach + 1, np.maximum)
            chosen = np.flatnonzero(best == h)
        else:
            chosen = np.zeros(0, np.int64)
        place = chosen + a
        mine = (place >= low) & (place < low + step)
        chosen, place = chosen[mine], place[mine]
        text = np.searchsorted(offsets, place, side="right") - 1
        begin, end = offsets[text], offsets[text + 1]
        fine = (place + gram <= end) & (end - begin >= length)
        chosen, place, text, begin, end = (x[fine] for x in (chosen, place, text, begin, end))
        left, right = np.maximum(place - reach, begin), np.minimum(place + length, end)
        context = span_hash(prefix, left - a, right - a)
        context = mix64(context ^ ((place - left).astype(np.uint64) << np.uint64(20)) + (right - place).astype(np.uint64))
        found.append((h[chosen], context, text, place - begin))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted_anchors(ids, offsets, data, length, gram):
    """Anchors by (hash, context, doc id, position), and which are the first of their class in the block."""
    h, context, text, place = anchors(data, offsets, length, gram)
    order = np.lexsort((place, ids[text], context, h))
    h, context, text, place = h[order], context[order], text[order], place[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
    return h, context, text, place, first


def _row(schema: list[str], *values) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[n]) for n, v in zip(schema, values, strict=True)], schema)


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(keys[own[0]]), own


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


FULL, SHARED, CROWDED = 0, 1, 2


def _messages(rows: list[dict], asked: list[tuple[int, list[np.ndarray]]], buckets: int, length: int, reach: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, block, kind, blob): what the block ``rows`` tells of the occurrences that buckets asked for.

    Of a kind a bucket gets one message, or one for each SLICE bytes, however many buckets asked.
    """
    parts = {kind: [np.concatenate(x) for x in zip(*[c for k, c in asked if k == kind], strict=True)] for kind in {k for k, _ in asked}}
    for row in rows:
        ids, offsets, data = unpack(row)
        for kind, (text, place, h) in parts.items():
            begin, end = offsets[text], offsets[text + 1]
            at = begin + place
            low, high = np.maximum(at - reach, begin), np.minimum(at + length, end)
            if kind == SHARED:
                for bucket, own in _by((h % np.uint64(buckets)).astype(np.int64)):
                    body = np.concatenate([data[a:b] for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True)])
                    yield bucket, row["block"], SHARED, pack_columns(h[own], ids[text[own]], text[own], (low - begin)[own], (high - low)[own].astype(np.int32), body)
                continue
            # windows by their own hash; contexts overlap, a window goes once
            full = high - low >= length
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, low[full], 1)
            np.add.at(edge, high[full] - length + 1, -1)
            every = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for some in np.split(every, np.searchsorted(every, np.arange(SLICE, len(data), SLICE))):
                if not len(some):
                    continue
                first = some[0]
                w = span_hash(prefix_hash(data[first : some[-1] + length]), some - first, some - first + length)
                text = np.searchsorted(offsets, some, side="right") - 1
                for bucket, own in _by((mix64(w) % np.uint64(buckets)).astype(np.int64)):
                    yield bucket, row["block"], CROWDED, pack_columns(w[own], ids[text[own]], text[own].astype(np.int32), (some - offsets[text])[own])


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): a row for each input row with an id.

    Null texts count as empty. Rows with one id stand in the order of their blocks; ids that do not repeat
    make the result independent of partitioning. An empty table gives no rows.
    """
    packed = materialize(blocks(docs), "blocks")
    buckets = max(8, packed.count() // BLOCKS_PER_BUCKET)
    reach = length - gram

    def occurrences(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, data = unpack(row)
                h, context, text, place, first = _sorted_anchors(ids, offsets, data, length, gram)
                h, context, text, place = (x[first] for x in (h, context, text, place))
                for bucket, own in _by((h % np.uint64(buckets)).astype(np.int64)):
                    yield _row(["bucket", "block", "blob"], bucket, row["block"], pack_columns(h[own], context[own], ids[text[own]], text[own].astype(np.int32), place[own].astype(np.int32)))

    def classes(table: pa.Table) -> pa.Table:
        parts = [(r["block"], unpack_columns(r["blob"])) for r in _rows(table)]
        block = np.concatenate([np.full(len(c[0]), b, np.int64) for b, c in parts])
        h, context, doc, text, place = (np.concatenate([c[i] for _, c in parts]) for i in range(5))
        del parts
        order = np.lexsort((place, text, block, doc, context, h))
        h, context, text, place, block = (x[order] for x in (h, context, text, place, block))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        first = new_h | np.concatenate([[True], context[1:] != context[:-1]])
        group = np.cumsum(new_h) - 1
        contexts = np.bincount(group, first)[group]
        kind = np.where(~first, FULL, np.where(contexts > CROWD, CROWDED, SHARED))
        wanted = ~first | (contexts > 1)
        out = []
        for b, own in _by(np.where(wanted, block, np.iinfo(np.int64).max)):
            if b != np.iinfo(np.int64).max:
                for k, some in _by(kind[own]):
                    some = own[some]
                    out.append((b, k, pack_columns(text[some], place[some], h[some] if k == SHARED else np.zeros(0, np.uint64))))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "kind": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    dealt = packed.mapInArrow(occurrences, "bucket long, block long, blob binary")
    found = materialize(dealt.groupBy("bucket").applyInArrow(classes, "block long, kind int, blob binary"), "classes")

    def contexts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(_messages(_rows(left), [(r["kind"], unpack_columns(r["blob"])) for r in _rows(right)], buckets, length, reach))
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([o[1] for o in out], pa.int64()), "kind": pa.array([o[2] for o in out], pa.int32()), "blob": pa.array([o[3] for o in out], pa.binary())})

    def repeats(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # block, text in it, window start

        def told(group, block, doc, text, start):
            """All but the first of each class; one window met twice is not its own repeat."""
            order = np.lexsort((start, text, block, doc, group))
            group, block, text, start = group[order], block[order], text[order], start[order]
            new = np.concatenate([[True], group[1:] != group[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            late = (block != block[head]) | (text != text[head]) | (start != start[head])
            hits.append((block[late], text[late], start[late]))

        shared = [(r["block"], unpack_columns(r["blob"])) for r in rows if r["kind"] == SHARED]
        if shared:
            block = np.concatenate([np.full(len(c[0]), b, np.int64) for b, c in shared])
            h, doc, text, low, size = (np.concatenate([c[i] for _, c in shared]) for i in range(5))
            body = np.concatenate([c[5] for _, c in shared])
            del shared
            begin = np.cumsum(size.astype(np.int64)) - size
            order = np.argsort(h, kind="stable")
            cuts = np.flatnonzero(np.diff(h[order])) + 1
            weight, batch = 0, []

            def sort_batch():
                own = np.concatenate(batch)
                group, which, start = equal_windows([body[begin[i] : begin[i] + size[i]] for i in own.tolist()], length)
                i = own[which]
                if len(group):
                    told(group, block[i], doc[i], text[i], low[i] + start)

            for own in np.split(order, cuts):
                more = int(size[own].sum())
                if batch and weight + more > BATCH_BYTES:
                    sort_batch()
                    weight, batch = 0, []
                batch.append(own)
                weight += more
            if batch:
                sort_batch()
        crowd = [(r["block"], unpack_columns(r["blob"])) for r in rows if r["kind"] == CROWDED]
        if crowd:
            block = np.concatenate([np.full(len(c[0]), b, np.int64) for b, c in crowd])
            w, doc, text, start = (np.concatenate([c[i] for _, c in crowd]) for i in range(4))
            if len(w):
                told(w, block, doc, text, start)
        out = []
        if hits:
            block, text, start = (np.concatenate(x) for x in zip(*hits, strict=True))
            for b, own in _by(block):
                out.append((b, SHARED, pack_columns(text[own], start[own])))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "kind": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    kinds = "block long, kind int, blob binary"
    asked = found.where(F.col("kind") != FULL)
    texts = packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(contexts, "bucket long, " + kinds)
    windows = texts.groupBy("bucket").applyInArrow(repeats, kinds)
    marks = found.where(F.col("kind") == FULL).unionByName(windows)

    def cover(key, left: pa.Table, right: pa.Table) -> pa.Table:
        result = ([], [], [], [], [])
        for row in _rows(left):
            ids, offsets, data = unpack(row)
            edge = np.zeros(len(data) + 1, np.int32)

            def add(low, high, edge=edge):
                np.add.at(edge, low, 1)
                np.add.at(edge, high, -1)

            def around(text, place, offsets=offsets):
                begin, end = offsets[text], offsets[text + 1]
                at = begin + place
                add(np.maximum(at - reach, begin), np.minimum(at + length, end))

            _, _, text, place, first = _sorted_anchors(ids, offsets, data, length, gram)
            around(text[~first], place[~first])
            for r in _rows(right):
                columns = unpack_columns(r["blob"])
                text = columns[0]
                if r["kind"] == FULL:
                    around(text, columns[1])
                else:
                    low = offsets[text] + columns[1]
                    add(low, low + length)
            gone = np.cumsum(edge[:-1]) > 0
            turn = gone.copy()
            turn[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            turn[inner] = gone[inner]
            total, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, turn))
            for k in range(len(ids)):
                a, b = offsets[k], offsets[k + 1]
                n = int(total[k + 1] - total[k])
                kept = data[a:b] if not n else data[a:b][~gone[a:b]]
                for column, value in zip(result, (int(ids[k]), int(b - a), n, int(runs[k + 1] - runs[k]), hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    column.append(value)
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        return pa.table({n: pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, result, strict=True)})

    return packed.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
