"""SimHash near-duplicate detection with bit-sliced distance counting.

Fingerprints of equal value are merged first, so copies never meet each other again. Distinct fingerprints
within ``radius`` bits must agree on one of the keys made from all but ``radius`` of the bit blocks
(pigeonhole, exact); within a key, distances are counted on vertical bit planes with carry-save adders, and
a block of candidates is abandoned once every lane exceeds the radius. Each key group reports a spanning
forest of its links, not its pairs.

Pigeonhole keys grow too many beyond a few bits. For a wide radius (copies with edits, similarity 0.8) the
candidates come from MinHash bands of the same shingles instead, and the same bit-sliced comparison drops
chance meetings. They decide nothing: the members of a component of candidates are compared by their shingle
sets, and only pairs of Jaccard similarity 0.8 or more are links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import claim, id_text, mix64, pieces, raw, words_of
from .components import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
#: Key groups up to this size share bit planes, which are compared with themselves shifted by 1, 2, ... lanes;
#: larger ones have planes of their own, which are compared with one fingerprint after the other.
SHARED_GROUP = 64
#: Bytes of lanes (eight to a byte) that are abandoned together.
BLOCK = 64
#: A larger key group is split again on its remaining bits.
LARGE_GROUP = 1 << 14
#: Candidates of similar texts: pairs of similarity 0.8 are 10 bits apart on average (deviation 3), so none is
#: beyond the radius, and the MinHash bands miss three in a million of them.
WIDE_RADIUS, BANDS, BAND_ROWS = 31, 24, 4
#: Bytes of text hashed at once; a longer text goes by itself.
SLICE_BYTES = 1 << 18


def _hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, where each text's begin, how many each has)."""
    norm, starts, before = words_of(*raw(texts))
    body = norm.tobytes()
    counts = np.diff(before)
    each = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=first[1:])
    word = np.arange(first[-1]) - np.repeat(first[:-1], each) + np.repeat(before[:-1], each)
    last = np.minimum(word + shingle, np.repeat(before[1:], each))
    digest = xxhash.xxh64_intdigest
    cut = zip(starts[word].tolist(), (starts[last] - 1).tolist(), strict=True)
    return np.fromiter((digest(body[a:b], SEED) for a, b in cut), np.uint64, len(word)), first, each


def _distinct(hashes: np.ndarray, first: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with each text's shingle hashes sorted and without repeats."""
    text = np.repeat(np.arange(len(each)), each)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    each = np.bincount(text[new], minlength=len(each))
    return hashes[new], np.concatenate([[0], np.cumsum(each)]), each


def _set_marks(hashes: np.ndarray, first: np.ndarray, each: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's set of shingles; zero for none."""
    full = np.flatnonzero(each)
    out = np.zeros(len(each), np.uint64)
    if len(full):
        out[full] = mix64(np.add.reduceat(mix64(hashes), first[full]) + each[full].astype(np.uint64))
    return out


def _fingerprints(hashes: np.ndarray, first: np.ndarray, each: np.ndarray) -> np.ndarray:
    out = np.zeros(len(each), np.uint64)
    full = np.flatnonzero(each)
    # few columns at a time: the 64 counters of a long text never exist at once
    for bit in range(BITS):
        ones = ((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        sums = np.add.reduceat(ones, first[full]) if len(full) else ones
        out[full] |= (2 * sums > each[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _bands(hashes: np.ndarray, first: np.ndarray, each: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) keys: hashes of BAND_ROWS minima each, over the set of a text's shingles."""
    full = np.flatnonzero(each)
    out = np.zeros((len(each), bands), np.uint64)
    for k in range(bands * BAND_ROWS):
        least = np.zeros(len(each), np.uint64)
        if len(full):
            least[full] = np.minimum.reduceat(mix64(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)), first[full])
        out[:, k // BAND_ROWS] = mix64(out[:, k // BAND_ROWS] * np.uint64(31) + least)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each input row. Null or empty texts have fingerprint zero."""

    def run(batches):
        claim("simhash")
        for ids, texts in pieces(batches, SLICE_BYTES):
            fp = _fingerprints(*_hashes(texts, shingle)).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def sketches(rows: DataFrame, shingle: int, bands: int) -> DataFrame:
    """(id, fp, mark, bands) for (id, text), over the sets of shingles. Equal sets have equal marks."""

    def run(batches):
        claim("simhash")
        for ids, texts in pieces(batches, SLICE_BYTES):
            hashed = _distinct(*_hashes(texts, shingle))
            keys = _bands(*hashed, bands).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(_fingerprints(*hashed).view(np.int64)), pa.array(_set_marks(*hashed).view(np.int64)), lists], ["id", "fp", "mark", "bands"])

    return rows.select("id", "text").mapInArrow(run, "id long, fp long, mark long, bands array<long>")


def key_blocks(distinct: int, radius: int = RADIUS) -> int:
    """How many blocks to cut the 64 bits into: the keys keep all but ``radius`` of them.

    More blocks make longer keys and more tables; chosen so that a key expects at most 8 fingerprints.
    """
    for blocks in range(radius + 1, radius + 5):
        if distinct <= 8 * 2 ** (BITS * (blocks - radius) // blocks):
            break
    return blocks


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def planes(fp: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, each packed eight lanes to a byte."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


class _Distances:
    """Vertical counters of many lanes' distances; ``over`` latches lanes that are out, by distance or beforehand.

    Carry-save: planes of differing bits are added digit by digit. Blocks whose lanes are all out are
    abandoned. radius + 1 must be a power of two.
    """

    def __init__(self, over: np.ndarray, radius: int):
        blocks = -(-len(over) // BLOCK)
        self.size, self.blocks = len(over), blocks
        self.over = np.full((blocks, BLOCK), 0xFF, np.uint8)
        self.over.reshape(-1)[: len(over)] = over
        self.live = np.flatnonzero((self.over != 0xFF).any(axis=1))
        self.count = np.zeros(((radius + 1).bit_length() - 1, len(self.live), BLOCK), np.uint8)

    def add(self, differ: np.ndarray) -> None:
        """Some planes (planes, bytes) of differing bits."""
        wide = np.zeros((len(differ), self.blocks * BLOCK), np.uint8)
        wide[:, : self.size] = differ
        wide = wide.reshape(len(differ), self.blocks, BLOCK)[:, self.live]
        over = self.over[self.live]
        for carry in wide:
            for d in range(len(self.count)):
                self.count[d], carry = self.count[d] ^ carry, self.count[d] & carry
            over |= carry
        self.over[self.live] = over
        keep = (over != 0xFF).any(axis=1)
        self.live, self.count = self.live[keep], self.count[:, keep]

    def lanes(self, n: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(~self.over.reshape(-1)[: self.size], bitorder="little")[:n])


def within(vertical: np.ndarray, n: int, probe: int, radius: int = RADIUS) -> np.ndarray:
    """Lanes of ``vertical`` whose distance to ``probe`` is at most ``radius``."""
    found = _Distances(np.zeros(vertical.shape[1], np.uint8), radius)
    flip = np.array([0xFF if probe >> bit & 1 else 0 for bit in range(BITS)], np.uint8)[:, None]
    for bit in range(0, BITS, 8):
        if not len(found.live):
            break
        found.add(vertical[bit : bit + 8] ^ flip[bit : bit + 8])
    return found.lanes(n)


def within_shift(vertical: np.ndarray, shift: int, meet: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes i, of those that ``meet``, whose distance to lane i + shift is at most ``radius``."""
    n = len(meet)
    found = _Distances(~np.packbits(meet, bitorder="little"), radius)
    low, odd = divmod(shift, 8)
    for bit in range(0, BITS, 8):
        if not len(found.live):
            break
        own = vertical[bit : bit + 8]
        moved = np.zeros((own.shape[0], own.shape[1] + low + 2), np.uint8)
        moved[:, : own.shape[1]] = own
        one, two = moved[:, low : low + own.shape[1]], moved[:, low + 1 : low + 1 + own.shape[1]]
        found.add((own ^ ((one >> odd) | (two << (8 - odd)) if odd else one))[:, : found.size])
    return found.lanes(n)


def _forest(fp: np.ndarray, radius: int, split: int = 0) -> list[tuple[int, int]]:
    """Index pairs that span the links among the distinct fingerprints of one key group.

    Breadth first: a fingerprint meets only those that no link has reached yet, so tight groups shrink fast.
    """
    n = len(fp)
    if n > LARGE_GROUP and split < 2 and radius <= RADIUS:
        # again by pigeonhole, on finer blocks: the pieces overlap, their union loses no link
        found = []
        for mask in masks(radius + 2 + split, radius):
            key = fp & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for own in np.split(order, cuts):
                if 1 < len(own) < n:
                    found += [(int(own[a]), int(own[b])) for a, b in _forest(fp[own], radius, split + 1)]
                elif len(own) == n:
                    return _forest(fp, radius, 2)
        return found
    found = []
    rest = np.arange(n)
    packed, lanes = planes(fp), rest  # lanes: what the planes hold; some may be gone from rest
    queue: list[int] = []
    alive = np.ones(n, dtype=bool)
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            alive[rest[0]] = False
            rest = rest[1:]
        i = queue.pop()
        if 2 * len(rest) < len(lanes):
            packed, lanes = planes(fp[rest]), rest
        near = lanes[within(packed, len(lanes), int(fp[i]), radius)]
        near = near[alive[near]]
        if len(near):
            alive[near] = False
            found += [(i, int(j)) for j in near]
            queue += near.tolist()
            rest = rest[alive[rest]]
    return found


def _group_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys; rows are sorted by key and hold whole groups."""
    cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
    first = np.concatenate([[0], cuts])
    size = np.diff(np.concatenate([first, [len(fp)]]))
    shared = np.repeat((size > 1) & (size <= SHARED_GROUP), size)
    group, own, name = np.repeat(np.arange(len(size)), size)[shared], fp[shared], rep[shared]
    a, b = [], []
    vertical = planes(own)
    for shift in range(1, SHARED_GROUP):
        meet = group[shift:] == group[:-shift]
        if not meet.any():
            break
        near = within_shift(vertical, shift, meet, radius)
        a.append(name[near])
        b.append(name[near + shift])
    for g in np.flatnonzero(size > SHARED_GROUP):
        lo = first[g]
        for i, j in _forest(fp[lo : lo + size[g]], radius):
            a.append(rep[[lo + i]])
            b.append(rep[[lo + j]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id reachable, id) for every other id of the links: as many rows as ids at most, not as pairs."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    least = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(least, high, low)  # hooked to a smaller one, then all the way up
        while (least[least] != least).any():
            least = least[least]
        x, y = least[x], least[y]
        apart = x != y
        x, y = x[apart], y[apart]
    rest = np.flatnonzero(least != np.arange(len(ids)))
    return ids[least[rest]], ids[rest]


def links(distinct: DataFrame, radius: int = RADIUS, banded: bool = False) -> DataFrame:
    """(a, b): representatives of linked fingerprints, from ``distinct(fp, rep)``; spans every link.

    Of n linked fingerprints of a group come n - 1 rows, each with the smallest one's representative: groups that
    overlap tend to name the same centre, and what follows grows with the fingerprints, not with their pairs.

    If ``banded``, only those that share one of their ``bands`` are compared.
    """
    if banded:
        keyed = distinct.select(F.posexplode("bands").alias("t", "k"), "fp", "rep")
    else:
        blocks = key_blocks(distinct.count(), radius)
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in enumerate(masks(blocks, radius))])
        keyed = distinct.select(F.explode(keys).alias("key"), "fp", "rep").select("key.t", "key.k", "fp", "rep")

    def run(batches):
        held: list[np.ndarray] = []
        rows = 0

        def told(upto: bool):
            nonlocal held, rows
            all_ = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
            cut = len(all_)
            if not upto and cut:
                same = (all_[:, :2] == all_[-1, :2]).all(axis=1)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held, rows = [all_[cut:]], len(all_) - cut
            done = all_[:cut]
            if len(done):
                a, b = _stars(*_group_links(done[:, :2], np.ascontiguousarray(done[:, 2]).view(np.uint64), done[:, 3], radius))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns], axis=1))
            rows += batch.num_rows
            if rows > 1 << 17:
                yield from told(False)
        yield from told(True)

    dealt = keyed.repartition("t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(run, "a long, b long")


def _alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs that span the links of similarity 0.8 among sorted sets; exact.

    Breadth first, like ``_forest``; a set meets only those that share an element with it, by an index that is
    made anew when half of its sets have been reached.
    """
    size = np.array([len(x) for x in sets], np.int64)
    keys, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner, edge = np.repeat(np.arange(len(sets)), size), np.concatenate([[0], np.cumsum(size)])
    alive = np.ones(len(sets), dtype=bool)
    post, begin, held = owner, edge, 0
    found, queue, seed, left = [], [], 0, len(sets)
    while left:
        if not queue:
            while not alive[seed]:
                seed += 1
            alive[seed] = False
            queue.append(seed)
            left -= 1
        i = queue.pop()
        if 2 * left < held or not held:
            rows = np.flatnonzero(alive[owner])
            post = owner[rows[np.argsort(code[rows], kind="stable")]]
            begin = np.concatenate([[0], np.cumsum(np.bincount(code[rows], minlength=len(keys)))])
            held = max(left, 1)
        own = code[edge[i] : edge[i + 1]]
        start, many = begin[own], begin[own + 1] - begin[own]
        at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        met, shared = np.unique(post[at], return_counts=True)
        # shared / (size + size - shared) >= 4 / 5
        near = met[(9 * shared >= 4 * (size[met] + size[i])) & alive[met]]
        alive[near] = False
        left -= len(near)
        found += [(i, int(j)) for j in near]
        queue += near.tolist()
    return found


def _verified(rows: DataFrame, distinct: DataFrame, candidates: DataFrame, shingle: int) -> DataFrame:
    """(a, b): representatives of texts of similarity 0.8, spanning all such links within a component of candidates."""
    members = distinct.join(candidates.withColumnRenamed("id", "rep"), "rep").select(F.col("rep").alias("id"), "component")

    def hashed(batches):
        claim("simhash")
        for batch in batches:
            at = 0
            for ids, texts in pieces(iter([batch.select(["id", "text"])]), SLICE_BYTES):
                rest = batch.slice(at, len(ids))
                at += len(ids)
                sets = _distinct(*_hashes(texts, shingle))
                lists = pa.ListArray.from_arrays(pa.array(sets[1], pa.int32()), pa.array(sets[0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([rest.column("component"), ids, lists], ["component", "rep", "shingles"])

    def run(batches):
        claim("simhash")
        component, reps, sets = None, [], []

        def told():
            pairs = _alike(sets) if len(sets) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in pairs], pa.int64()), pa.array([reps[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column(2)
            edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (own, rep) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != component:
                    yield from told()
                    component, reps, sets = own, [], []
                reps.append(rep)
                sets.append(flat[edge[k] : edge[k + 1]])
        yield from told()

    texts = rows.join(members, "id").select("id", "text", "component")
    dealt = texts.mapInArrow(hashed, "component long, rep long, shingles array<long>").repartition("component").sortWithinPartitions("component", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def _classes(marks: DataFrame, key: str, own: DataFrame, found: DataFrame) -> DataFrame:
    """(key, class): ``own`` names each key's representative, ``found`` links representatives; an id that stands
    on several keys links them too."""
    ids = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("_least"), F.max(key).alias("_most")).where("_least <> _most").drop("_most")
    several = marks.join(ids, "doc_id").select(key, F.col("_least")).distinct()
    several = several.join(own.select(key, F.col("rep").alias("a")), key).join(own.select(F.col(key).alias("_least"), F.col("rep").alias("b")), "_least")
    label = components(found.unionByName(several.select("a", "b"))).withColumnRenamed("id", "rep")
    return own.join(label, "rep", "left").select(key, F.coalesce("component", "rep").alias("class"))


def _similar(rows: DataFrame, shingle: int, radius: int, bands: int) -> DataFrame:
    """(id, doc_id, fp, class) for written ``rows(id, doc_id, text)`` whose ids differ: classes of similar texts."""
    marks = materialize(sketches(rows, shingle, bands), "sketches")
    distinct = materialize(marks.groupBy("mark").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    found = _verified(rows, distinct, components(links(distinct, radius, True)), shingle)
    named = materialize(marks.select("id", "fp", "mark").join(rows.select("id", "doc_id"), "id"), "named")
    return named.join(_classes(named, "mark", distinct.select("mark", "rep"), found), "mark").select("id", "doc_id", "fp", "class")


def _numbered(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Written rows with a number of their own: equal rows and rows without an id can be told apart.

    With ``whole``, a struct of all columns comes along; the text is written once and read from there.
    """
    text = F.col("text").cast("string").alias("text")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole") if whole else text
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), kept), "numbered")
    return rows.withColumn("text", F.col("whole.text").cast("string")) if whole else rows


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bands: int = 0) -> DataFrame:
    """(doc_id, fp, component_id) for each input row.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits, itself included;
    with ``bands``, over links of texts whose sets of shingles have Jaccard similarity 0.8 or more. Rows without
    an id link like any other; a group of such rows alone has a null component_id. A repeated id keeps a row
    for each of its rows, whose texts all reach each other; an empty table gives none. Null and empty texts
    share fingerprint zero and link like any other; with ``bands``, only with each other. Texts of any length
    are read whole; extra columns are ignored.
    """
    if bands:
        named, key = _similar(_numbered(docs), shingle, radius, bands), "class"
        named = materialize(named, "classes")
    else:
        marks, key = materialize(fingerprints(docs, shingle), "fingerprints"), "class"
        distinct = materialize(marks.select("fp", F.col("fp").alias("rep")).distinct(), "distinct")
        named = marks.join(_classes(marks, "fp", distinct, links(distinct, radius)), "fp")
    least = named.groupBy(key).agg(F.min("doc_id").alias("component_id"))
    return named.join(least, key).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = WIDE_RADIUS, bands: int = BANDS) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that with the smallest id.

    Of rows with that id, and of rows without an id where no other is in the group, one stays. All columns,
    whatever their names, come out as they went in.
    """
    rows = _numbered(docs, whole=True)
    named = _similar(rows, shingle, radius, bands)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "id")
    stays = named.groupBy("class").agg(F.min(order).alias("o")).select(F.col("o.id").alias("id"))
    return rows.join(stays, "id", "left_semi").select("whole.*")
