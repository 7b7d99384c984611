"""Sampled SentencePiece segmentation by forward filtering and backward sampling; decoding is lossless.

A text is cut before every space; the lattice of a chunk holds every vocabulary piece that matches in it
(the piece mark stands for the space), and the UTF-8 byte pieces of characters that no piece covers. Forward
filtering sums the weights of all segmentations of each prefix, once for each distinct chunk; backward
sampling then draws pieces from the end with exactly their posterior probability. The random numbers are a
counter-based hash of the row's key, the chunk's place and the step, so a row's segmentation depends on
nothing but the row. No normalisation is applied: decoding gives the text back byte for byte.
"""

from __future__ import annotations

import functools
import zlib
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, mix64, pieces, prefix_hash, raw, span_hash, trim

MARK = "▁"
SEED = 20240601
#: Log weight of a piece: -SHARPNESS * log(rank + RANK_SHIFT), a Zipf prior over the vocabulary's merge order.
SHARPNESS, RANK_SHIFT = 1.0, 10.0
BYTE_WEIGHT = -12.0
#: Lattice edges a task remembers before it starts afresh.
REMEMBER = 600_000
#: Characters of new chunks that are filtered at once (a longer chunk goes by itself), and bytes of text sampled at once.
ADD_CHARS, SLICE_BYTES = 1 << 16, 1 << 18
TABLE_BITS = 20
#: Thresholds and random numbers have 53 bits.
FULL = 1 << 53


class Lattices:
    """Chunks' lattices after forward filtering, laid end to end for vectorised backward sampling.

    State s (a chunk's prefix) has the edges from ``begin[s]`` on, whose ``until`` are the cumulative
    posterior probabilities of the last piece as integers, up to FULL. ``back`` is the state before the piece; ``origin``
    marks the states before any piece.
    """

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.text: list[bytes] = [b""] * n
        self.weight = np.full(n, BYTE_WEIGHT)
        self.alone = np.zeros(0x110000, dtype=bool)  # characters that are pieces
        nodes: dict[bytes, int] = {}  # every prefix of a piece, and the piece it is (or -1)
        self.longest = 0
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.text[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                # the mark stands for a space; a chunk holds a space only as its first character
                plain = piece.replace(MARK, " ")
                self.text[i] = plain.encode()
                for k in range(1, len(plain)):
                    nodes.setdefault(plain[:k].encode(), -1)
                nodes[self.text[i]] = i
                self.weight[i] = -SHARPNESS * log(max(-sp.get_score(i), 0.0) + RANK_SHIFT)
                self.longest = max(self.longest, len(plain))
                if len(plain) == 1:
                    self.alone[ord(plain)] = True
        keys = list(nodes)
        ends = np.cumsum([len(k) for k in keys])
        hashes = span_hash(prefix_hash(np.frombuffer(b"".join(keys), np.uint8)), ends - [len(k) for k in keys], ends)
        # open addressing by the hash's top bits; probes is the longest chain
        self.slots = np.full(1 << TABLE_BITS, -1, np.int32)
        self.node_hash, self.node_piece = hashes, np.array(list(nodes.values()), np.int32)
        self.probes = 1
        for k, h in enumerate((hashes >> np.uint64(64 - TABLE_BITS)).tolist()):
            tries = 1
            while self.slots[h] >= 0:
                h = (h + 1) & ((1 << TABLE_BITS) - 1)
                tries += 1
            self.slots[h] = k
            self.probes = max(self.probes, tries)
        size = np.array([len(t) for t in self.text], np.int64)
        self.piece_size, self.piece_begin = size, np.cumsum(size) - size
        self.piece_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.final: dict[str, int] = {}
        self.states = 0
        self.until: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.piece: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.back: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.begin: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.origin: list[np.ndarray] = [np.zeros(0, dtype=bool)]

    def _nodes(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the prefix with each hash, or -1."""
        at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        for step in range(self.probes):
            found = self.slots[(at + step) & ((1 << TABLE_BITS) - 1)]
            hit = (found >= 0) & (self.node_hash[found] == hashes)
            out[hit] = found[hit]
        return out

    def add(self, names: list[str]) -> None:
        """Forward filtering of new chunks, all at once; ``final`` gets the state of each whole chunk.

        A chunk is named without its space; the name of one that has none ends in a space. Units are
        characters that are pieces, and the bytes of all others; states lie between units.
        """
        chunks = [c[:-1] if c[-1:] == " " else " " + c for c in names]
        joined = "".join(chunks)
        point = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        known = self.alone[point]
        width = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        per = np.where(known, 1, width)
        units = int(per.sum())
        unit_known = np.repeat(known, per)
        begin = np.zeros(units + 1, np.int64)
        np.cumsum(np.where(unit_known, np.repeat(width, per), 1), out=begin[1:])
        chars = np.array([len(c) for c in chunks], np.int64)
        stop = np.concatenate([[0], np.cumsum(per)])[np.cumsum(chars)]  # units up to each chunk's end
        size = np.diff(np.concatenate([[0], stop]))
        chunk = np.repeat(np.arange(len(chunks)), size)
        until = np.repeat(stop, size)
        prefix = prefix_hash(data)
        single = np.flatnonzero(~unit_known)
        start, length, piece = [single], [np.ones(len(single), np.int64)], [self.byte_ids[data[begin[single]]]]
        alive = np.flatnonzero(unit_known)
        for n in range(1, self.longest + 1):
            alive = alive[alive + n <= until[alive]]
            alive = alive[unit_known[alive + n - 1]]
            node = self._nodes(span_hash(prefix, begin[alive], begin[alive + n]))
            alive, node = alive[node >= 0], node[node >= 0]
            if not len(alive):
                break
            real = self.node_piece[node] >= 0
            start.append(alive[real])
            length.append(np.full(int(real.sum()), n))
            piece.append(self.node_piece[node[real]])
        # longest first: of a state's edges, the likely ones are then looked at before the others
        first, n, ids = np.concatenate(start[::-1]), np.concatenate(length[::-1]), np.concatenate(piece[::-1])
        source = first + chunk[first]
        target = source + n
        order = np.argsort(target, kind="stable")
        source, target, ids = source[order], target[order], ids[order]
        state_chunk = np.repeat(np.arange(len(chunks)), size + 1)
        depth = target - (np.cumsum(size + 1) - size - 1)[state_chunk[target]]
        forward = np.zeros(units + len(chunks))
        share = np.empty(len(ids))
        by_depth = np.argsort(depth, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])
        for d in range(1, len(edge) - 1):
            own = by_depth[edge[d] : edge[d + 1]]
            value = forward[source[own]] + self.weight[ids[own]]
            seg = np.flatnonzero(np.concatenate([[True], np.diff(target[own]) != 0]))
            many = np.diff(np.append(seg, len(own)))
            top = np.maximum.reduceat(value, seg)
            part = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(part, seg)
            forward[target[own[seg]]] = top + np.log(total)
            share[own] = part / np.repeat(total, many)
        new = np.concatenate([[True], np.diff(target) != 0]) if len(target) else np.zeros(0, dtype=bool)
        seg = np.flatnonzero(new)
        many = np.diff(np.append(seg, len(target)))
        # running sums inside each state, edge by edge: they depend on the chunk alone, not on its neighbours
        for j in range(1, int(many.max(initial=1))):
            at = seg[many > j] + j
            share[at] += share[at - 1]
        inside = (np.minimum(share, 1.0) * float(FULL)).astype(np.uint64)
        inside[seg + many - 1] = FULL  # a state's last edge ends its interval
        self.until.append(inside)
        first_edge = np.zeros(units + len(chunks), np.int32)
        first_edge[target[seg]] = len(self.piece[0]) + seg
        self.begin.append(first_edge)
        self.piece.append(ids.astype(np.int32))
        self.back.append((self.states + source).astype(np.int32))
        origin = np.zeros(units + len(chunks), dtype=bool)
        ends = np.cumsum(size + 1)
        origin[ends - size - 1] = True
        self.origin.append(origin)
        self.final.update(zip(names, (self.states + ends - 1).tolist(), strict=True))
        self.states += units + len(chunks)
        self.until, self.piece, self.back, self.begin, self.origin = ([np.concatenate(x)] for x in (self.until, self.piece, self.back, self.begin, self.origin))

    def sample(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts end to end, number of pieces of each text)."""
        if len(self.until[0]) > REMEMBER:
            self.reset()
        chunks = [(t or "").split(" ") for t in texts]
        for own in chunks:  # what stands before a text's first space is told apart by a trailing one
            if own[0]:
                own[0] += " "
            else:
                del own[0]
        final = self.final
        new = sorted(set().union(*chunks) - final.keys())
        part = np.cumsum([len(c) for c in new]) // ADD_CHARS
        for own in np.split(np.arange(len(new)), np.flatnonzero(np.diff(part)) + 1):
            if len(own):
                self.add(new[own[0] : own[-1] + 1])
        until, piece, back, begin, origin = self.until[0], self.piece[0], self.back[0], self.begin[0], self.origin[0]
        each = np.array([len(own) for own in chunks], np.int64)
        n = int(each.sum())
        state = np.fromiter(map(final.__getitem__, chain.from_iterable(chunks)), np.int32, n)
        place = np.arange(n) - np.repeat(np.cumsum(each) - each, each)
        key = mix64(np.repeat(keys, each) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        who = np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            u = mix64(key + np.uint64(step)) >> np.uint64(11)
            edge = begin[state]
            late = np.flatnonzero(until[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[until[edge[late]] <= u[late]]
            steps.append((who, piece[edge]))
            state = back[edge]
            more = ~origin[state]
            who, state, key = who[more], state[more], key[more]
            step += 1
        count = np.zeros(n, np.int64)
        for who, _ in steps:
            count[who] += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if n else 0, np.int32)
        for back_by, (who, ids) in enumerate(steps, 1):
            out[end[who] - back_by] = ids
        total = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(each)])]
        return out, np.diff(total)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.piece_size[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.piece_begin[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        return self.piece_bytes[at].tobytes()


@functools.lru_cache(maxsize=1)
def lattices(model_file: str) -> Lattices:
    return Lattices(model_file)


def encode(docs: DataFrame, model_file: str, ids: bool = True, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless[, ids]): a row for each input row.

    lossless: the pieces, decoded, equal the text's bytes (checked for every row). Null and empty texts have
    no pieces. Rows of equal key and text get the same segmentation; a null id is a key of its own.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + (", ids array<int>" if ids else "")

    def run(batches):
        claim("sentencepieces", lattices.cache_clear)
        model = lattices(model_file)
        for some, texts in pieces(batches, SLICE_BYTES):
            known = np.array([0 if i is None else (i & (2**64 - 1)) ^ 0x5851F42D4C957F2D for i in some.to_pylist()], np.uint64)
            out, count = model.sample(texts.to_pylist(), mix64(known + np.uint64(seed)))
            stop = np.cumsum(count)
            data, offsets = raw(texts)
            # all texts at once if that is right, else each by itself
            size = np.concatenate([[0], np.cumsum(model.piece_size[out])])
            same = size[np.concatenate([[0], stop])] == offsets
            fine = bool(same.all()) and model.decode(out) == data.tobytes()
            good = [True] * len(count) if fine else [model.decode(out[b - c : b]) == data[offsets[k] : offsets[k + 1]].tobytes() for k, (b, c) in enumerate(zip(stop.tolist(), count.tolist(), strict=True))]
            crc = [zlib.crc32(out[b - c : b]) for b, c in zip(stop.tolist(), count.tolist(), strict=True)]
            row = [some, pa.array(count), pa.array(crc, pa.int64()), pa.array(good)]
            names = ["doc_id", "n_pieces", "ids_crc32", "lossless"]
            if ids:
                row.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(out)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(row, names)
        model.reset()  # idle workers hold no lattices
        trim()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) from the columns doc_id and ids; a null list is an empty text."""

    def run(batches):
        model = lattices(model_file)
        for batch in batches:
            texts = [model.decode(np.array(i or [], np.int64)).decode("utf-8", "surrogatepass") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
