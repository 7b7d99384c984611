"""Token ids in a binary file format, compressed by Re-Pair per shard, with random access to documents.

A shard holds the ids of consecutive documents. Rounds of Re-Pair replace its frequent neighbouring pairs by
nonterminals until none pays for a rule; pairs never cross a document's end, so each document is a slice of
the compressed sequence. The rules and the expansion length of every rule are stored: a document, or a range of it, is
decoded by expanding only its own slice.

File format (one binary value a shard, little endian): magic ``TGRP``, then six unsigned 32-bit numbers
(version, terminals, rules, sequence length, documents, bits of a symbol), then rule pairs (symbols left,
right), rule expansion lengths (uint32), document offsets into the sequence (uint32, documents + 1), document
lengths in tokens (uint32), document ids (int64; the null flags follow as bytes), and the sequence. Symbols
are stored as their low 16 bits (uint16 each), then a bit plane for each further bit. Shards are rows (part, seq) of a Parquet data set, in ascending doc_id order.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch_path
from .common import claim, id_text, pieces, prefix_hash, raw, span_hash

MAGIC, VERSION = b"TGRP", 2
END_ID = 2
#: Tokens after which a shard is closed (a single longer document still goes whole into one).
SHARD_TOKENS = 1 << 21
#: A pair becomes a rule if so many replacements are left for it: with 17 bits a symbol and 32 for the rule's
#: expansion length a rule costs 66 bits, and four replacements save 68.
MIN_PAIRS = 4
#: Chunks a task remembers before it starts afresh.
REMEMBER = 600_000
#: Longer chunks are not told apart by hashes.
LONG_CHUNK = 256
# What the normaliser and the splitter must be for chunks to be independent.
NORMALIZER = [("NFC", None, None, None, None), ("Replace", r"\s+", None, None, None), ("Lowercase", None, None, None, None)]
SPLITTER = [
    ("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", None, None),
    ("ByteLevel", None, None, False, False),
]
_LATIN = [chr(c) for c in range(256)]
LATIN_LOWER = np.array([ord(c.lower()) for c in _LATIN], np.uint8)
#: Where that splitter always cuts: punctuation (no apostrophe) after a letter.
LATIN_LETTER = np.array([bool(re.match(r"[^\W\d_]", c)) for c in _LATIN])
LATIN_PUNCTUATION = np.array([bool(re.match(r"[^\w\s']", c)) for c in _LATIN])


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), dtype=bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _every_other(at: np.ndarray) -> np.ndarray:
    """1 for every second position of each run of consecutive positions, else 0."""
    k = np.arange(len(at))
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1] + 1
    return (k - np.maximum.accumulate(np.where(first, k, 0))) & 1


def repair(seq: np.ndarray, terminals: int, min_pairs: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(compressed sequence, rule pairs). The last terminal marks a document's end and is in no rule.

    Each round ranks all pairs that occur min_pairs times by their count and replaces the occurrences that no
    better-ranked neighbour overlaps; a pair that is left with fewer makes no rule. A pair's count can only
    grow if one of its symbols is new, so a round looks at the pairs next to what the last one made and at
    those that lost, no others. Rounds go on until no pair pays for its rule.
    """
    end, none = terminals - 1, np.uint32(0xFFFFFFFF)
    sym = np.append(seq.astype(np.uint32), np.uint32(end))  # a mark closes the shard
    rank = np.full(len(sym) + 1, none, np.uint32)  # rank[i + 1] is position i's
    live = np.flatnonzero((sym[:-1] != end) & (sym[1:] != end))
    rules, made = [np.zeros((0, 2), np.uint32)], 0
    while len(live):
        # pairs with their positions in one number each, sorted; shards are small enough for that
        place_bits, symbol_bits = len(sym).bit_length(), (terminals + made).bit_length()
        if place_bits + 2 * symbol_bits > 64:
            raise ValueError("the shard is too long")
        packed = (((sym[live].astype(np.uint64) << np.uint64(symbol_bits)) | sym[live + 1]) << np.uint64(place_bits)) | live.astype(np.uint64)
        packed.sort()
        key = packed >> np.uint64(place_bits)
        first = _starts(key)
        size = np.diff(np.append(first, len(key)))
        often = size >= min_pairs
        if not often.any():
            break
        pair, count = key[first[often]], size[often]
        at = (packed[np.repeat(often, size)] & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        one, two = pair >> np.uint64(symbol_bits), pair & np.uint64((1 << symbol_bits) - 1)
        odd = np.zeros(len(at), np.uint32)
        twin = one == two
        if twin.any():  # of a run of one symbol every other pair can be replaced
            own = np.flatnonzero(np.repeat(twin, count))
            odd[own] = _every_other(at[own])
            possible = np.add.reduceat(1 - odd.astype(np.int64), np.cumsum(count) - count)
            fine = possible >= min_pairs
            if not fine.any():
                break
            at, odd = at[np.repeat(fine, count)], odd[np.repeat(fine, count)]
            one, two, count = one[fine], two[fine], count[fine]
        place = np.empty(len(count), np.uint32)
        place[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
        group, value = np.repeat(np.arange(len(count)), count), np.repeat(place * np.uint32(2), count) + odd
        a, v, g, limit = at, value, group, 2 * len(count)
        while True:
            rank[a + 1] = v
            won = (v < rank[a]) & (v < rank[a + 2])
            rank[a + 1] = none
            wins = np.bincount(g[won], minlength=len(count))
            good = wins >= min_pairs
            if good.any():
                break
            # too many get in each other's way: the best ones alone (the very best always wins)
            limit = max(limit // 8, 2)
            some = value < limit
            a, v, g = at[some], value[some], group[some]
        won &= good[g]
        hit = a[won]
        name = (np.cumsum(good) - 1 + terminals + made).astype(np.uint32)
        rules.append(np.stack([one[good], two[good]], axis=1).astype(np.uint32))
        made += int(good.sum())
        sym[hit] = name[g[won]]
        stays = np.ones(len(sym), dtype=bool)
        stays[hit + 1] = False
        after = np.cumsum(stays, dtype=np.int32)  # of what stays: one more than the new position
        mark = np.zeros(len(sym) + 1, dtype=bool)
        mark[after[at[stays[at]]]] = True
        mark[after[hit]] = True
        mark[after[hit] - 1] = True
        sym = sym[stays]
        rank = rank[: len(sym) + 1]
        live = np.flatnonzero(mark[1 : len(sym)])
        live = live[(sym[live] != end) & (sym[live + 1] != end)]
    return sym[:-1], np.concatenate(rules)


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    size = np.ones(terminals + len(rules), np.int64)
    low = 0
    while low < len(rules):  # rules of a round only name earlier symbols
        high = low + int(np.searchsorted(np.maximum.accumulate(rules[low:].max(axis=1)), terminals + low))
        size[terminals + low : terminals + high] = size[rules[low:high, 0]] + size[rules[low:high, 1]]
        low = high
    return size[terminals:]


def _write_symbols(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each symbol, then a bit plane for each further bit."""
    out = [(symbols & np.uint32(0xFFFF)).astype("<u2").tobytes()]
    out += [np.packbits(((symbols >> np.uint32(k)) & np.uint32(1)).astype(bool), bitorder="little").tobytes() for k in range(16, bits)]
    return b"".join(out)


def pack(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, terminals: int) -> bytes:
    """One shard: ``terminals`` counts the vocabulary and, as the last, the mark for a document's end."""
    tokens = tokens.astype(np.uint32)
    tokens[np.cumsum(lengths) - 1] = terminals - 1
    seq, rules = repair(tokens, terminals)
    size = rule_lengths(rules, terminals)
    ends = np.flatnonzero(seq == terminals - 1) + 1
    offsets = np.concatenate([[0], ends]).astype("<u4")
    bits = (terminals + len(rules) - 1).bit_length()
    head = MAGIC + struct.pack("<6I", VERSION, terminals, len(rules), len(seq), len(ids), bits)
    null = np.array([i is None for i in ids], np.uint8)
    known = np.array([0 if i is None else i for i in ids], "<i8")
    return b"".join([head, _write_symbols(rules.reshape(-1), bits), size.astype("<u4").tobytes(), offsets.tobytes(), lengths.astype("<u4").tobytes(), known.tobytes(), null.tobytes(), _write_symbols(seq, bits)])


class Shard:
    """Read side of one shard: documents are decoded independently of each other."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        version, terminals, n_rules, n_seq, n_docs, bits = struct.unpack_from("<6I", blob, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        def symbols(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for k in range(16, bits):
                out |= np.unpackbits(take("u1", -(-n // 8)), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
            return out

        self.terminals = terminals
        self.rules = symbols(2 * n_rules).reshape(-1, 2)
        self.size = np.concatenate([np.ones(terminals, np.int64), take("<u4", n_rules).astype(np.int64)])
        self.offsets = take("<u4", n_docs + 1).astype(np.int64)
        self.lengths = take("<u4", n_docs).astype(np.int64)
        known = take("<i8", n_docs)
        null = take("u1", n_docs)
        self.ids: list[int | None] = [None if z else int(i) for i, z in zip(known, null, strict=True)]
        self.seq = symbols(n_seq)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Terminals of a few symbols: rules are opened level by level, no others are looked at."""
        while (symbols >= self.terminals).any():
            rule = symbols >= self.terminals
            out = np.empty(len(symbols) + int(rule.sum()), np.uint32)
            at = np.arange(len(symbols)) + np.cumsum(rule) - rule
            opened = self.rules[symbols[rule] - self.terminals]
            out[at[~rule]] = symbols[~rule]
            out[at[rule]], out[at[rule] + 1] = opened[:, 0], opened[:, 1]
            symbols = out
        return np.where(symbols == self.terminals - 1, np.uint32(END_ID), symbols)

    def tokens(self) -> np.ndarray:
        """Of the whole shard: every rule is expanded once."""
        t, size = self.terminals, self.size
        begin = np.concatenate([np.arange(t), t + np.cumsum(size[t:]) - size[t:]])
        flat = np.zeros(t + int(size[t:].sum()), np.uint32)
        flat[:t] = np.arange(t)
        flat[t - 1] = END_ID

        def gather(symbols: np.ndarray) -> np.ndarray:
            each = size[symbols]
            stop = np.cumsum(each)
            return flat[np.repeat(begin[symbols] - (stop - each), each) + np.arange(int(stop[-1]) if len(stop) else 0)]

        low = 0
        while low < len(self.rules):  # a run of rules that only name earlier symbols is expanded at once
            high = low + int(np.searchsorted(np.maximum.accumulate(self.rules[low:].max(axis=1)), t + low))
            text = gather(self.rules[low:high].reshape(-1))
            start = int(begin[t + low])
            flat[start : start + len(text)] = text
            low = high
        return gather(self.seq)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens [start, stop) of the shard's k-th document; expands only the symbols that cover them."""
        own = self.seq[self.offsets[k] : self.offsets[k + 1]]
        stop = int(self.lengths[k]) if stop is None else min(stop, int(self.lengths[k]))
        ends = np.cumsum(self.size[own])
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[start - skipped : max(start, stop) - skipped]


class _Slots(dict):
    """Chunk -> slot; a new chunk takes the next slot and is noted for learning."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = slot = len(self)
        self.new.append(chunk)
        return slot


class _Learned:
    """Ids of the chunks met so far, end to end; slot 0 stands for a document's end."""

    def __init__(self):
        self.flat, self.size, self.begin = np.array([END_ID], np.uint32), np.array([1]), np.array([0])

    def add(self, found: list[list[int]]) -> None:
        self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32)])
        self.begin = np.cumsum(self.size) - self.size

    def ids(self, slots: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots end to end; ids of each text, whose last slots are ``ends``)."""
        each = self.size[slots]
        stop = np.cumsum(each)
        out = self.flat[np.repeat(self.begin[slots] - (stop - each), each) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return out, np.diff(np.concatenate([[0], stop[ends]]))


class _Encoder:
    """Exact ids of whole texts, by way of distinct chunks that are encoded once and remembered.

    That holds for tokenizers that fold white space, compose, lower-case and then split letters from
    punctuation: a chunk between blanks is then independent of the others. The file's normaliser and splitter
    are checked at load; any other tokenizer encodes whole texts. Texts of Latin-1 characters are cut by
    tables, before punctuation that follows a letter too, and their chunks are told apart by 64-bit hashes;
    texts with other characters or very long chunks go by strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.terminals = self.tokenizer.get_vocab_size() + 1
        spec = json.loads(self.tokenizer.to_str())
        self.by_chunk = [_shape(spec.get("normalizer")), _shape(spec.get("pre_tokenizer"))] == [NORMALIZER, SPLITTER]
        self.bytes = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self._reset()

    def _reset(self) -> None:
        self.slots = _Slots({None: 0})
        self.slots.new = []
        self.strings, self.hashed = _Learned(), _Learned()
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        """Ids of lower-case or other chunks; those of Latin-1 letters alone go to the library's model directly."""
        tokenize, own = self.tokenizer.model.tokenize, self.bytes
        found: list[list[int] | None] = []
        others = []
        for chunk in chunks:
            if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0100"):
                word = chunk.lower()
                found.append([t.id for t in tokenize(word if word.isascii() else word.translate(own))])
            else:
                others.append((len(found), chunk))
                found.append(None)
        encoded = self.tokenizer.encode_batch_fast([c for _, c in others], add_special_tokens=False)
        for (k, _), x in zip(others, encoded, strict=True):
            found[k] = x.ids
        return found

    def _by_strings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [[*t.replace("\n", " ").split(" "), None] for t in texts]
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(chunks)), np.int64)
        if self.slots.new:
            new, self.slots.new = self.slots.new, []
            self.strings.add(self._learn(new))
        return self.strings.ids(slots, np.cumsum([len(own) for own in chunks]) - 1)

    def _by_tables(self, low: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = span_hash(prefix_hash(low), start, end)
        distinct, which, slot = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        own = np.empty(len(distinct), np.int64)
        own[known] = self.slot[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            body = low.tobytes().decode("latin-1")
            own[new] = len(self.hashed.size) + np.arange(len(new))
            self.hashed.add(self._learn([body[a:b] for a, b in zip(start[which[new]].tolist(), end[which[new]].tolist(), strict=True)]))
            self.keys, self.slot = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.slot, own[new]])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.slot = self.keys[order], self.slot[order]
        upto = np.searchsorted(start, offsets[1:])  # chunks up to each text's end
        ends = upto + np.arange(len(upto))
        slots = np.zeros(len(start) + len(upto), np.int64)
        chunk = np.ones(len(slots), dtype=bool)
        chunk[ends] = False
        slots[chunk] = own[slot]
        return self.hashed.ids(slots, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each followed by END_ID; number of ids of each text). Nulls are empty."""
        if not self.by_chunk:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found)) + 1
            return np.fromiter(chain.from_iterable([*own, END_ID] for own in found), np.uint32, int(size.sum())), size
        if len(self.slots) + len(self.keys) > REMEMBER:
            self._reset()
        data, offsets = raw(texts)
        odd = np.zeros(len(offsets) - 1, dtype=bool)
        beyond = np.flatnonzero(data > 0xC3)  # not Latin-1
        angle = np.flatnonzero(data == ord("<"))  # a special token may be spelled there
        angle = angle[(angle + 1 < len(data)) & (data[np.minimum(angle + 1, max(len(data) - 1, 0))] == ord("|"))]
        odd[np.searchsorted(offsets, np.concatenate([beyond, angle]), side="right") - 1] = True
        low, edges, start, end = _cut(data, offsets)
        odd[np.searchsorted(edges, start[end - start > LONG_CHUNK], side="right") - 1] = True
        if not odd.any():
            return self._by_tables(low, edges, start, end)
        rest, few = np.flatnonzero(~odd), np.flatnonzero(odd)
        out, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(rest):
            data, offsets = raw(texts.take(pa.array(rest)))
            low, edges, start, end = _cut(data, offsets)
            out, size = self._by_tables(low, edges, start, end)
        more, sizes = self._by_strings([t or "" for t in texts.take(pa.array(few)).to_pylist()])
        out, each = np.concatenate([out, more]), np.empty(len(odd), np.int64)
        each[rest], each[few] = size, sizes
        begin = np.empty(len(odd), np.int64)
        begin[np.concatenate([rest, few])] = np.cumsum(np.concatenate([size, sizes])) - np.concatenate([size, sizes])
        stop = np.cumsum(each)
        return out[np.repeat(begin - (stop - each), each) + np.arange(int(stop[-1]))], each


def _shape(part: dict | None):
    """What a normaliser or splitter does: types, with the patterns they look for."""
    if part is None:
        return None
    inner = part.get("normalizers") or part.get("pretokenizers")
    return [_shape(x) for x in inner] if inner else (part["type"], (part.get("pattern") or {}).get("Regex"), part.get("behavior"), part.get("add_prefix_space"), part.get("use_regex"))


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case Latin-1 codes, text offsets in them, starts and ends of chunks) of UTF-8 bytes; texts with
    other characters come out as nonsense of their own."""
    lead = (data & 0xC0) != 0x80
    code = data.copy()
    two = np.flatnonzero(data >= 0xC2)
    two = two[two + 1 < len(data)]
    code[two] = ((data[two] & 3) << 6) | (data[two + 1] & 0x3F)
    low = LATIN_LOWER[code[lead]]
    edges = np.concatenate([[0], np.cumsum(lead)])[offsets]
    gap = (low == 0x20) | (low == 0x0A)
    first = np.zeros(len(low) + 1, dtype=bool)
    first[edges[:-1]] = True
    cut = first[:-1].copy()
    cut[1:] |= gap[:-1] | (LATIN_PUNCTUATION[low[1:]] & LATIN_LETTER[low[:-1]])
    start = np.flatnonzero(~gap & cut)
    last = np.ones(len(low), dtype=bool)
    last[:-1] = gap[1:] | cut[1:]
    return low, edges, start, np.flatnonzero(~gap & last) + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write(docs: DataFrame, tokenizer_file: str, path: str) -> None:
    """Encode every whole text, END_ID after each, and write the shards below ``path`` in doc_id order.

    Null texts count as empty; null ids come first; rows of equal id are ordered by their text; an empty
    table writes no shard.
    """

    def run(batches):
        claim("tokenids", encoder.cache_clear)
        coder = encoder(tokenizer_file)
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, tokens, held = [], [], [], 0

        def shard():
            nonlocal seq, ids, lengths, tokens, held
            size = np.concatenate(lengths)
            blob = pack(ids, size, np.concatenate(tokens), coder.terminals)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_tokens", "shard"])
            seq, ids, lengths, tokens, held = seq + 1, [], [], [], 0
            return row

        for some, texts in pieces(batches, 1 << 21):
            out, size = coder.encode(texts)
            ids += some.to_pylist()
            lengths.append(size)
            tokens.append(out)
            held += len(out)
            if held >= SHARD_TOKENS:
                yield shard()
        if ids:
            yield shard()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, seq int, n_tokens long, shard binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema("part int, seq int, n_tokens long, shard binary").parquet(path)

    def run(batches):
        for batch in batches:
            for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(blob.as_py())
                flat = shard.tokens().astype("<u4")
                stop = np.cumsum(shard.lengths)
                begin = stop - shard.lengths
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.ids, pa.int64()), pa.array(begin), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"])

    found = shards.select("part", "seq", "shard").mapInArrow(run, "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    # two-level prefix sum: a row a part, then the shards inside a part
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    offsets = shards.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("offset"))
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def documents(spark, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents, ids with the end id: random access. Only their own slices of the shards
    that hold them are expanded; unknown ids give no row, repeated ids a row each."""
    shards = spark.read.schema("part int, seq int, n_tokens long, shard binary").parquet(path).select("shard")
    asked = set(wanted)

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                shard = Shard(blob.as_py())
                hits = [k for k, i in enumerate(shard.ids) if i in asked]
                yield pa.RecordBatch.from_arrays([pa.array([shard.ids[k] for k in hits], pa.int64()), pa.array([shard.document(k).tolist() for k in hits], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards (to the shared folder unless ``path`` is given) and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_file, path)
    return read(docs.sparkSession, path)
