"""Operators that compare texts with each other, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import zstandard
import pytest
import xxhash

from tidegraph.llm import components, decontaminate, neighbours, ngrams, simhash, suffixes

from .conftest import words


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(30), 100, 301]:
        for letters in (1, 2, 200):
            s = rng.integers(0, letters, n)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("crowd", [1, 2048])
def test_removals(docs, corpus, none, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    seen, want = set(), {}
    for i, t in sorted(corpus):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - 99):
            if body[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(body[s : s + 100])
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(body)))
        want[i] = (len(body), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(body, gone, strict=True) if not g)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in suffixes.removals(docs).collect()} == want
    assert suffixes.removals(none).count() == 0


def simhashes(rows, k):
    out = {}
    for i, t in rows:
        w = words(t)
        shingles = [b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_messages_of_a_block_do_not_multiply():
    """Each bucket hears once of a kind from a block, and of a window once, however many buckets asked."""
    rng = np.random.default_rng(2)
    body, offsets = rng.integers(97, 105, 4000).astype(np.uint8), np.array([0, 0, 1500, 1550, 4000])
    row = {"block": 5, "ids": np.array([3, 6, 9, 12]).tobytes(), "offsets": offsets.tobytes(), "body": zstandard.compress(body.tobytes())}
    at = np.sort(rng.choice(1400, 120, replace=False)).astype(np.int32)
    ask = lambda kind, k: (kind, [np.full(len(at[k::12]), 1, np.int32), at[k::12], np.full(len(at[k::12]) * (kind == suffixes.SHARED), k, np.uint64)])
    asked = [ask(kind, k) for k in range(12) for kind in (suffixes.SHARED, suffixes.CROWDED)]
    out = list(suffixes._messages([row], asked, 12, 100, 60))
    assert len(out) == 24 and {(b, k) for b, _, k, _ in out} == {(b, k) for b in range(12) for k in (suffixes.SHARED, suffixes.CROWDED)}
    heard = [tuple(x) for _, _, k, blob in out if k == suffixes.CROWDED for x in zip(*(c.tolist() for c in suffixes.unpack_columns(blob)), strict=True)]
    want = {s for p in at.tolist() for s in range(max(p - 60, 0), min(p + 100, 1500) - 99)}
    assert sorted(x[3] for x in heard) == sorted(want) and {x[1:3] for x in heard} == {(6, 1)}
    value = {s: int(suffixes.span_hash(suffixes.prefix_hash(body[s : s + 100]), np.array([0]), np.array([100]))[0]) for s in want}
    assert {x[3]: x[0] for x in heard} == value


def test_simhash_groups(docs, corpus, none):
    fp = simhashes(corpus, 3)
    component = classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.groups(docs).collect()}
    assert got == {i: (fp[i], component[i]) for i in fp}
    assert simhash.groups(none).count() == 0


def test_simhash_rows_without_id_and_repeats(spark, none):
    """Null ids, equal rows, one id on two texts, and names that the operator uses itself."""
    texts = [" ".join(f"{k}w{j}" for j in range(30)) for k in range(4)]
    rows = [(5, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (9, texts[3]), (9, texts[2] + " x"), (4, None), (3, "")]
    df = spark.createDataFrame([(i, t, 1, "m", [0]) for i, t in rows], "doc_id long, text string, id int, mark string, bands array<int>")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect())
    assert got.total() == 10 and got[None, 5] == 1 and got[None, None] == 2 and got[7, 7] == 2 and got[4, 3] == 1
    kept = simhash.deduplicate(df, 5)
    assert kept.columns == df.columns
    left = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
    assert left == sorted([("5", texts[0]), ("None", texts[1]), ("7", texts[2]), ("3", "")])
    assert simhash.deduplicate(none, 5).columns == none.columns and simhash.deduplicate(none, 5).count() == 0


def test_wide_radius_finds_similar_texts(spark):
    rng = random.Random(7)
    rows, pairs = [], []
    for k in range(40):
        w = [str(rng.randrange(10**6)) for _ in range(150)]
        rows.append((2 * k, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(150)] = "other"
        rows.append((2 * k + 1, " ".join(w)))
        pairs.append((2 * k, 2 * k + 1))
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, simhash.WIDE_RADIUS, simhash.BANDS).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 39 and all(got[a] == a for a, _ in pairs)


def test_near_duplicates_are_those_of_similarity(spark):
    """Against brute force, with pairs on both sides of 0.8, chains, copies, repeated shingles and empty texts."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        w = [str(rng.randrange(10**5)) for _ in range(rng.choice([3, 5, 9, 40, 150]))] * (1 + k % 3 // 2)
        for _ in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = str(rng.randrange(10**5))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    share = {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a in sets for b in sets}
    assert sum(0.6 <= x < 0.8 for x in share.values()) > 20 and sum(0.8 <= x < 1 for x in share.values()) > 20
    want = classes(sorted(sets), lambda a, b: share[a, b] >= 0.8 or not sets[a] | sets[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.groups(df, 5, simhash.WIDE_RADIUS, simhash.BANDS).collect()} == want
    assert {r["doc_id"] for r in simhash.deduplicate(df, 5, simhash.WIDE_RADIUS, simhash.BANDS).collect()} == set(want.values())


def test_large_key_groups(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_GROUP", 100)
    rng = np.random.default_rng(0)
    fp = np.unique(rng.integers(0, 1 << 40, 400).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, fp ^ np.uint64(2), fp[:99] ^ np.uint64(7)]))
    want = classes(range(len(fp)), lambda a, b: (int(fp[a]) ^ int(fp[b])).bit_count() <= 3)
    for split in (0, 2):
        links = {frozenset(x) for x in simhash._forest(fp, 3, split)}
        assert classes(range(len(fp)), lambda a, b: frozenset((a, b)) in links) == want
    key = np.stack([fp.astype(np.int64) >> 36, np.zeros(len(fp), np.int64)], axis=1)
    calls = []
    real = simhash._Distances.add
    monkeypatch.setattr(simhash._Distances, "add", lambda self, planes: (calls.append(len(planes)), real(self, planes)))
    order = np.argsort(key[:, 0], kind="stable")
    a, b = simhash._group_links(key[order], fp[order], np.arange(len(fp)), 3)
    links = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
    own = fp[order]
    assert classes(range(len(fp)), lambda i, j: frozenset((i, j)) in links) == classes(range(len(fp)), lambda i, j: int(own[i]) >> 36 == int(own[j]) >> 36 and (int(own[i]) ^ int(own[j])).bit_count() <= 3)
    assert calls  # every comparison goes through the vertical counters
    for shift in (1, 3, 8, 9, 17):
        meet = np.ones(len(fp) - shift, dtype=bool)
        assert simhash.within_shift(simhash.planes(fp), shift, meet, 31).tolist() == [i for i in range(len(fp) - shift) if (int(fp[i]) ^ int(fp[i + shift])).bit_count() <= 31]
    vertical = simhash.planes(fp)
    assert simhash.within(vertical, len(fp), int(fp[5])).tolist() == [j for j in range(len(fp)) if (int(fp[5]) ^ int(fp[j])).bit_count() <= 3]


def test_links_grow_with_the_fingerprints(spark):
    """A group of n linked fingerprints gives n - 1 rows, not its pairs, and keeps every link."""
    bits = [1 << k for k in range(60)]  # two bits apart from each other
    df = spark.createDataFrame([(fp, 500 + k, [7, 8, 9]) for k, fp in enumerate(bits)] + [((1 << 60) - 1, 1, [7, 8, 9])], "fp long, rep long, bands array<long>")
    got = [tuple(r) for r in simhash.links(df, simhash.WIDE_RADIUS, True).collect()]
    assert len(got) <= 3 * 59 and set(got) == {(500, 500 + k) for k in range(1, 60)}
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 180), rng.integers(0, 300, 180)
    pairs = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
    ids = sorted({int(x) for x in (*a, *b)})
    want = classes(ids, lambda i, j: frozenset((i, j)) in pairs)
    assert {(int(x), int(y)) for x, y in zip(*simhash._stars(a, b), strict=True)} == {(want[i], i) for i in ids if want[i] != i}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(7, None)]
    links = {frozenset(p) for p in pairs if p[1] is not None}
    ids = sorted({x for p in links if len(p) == 2 for x in p})
    want = classes(ids, lambda a, b: frozenset((a, b)) in links)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_decontamination(spark, docs, corpus, none):
    rng = random.Random(4)
    texts = dict(corpus)
    items = []
    for k, i in enumerate([0, 3, 9, 30]):
        w = texts[i].split()
        at = rng.randrange(max(1, len(w) - 16))
        items.append((k, " ".join(w[at : at + 15]).upper().replace("SS", "ß")))  # upper() spells ß as SS
    items += [(10, "none of these words occur anywhere here at all"), (11, "one TWO"), (12, ""), (13, None), (14, items[0][1]), (14, items[0][1])]

    def words_of(t):
        import regex

        return [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]

    w = texts[30].split()
    items += [(15, " ".join(w[7:10])), (16, w[3])]
    want = {}
    for i, t in corpus:
        for k, q in items:
            q = words_of(q)
            n = min(5, len(q))
            own, s = ({" ".join(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set() for x in (words_of(t), q))
            if s and len(s & own) >= 0.8 * len(s):
                want[i, k] = (len(s & own), len(s))
    assert any(k == 15 for _, k in want) and any(k == 16 for _, k in want)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and any(k == 11 for _, k in want)
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, _ in corpus} - {i for i, _ in want}
    hit = next(t for i, t in corpus if any((i, k) in want for k in range(4)))
    more = spark.createDataFrame([(None, hit, 1, "k"), (None, None, 2, "k"), (1, "x y", 3, "k")], "doc_id long, text string, item_id int, key string")
    left = decontaminate.clean(more, bench)
    assert left.columns == more.columns and sorted(r["item_id"] for r in left.collect()) == [2, 3]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 16))
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] + [1.0] * 15), (None, [1.0] * 16), (1400, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300}
    hits = 0
    for q, found in got.items():
        exact = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v[q], v[i], strict=True))), i) for i in range(400) if i != q)[:10]
        hits += len({i for i, _ in found} & {i for _, i in exact})
        assert [s for _, s in found] == sorted(s for _, s in found) and len(found) == 10
        assert all(abs(s - np.linalg.norm(v[q] - v[i])) < 1e-9 for i, s in found)
    assert [i for i, _ in got[0]] == list(range(50, 60)) and hits >= 36
    few = df.where("vec_id < 4")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 3
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0


def test_elias_fano_and_trie():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 56, 5000).astype(np.uint64))
    sequence, _ = ngrams.EliasFano.view(ngrams.EliasFano.encode(values))
    assert (sequence.values() == values).all() and (sequence.find(values) == np.arange(len(values))).all()
    asked = rng.integers(0, 1 << 57, 500).astype(np.uint64)
    assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
    empty, _ = ngrams.EliasFano.view(ngrams.EliasFano.encode(values[:0]))
    assert (empty.find(asked) == -1).all()
    counts = rng.integers(1, 500, len(values))
    trie = ngrams.Trie(memoryview(ngrams.Trie.build(values, counts)))
    assert (trie.counts(values) == ngrams.quantise(counts)).all() and (trie.counts(asked[~np.isin(asked, values)]) == 0).all()
    context = int(values[7] >> np.uint64(32))
    own = values[(values >> np.uint64(32)) == context] & np.uint64(2**32 - 1)
    assert trie.following(context)[0].tolist() == own.tolist()


def test_quantised_counts_have_no_ceiling():
    assert len(ngrams.CODES) <= 1 << 16 and (np.diff(ngrams.CODES) > 0).all()
    counts = np.concatenate([np.arange(2000), *(10**k * np.arange(1, 10) + 7 for k in range(3, 18)), [2**63 - 1]])
    told = ngrams.CODES[ngrams.quantise(counts)]
    assert (told[:1025] == counts[:1025]).all() and (told <= counts.astype(float)).all()
    assert (told >= counts * (1 - 1 / 1000)).all()
    trie = ngrams.Trie(memoryview(ngrams.Trie.build(np.arange(1, len(counts), dtype=np.uint64), counts[1:])))
    assert (trie.counts(np.arange(1, len(counts), dtype=np.uint64)) == ngrams.quantise(counts[1:])).all()


def test_scores(docs, corpus, none):
    tokens = {i: [*words(t), None] for i, t in corpus}
    single, pair = Counter(), Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            single.update(own)
            pair.update(zip([None, *own[:-1]], own, strict=True))
    n, v = sum(single.values()), len(single)
    got = {r["doc_id"]: r for r in ngrams.score(docs).collect()}
    assert set(got) == set(tokens)
    for i, own in tokens.items():
        base = [(single[w] + 0.5) / (n + 0.5 * (v + 1)) for w in own]
        model = [(ngrams.CODES[ngrams.quantise(np.array([pair[p, w]]))[0]] + ngrams.MU * b) / (single[p] + ngrams.MU) for p, w, b in zip([None, *own[:-1]], own, base, strict=True)]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(single[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, base))) and r["score"] == pytest.approx(sum(map(math.log10, model)), rel=1e-6)
    assert ngrams.score(none).count() == 0
