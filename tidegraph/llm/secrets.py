"""Secret scans with DataFrame functions alone.

Base rules are regular expressions. On top of them, every candidate string (a run of at least WINDOW
characters of the base64 alphabet) is scanned with a sliding window whose Shannon entropy is kept by
incremental counts: the window's counts, packed into a few numbers, travel along, and when it moves only the
counts of the character that leaves and the one that enters change. Thresholds go by character class; an
allow list suppresses whole candidates and parts of them that are high in entropy but harmless. Entropies are
integers scaled by SCALE, so results are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The rules, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
SCALE = 1_000_000
#: Candidates by character class: (name, pattern of the whole candidate, least entropy of a window in bits).
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.5),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: The characters of candidates; a window's counts are kept by their place here.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts (up to WINDOW, five bits each) that share a 64-bit number.
PER_LONG, COUNT_BITS = 12, 5
#: Harmless candidates as a whole: UUIDs, words and numbers joined by separators (which covers runs without a digit
#: or without a letter), separators alone.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[-_/=+]*(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*$",
    r"^[-_/=+]*$",
)
#: Harmless parts: placeholders and plain sequences. They count as one repeated character, so that only what
#: stands around them can be high in entropy.
ALLOW_PARTS = ("example", "placeholder", "changeme", "xxxxxx", "redacted", "abcdefghij", "0123456789", "1234567890")
FILLER = "="
#: Matches whose places are summed up together.
BLOCK = 64

_MATCHES = "array<struct<start:int,end:int,value:string>>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _f(count: int) -> int:
    """count * log2(count), scaled."""
    return round(count * math.log2(count) * SCALE) if count else 0


def least_sum(bits: float) -> int:
    """A window has at least ``bits`` of entropy if its sum of _f(counts) is at most this."""
    return round((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _blocks(items: Column) -> Column:
    """Numbers 0, 1, ... of the blocks of an array that is not empty."""
    return F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))


def _before(items: Column, zero: Column, own, fold) -> Column:
    """For each item the fold of all items before it, in two levels: by blocks, then inside each block."""

    def within(totals):
        def block(b):
            start = F.aggregate(F.slice(totals, F.lit(1), b), zero, fold)
            part = F.slice(items, b * BLOCK + 1, F.lit(BLOCK))
            return let(start, lambda at: F.transform(part, lambda x, i: F.aggregate(F.slice(part, F.lit(1), i), at, lambda acc, y: fold(acc, own(y)))))

        return F.flatten(F.transform(_blocks(items), block))

    totals = F.transform(_blocks(items), lambda b: F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), zero, lambda acc, y: fold(acc, own(y))))
    return F.when(F.size(items) > 0, let(totals, within)).otherwise(F.transform(items, lambda x: zero))


def _found(text: Column, pattern: str) -> Column:
    """[(start, end, value)] of the matches, in code points, end exclusive; empty without any."""

    def placed(pairs):
        starts = _before(pairs, F.lit(0), lambda p: F.length(p["gap"]) + F.length(p["hit"]), lambda a, b: a + b)
        one = lambda p, at: let(at + F.length(p["gap"]), lambda start: F.struct(start.alias("start"), (start + F.length(p["hit"])).alias("end"), p["hit"].alias("value")))
        return F.zip_with(pairs, starts, one)

    def located(hits):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) > 0, let(pairs, placed)).otherwise(_empty(_MATCHES))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _windows(value: Column, most: Column) -> Column:
    """(first, last): starts of the first and the last window whose entropy is high; null if none is."""
    place = [LETTERS.find(chr(c)) for c in range(128)]
    codes = F.transform(F.split(value, ""), lambda ch: F.element_at(F.lit(place), F.ascii(ch) + 1))
    return let(F.filter(codes, lambda c: c >= 0), lambda codes: _slide(codes, most))


def _slide(codes: Column, most: Column) -> Column:
    """The window moves by one character: two counts change, and with them two terms of the sum."""
    table = F.lit([_f(c) for c in range(WINDOW + 2)])
    f = lambda count: F.element_at(table, count.cast("int") + 1)
    longs = -(-len(LETTERS) // PER_LONG)
    at = lambda c: F.floor(c / PER_LONG).cast("int")
    bit = lambda c: (c % PER_LONG) * COUNT_BITS
    count = lambda counts, c: F.call_function("shiftright", F.element_at(counts, at(c) + 1), bit(c)).bitwiseAND(F.lit(31).cast("long"))
    change = lambda counts, c, by: F.transform(counts, lambda x, i: F.when(i == at(c), x + F.call_function("shiftleft", F.lit(1).cast("long"), bit(c)) * by).otherwise(x))
    none = F.lit(None).cast("int")

    def take(acc, c):
        n = count(acc["counts"], c)
        return F.struct((acc["sum"] - f(n) + f(n + 1)).alias("sum"), change(acc["counts"], c, 1).alias("counts"))

    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit([0] * longs).cast("array<bigint>").alias("counts"))
    begin = F.aggregate(F.slice(codes, F.lit(1), F.lit(WINDOW)), zero, take)

    def step(acc, i):
        # the window leaves character i - 1 (from 0) and takes in character i + WINDOW - 1
        gone, new = F.element_at(codes, i), F.element_at(codes, i + WINDOW)
        n = count(acc["counts"], gone)
        left = F.struct((acc["sum"] - f(n) + f(n - 1)).alias("sum"), change(acc["counts"], gone, -1).alias("counts"))
        same = F.struct(acc["sum"].alias("sum"), acc["counts"].alias("counts"))
        after = let(F.when(gone == new, same).otherwise(let(left, lambda x: take(x, new))), lambda x: F.struct(
            x["sum"].alias("sum"), x["counts"].alias("counts"),
            F.when(x["sum"] <= most, F.coalesce(acc["first"], i)).otherwise(acc["first"]).alias("first"), F.when(x["sum"] <= most, i).otherwise(acc["last"]).alias("last"),
        ))
        return after

    start = let(begin, lambda x: F.struct(x["sum"].alias("sum"), x["counts"].alias("counts"), F.when(x["sum"] <= most, 0).otherwise(none).alias("first"), F.when(x["sum"] <= most, 0).otherwise(none).alias("last")))
    moves = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(1), F.size(codes) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(moves, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy(runs: Column) -> Column:
    """Spans of high-entropy stretches in the candidate runs."""

    def fine(run):
        keep = F.lit(True)
        for pattern in ALLOW:
            keep = keep & ~run["value"].rlike(pattern)
        return keep

    def scan(run):
        most = F.lit(least_sum(CLASSES[-1][2]))
        for _, pattern, bits in reversed(CLASSES[:-1]):
            most = F.when(run["value"].rlike(pattern), F.lit(least_sum(bits))).otherwise(most)
        plain = run["value"]
        for part in ALLOW_PARTS:
            plain = F.regexp_replace(plain, f"(?i){part}", FILLER * len(part))
        return F.struct(run["start"].alias("start"), let(most.cast("long"), lambda m: _windows(plain, m)).alias("w"))

    scanned = F.filter(F.transform(F.filter(runs, fine), scan), lambda x: x["w"]["first"].isNotNull())
    return F.transform(scanned, lambda x: F.struct((x["start"] + x["w"]["first"]).alias("start"), (x["start"] + x["w"]["last"] + WINDOW).alias("end")))


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")))


def _outside(spans: Column, base: Column) -> Column:
    """Those of the sorted ``spans`` that lie in no base span; a block looks only at the base spans it can meet."""

    def block(b):
        part = F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))

        def judged(part):
            near = F.filter(base, lambda y: (y["end"] >= F.element_at(part, 1)["start"]) & (y["start"] <= F.element_at(part, -1)["start"]))
            return let(near, lambda near: F.filter(part, lambda x: ~F.exists(near, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))))

        return let(part, judged)

    return F.when(F.size(spans) > 0, F.flatten(F.transform(_blocks(spans), block))).otherwise(spans)


def spans(text: Column) -> Column:
    """A struct (base, every) of arrays of (start, kind, end), sorted by start, then kind.

    Base rules: leftmost non-overlapping matches per kind, failing ones dropped. Entropy spans that lie
    inside a base span are left out. Null texts count as empty. Work is little more than linear in the length
    of a text and in its matches.
    """

    def scanned(body):
        low = F.lower(body)
        worded = F.lit(False)
        for word in ASSIGN_WORDS:
            worded = worded | low.contains(word)
        value = lambda x: F.regexp_extract(x["value"], ASSIGN, 2)
        assign = F.when(worded, F.filter(_found(body, ASSIGN), lambda x: F.length(value(x)) >= ASSIGN_LEAST)).otherwise(_empty(_MATCHES))
        access = F.when(body.contains("AKIA"), _found(body, ACCESS)).otherwise(_empty(_MATCHES))

        def of_runs(runs):
            # a hex secret is part of a candidate run
            hexes = F.when(F.size(runs) > 0, _found(body, HEX)).otherwise(_empty(_MATCHES))
            base = F.array_sort(F.concat(_kind(assign, 0), _kind(access, 1), _kind(hexes, 2)))
            high = F.when(F.size(runs) > 0, _entropy(runs)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            every = lambda base, more: F.when(F.size(more) > 0, F.array_sort(F.concat(base, _kind(more, 3)))).otherwise(base)
            return let(base, lambda base: let(high, lambda high: F.struct(base.alias("base"), let(_outside(high, base), lambda more: every(base, more)).alias("every"))))

        return let(_found(body, CANDIDATE), of_runs)

    return let(F.coalesce(text.cast("string"), F.lit("")), scanned)


def _said(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy): a row for each input row.

    Null and empty texts have no spans; repeated rows and null ids give a row each; texts of any length are
    read whole; extra columns, whatever their names, are ignored; an empty table gives no rows.
    """
    found = docs.select("doc_id", spans(F.col("text")).alias("found"))
    count = lambda k: F.size(F.filter("found.every", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])], F.sha2(_said(F.col("found.base")), 256).alias("base_sha256"), _said(F.col("found.every")).alias("spans"), count(3).alias("n_entropy"))


def _cleaned(text: Column, every: Column, mark: str) -> Column:
    """``text`` with each stretch of overlapping spans replaced by ``mark``; pieces are cut out block by block."""

    def joined(rows):  # (start, end, upto): upto is the end of all spans before
        def block(b):
            part = F.slice(rows, b * BLOCK + 1, F.lit(BLOCK))

            def pieces(part):
                begin, end = F.element_at(part, 1)["upto"], F.element_at(part, -1)["start"]
                own = F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))
                piece = lambda x: F.when(x["start"] >= x["upto"], F.concat(F.substring(own_, x["upto"] - begin + 1, x["start"] - x["upto"]), F.lit(mark))).otherwise(F.lit(""))
                own_ = None

                def cut(own):
                    nonlocal own_
                    own_ = own
                    return F.array_join(F.transform(part, piece), "")

                return let(own, cut)

            return let(part, pieces)

        last = F.element_at(rows, -1)
        rest = F.greatest(last["upto"], last["end"])
        return F.concat(F.array_join(F.transform(_blocks(rows), block), ""), F.substring(text, rest + 1, F.length(text)))

    ends = lambda every: _before(every, F.lit(0), lambda x: x["end"], lambda a, b: F.greatest(a, b))
    rows = lambda every: F.zip_with(every, ends(every), lambda x, u: F.struct(x["start"].alias("start"), x["end"].alias("end"), u.alias("upto")))
    return let(every, lambda every: F.when(F.size(every) > 0, let(rows(every), joined)).otherwise(text))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` and n_chars, if there, made to fit; rows stay.

    Spans that overlap are replaced together. Null texts stay null; all other columns, whatever their names,
    come out as they went in.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    found = docs.select(whole, spans(F.col("text")).alias("found"))
    body = F.col("whole.text").cast("string")
    found = found.select("whole", F.when(F.size("found.every") > 0, _cleaned(body, F.col("found.every"), mark)).alias("clean"))
    out = []
    for c in docs.columns:
        own = F.col(f"whole.`{c}`")
        if c == "text":
            own = F.coalesce("clean", own)
        elif c == "n_chars":
            own = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)
