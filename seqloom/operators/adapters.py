"""Adapters read through: exact anchors and masked comparison, partial ends, inference."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.dna import is_informative, letters
from seqloom.plans.layout import Layout, Structure

_ORDER = "ACGT"
#: Bits of one word of a Shift-And state.
WORD = 62
#: Starts of an adapter that one pattern may hold, each nested in the one before.
NESTED = 256


def informative(text: str) -> bool:
    known = [c for c in text if c in _ORDER]
    counts = Counter(known)
    pairs = {text[i : i + 2] for i in range(len(text) - 1) if text[i] in _ORDER and text[i + 1] in _ORDER}
    return len(counts) >= 3 and max(counts.values()) * 4 <= len(known) * 3 and len(pairs) >= 6


@dataclass(frozen=True)
class Adapter:
    """An expected sequence (N: unknown), how many known bases may differ, and its rules.

    The anchor is the longest informative run of 16 to 12 known bases, the most diverse and first of
    them; it must match exactly.  Without one, or with fewer than min_known known bases, only
    partial matches are looked for.
    """

    expected: str
    mismatches: int = 1
    min_known: int = 20
    min_partial: int | None = None

    @property
    def anchor(self) -> tuple[int, str] | None:
        if sum(c in _ORDER for c in self.expected) < self.min_known:
            return None
        for n in range(16, 11, -1):
            windows = [(len({w[j : j + 2] for j in range(n - 1)}), -i, w) for i in range(len(self.expected) - n + 1) if set(w := self.expected[i : i + n]) <= set(_ORDER) and informative(w)]
            if windows:
                _, i, w = max(windows, key=lambda x: x[:2])
                return -i, w
        return None

    def full(self, seq: Column) -> Column:
        """Where the whole adapter begins first (from 0), or null."""
        if self.anchor is None:
            return F.lit(None).cast("int")
        up, n = F.upper(seq), len(self.expected)
        starts = F.when(F.length(up) >= n, F.sequence(F.lit(0), F.length(up) - n)).otherwise(F.array().cast("array<int>"))
        return F.when(F.instr(up, self.anchor[1]) > 0, F.array_min(F.filter(starts, lambda s: self._fits(up, s))))

    def _fits(self, up: Column, s: Column) -> Column:
        at, word = self.anchor
        known = [(i, c) for i, c in enumerate(self.expected) if c in _ORDER and not at <= i < at + len(word)]

        # one short lambda, not a term for each base: a stage whose code is too long is never compiled to machine code
        bases = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in known)) if known else F.array().cast("array<struct<i:int,c:string>>")
        differ = F.size(F.filter(bases, lambda x: F.substring(up, s + x["i"] + 1, F.lit(1)) != x["c"]))
        strange = F.translate(_known_of(up, s, self.expected), _ORDER, "") != ""
        return (F.substring(up, s + at + 1, F.lit(len(word))) == word) & ~strange & (differ <= self.mismatches)

    def full_at(self, seq: Column, s: Column) -> Column:
        """Whether the whole adapter begins at s."""
        if self.anchor is None:
            return F.lit(False)
        return F.coalesce((s >= 0) & (s + len(self.expected) <= F.length(seq)) & self._fits(F.upper(seq), s), F.lit(False))

    def partial(self, seq: Column) -> Column:
        """Where a read's end begins that equals the adapter's start at every known base: with the most
        known bases, the latest among equals; or null."""
        return self.evidence(seq)["start"]

    def _heads(self) -> list[tuple[int, int]]:
        """Lengths of the adapter's starts that are evidence enough, and their known bases."""
        if self.min_partial is None:
            return []
        heads = [(n, sum(c in _ORDER for c in self.expected[:n])) for n in range(1, len(self.expected))]
        return [(n, k) for n, k in heads if k >= self.min_partial and informative(self.expected[:n])]

    def _end_pattern(self) -> str:
        """The longest start that a read ends with, as the first match: A(?:\\z|C(?:\\z|G\\z)) for A, AC and ACG."""
        ends, pattern = {n for n, _ in self._heads()}, ""
        for n in range(max(ends), 0, -1):
            rest = [r"\z"] * (n in ends) + [pattern] * bool(pattern)
            pattern = re.escape(self.expected[n - 1]) + (rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})")
        return pattern

    def _ends(self, up: Column) -> Column:
        """Shift-And over a read's last bases: words of bits, of which bit n - 1 tells whether the last n bases
        equal the adapter's first n (N fits all)."""
        most = max(n for n, _ in self._heads())
        count = -(-most // WORD)

        def mask(c: Column, w: int) -> Column:
            part = self.expected[:most][w * WORD : (w + 1) * WORD]
            bits = {x: sum(1 << i for i, e in enumerate(part) if e in (x, "N")) for x in _ORDER + "N"}
            return reduce(lambda at, x: at.when(c == x, F.lit(bits[x]).cast("long")), _ORDER[1:], F.when(c == _ORDER[0], F.lit(bits[_ORDER[0]]).cast("long"))).otherwise(F.lit(bits["N"]).cast("long"))

        def step(words: Column, c: Column) -> Column:
            shifted = [F.shiftleft(words[f"w{w}"], 1).bitwiseOR(F.shiftright(words[f"w{w - 1}"], WORD - 1) if w else F.lit(1).cast("long")) for w in range(count)]
            return F.struct(*(x.bitwiseAND(mask(c, w)).alias(f"w{w}") for w, x in enumerate(shifted)))

        tail = letters(F.substring(up, F.greatest(F.length(up) - most, F.lit(0)) + 1, F.lit(most)))
        return F.aggregate(tail, F.struct(*(F.lit(0).cast("long").alias(f"w{w}") for w in range(count))), step)

    def partial_at(self, seq: Column, s: Column) -> Column:
        """Whether the read's end from s on is one of the adapter's starts."""
        heads = self._heads()
        if not heads:
            return F.lit(False)
        if "N" not in self.expected:
            up, size = F.upper(seq), F.length(seq) - s
            same = F.substring(up, s + 1, size) == F.substring(F.lit(self.expected), 1, size)
            return F.coalesce((s >= 0) & size.isin([n for n, _ in heads]) & same, F.lit(False))
        most = max(n for n, _ in heads)
        wanted = [sum(1 << (n - 1) % WORD for n, _ in heads if (n - 1) // WORD == w) for w in range(-(-most // WORD))]
        n = F.length(seq) - s - 1

        def bit(words: Column) -> Column:
            found = F.lit(False)
            for w, mask in enumerate(wanted):
                there = F.call_function("shiftright", words[f"w{w}"].bitwiseAND(F.lit(mask)), n - w * WORD).bitwiseAND(F.lit(1)) == 1
                found = F.when((n >= w * WORD) & (n < (w + 1) * WORD), there).otherwise(found)
            return found

        return F.coalesce(_let(self._ends(F.upper(seq)), bit), F.lit(False))

    def evidence(self, seq: Column) -> Column:
        """(known bases, start) of the strongest partial match, to compare those of several adapters; or null."""
        none = F.lit(None).cast("struct<known:int,start:int>")
        heads = sorted(self._heads(), key=lambda x: (-x[1], x[0]))
        if not heads:
            return none

        if "N" not in self.expected:  # all starts are plain texts
            up = F.upper(seq)
            if set(self.expected) <= set(_ORDER) and len(heads) <= NESTED:  # and the longest one has the most known bases
                n = F.length(F.regexp_extract(up, self._end_pattern(), 0))
                held = F.contains(up, F.lit(self.expected[: heads[-1][0]]))  # all hold the shortest one
                return F.when(held & (n > 0), F.struct(n.alias("known"), (F.length(seq) - n).alias("start")))
            return F.coalesce(*(F.when(F.endswith(up, F.lit(self.expected[:n])), F.struct(F.lit(k).alias("known"), (F.length(seq) - n).alias("start"))) for n, k in heads), none)

        def strongest(words: Column) -> Column:
            there = (words[f"w{(n - 1) // WORD}"].bitwiseAND(F.lit(1 << (n - 1) % WORD)) != 0 for n, _ in heads)
            return F.coalesce(*(F.when(t, F.struct(F.lit(k).alias("known"), (F.length(seq) - n).alias("start"))) for t, (n, k) in zip(there, heads)), none)

        return _let(self._ends(F.upper(seq)), strongest)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@dataclass(frozen=True)
class SampleAdapter:
    """Columns expected, at, word of a table with one adapter a sample: its sequence, and place and bases of
    its anchor.  Only whole matches are looked for."""

    name: str
    mismatches: int = 1

    def _fits(self, up: Column, s: Column) -> Column:
        expected, at, word = (F.col(f"{self.name}_{c}") for c in ("expected", "at", "word"))
        both = F.zip_with(letters(F.substring(up, s + 1, F.length(expected))), letters(expected), lambda c, e: F.when(e == "N", 0).when(~c.isin(*_ORDER), 1000).when(c != e, 1).otherwise(0))
        return (F.substring(up, s + at + 1, F.length(word)) == word) & (F.aggregate(both, F.lit(0), lambda n, x: n + x) <= self.mismatches)

    def full(self, seq: Column) -> Column:
        up, n = F.upper(seq), F.length(F.col(f"{self.name}_expected"))
        starts = F.when(F.length(up) >= n, F.sequence(F.lit(0), F.length(up) - n))
        return F.when(F.contains(up, F.col(f"{self.name}_word")), F.array_min(F.filter(starts, lambda s: self._fits(up, s))))

    def full_at(self, seq: Column, s: Column) -> Column:
        inside = (s >= 0) & (s + F.length(F.col(f"{self.name}_expected")) <= F.length(seq))
        return F.coalesce(inside & self._fits(F.upper(seq), s), F.lit(False))

    def evidence(self, seq: Column) -> Column:
        return F.lit(None).cast("struct<known:int,start:int>")

    def partial_at(self, seq: Column, s: Column) -> Column:
        return F.lit(False)


def sample_adapters(layout: Layout, barcodes: list[tuple[str, str, str]], sheet: list[dict[str, str]], paired: bool, technical: dict[int, str] | None = None, umi: dict[int, int] | None = None, distals: dict[int, Structure] | None = None) -> list[tuple]:
    """(sample, mate, expected, at, word): what each mate's reads of a sample run into behind the insert, if
    it has an anchor.  Single reads are taken to have the same structure at both ends, unless a
    distal one says, read forward, what a mate meets."""
    known, rows = {(s, i): seq.upper() for s, i, seq in barcodes}, []
    for row in sheet:
        own = {s: known[(s, row[s])] for s in layout.symbols}
        for mate in (1, 2) if paired else (1,):
            source = 3 - mate if paired else mate
            far = (distals or {}).get(mate)
            adapter = Adapter(distal(far, own) if far else opposite(layout, source, own, technical, (umi or {}).get(source, 0)))
            if adapter.anchor:
                rows.append((row["Sample"], mate, adapter.expected, *adapter.anchor))
    return rows


def _known_of(up: Column, s: Column, expected: str) -> Column:
    """The read's bases at the known places of expected, put together run by run."""
    runs, i = [], 0
    while i < len(expected):
        j = i
        while j < len(expected) and (expected[j] in _ORDER) == (expected[i] in _ORDER):
            j += 1
        if expected[i] in _ORDER:
            runs.append(F.substring(up, s + i + 1, F.lit(j - i)))
        i = j
    return F.concat(*runs)


def opposite(layout: Layout, mate: int, barcodes: dict[str, str], technical: dict[int, str] | None = None, umi: int = 0) -> str:
    """What a read of the other mate runs into: this mate's prefix from its far end, orientations
    turned round, unknown technical bases and the UMI as N."""
    flip = str.maketrans("ACGT", "TGCA")
    s = next((x for x in layout.structures if x.mate == mate), None)
    if s is None:
        return ""
    used = dict.fromkeys(layout.symbols, 0)
    known, at = {}, 0
    for p in [q for sym in layout.symbols for q in layout.pieces(sym)]:
        start = used[p.symbol]
        used[p.symbol] += p.end - p.start
        known[(p.mate, p.start)] = barcodes.get(p.symbol, "")[start : used[p.symbol]]
    out = ["N" * umi]
    texts = []
    for p in s.segments:
        n = p.end - p.start
        if p.symbol == "T":
            text = (technical or {}).get(mate, "")[at : at + n] or "N" * n
            at += n
        else:
            logical = known[(p.mate, p.start)] or "N" * n
            text = logical[::-1].translate(flip) if p.reverse else logical
        texts.append(text)
    return "".join(out + [t[::-1].translate(flip) for t in reversed(texts)])


def distal(structure: Structure, barcodes: dict[str, str], technical: str | None = None) -> str:
    """An explicit far end, read forward: each logical barcode in pieces, known technical bases or N."""
    used, at, out = dict.fromkeys(barcodes, 0), 0, []
    total = sum(p.end - p.start for p in structure.segments if p.symbol == "T")
    if technical and len(technical) != total:
        raise ValueError(f"the technical bases must be {total}")
    for p in structure.segments:
        n = p.end - p.start
        if p.symbol == "T":
            out.append(technical[at : at + n] if technical else "N" * n)
            at += n
            continue
        text = barcodes[p.symbol][used[p.symbol] : used[p.symbol] + n]
        used[p.symbol] += n
        out.append(text[::-1].translate(str.maketrans("ACGT", "TGCA")) if p.reverse else text)
    if any(used[s] not in (0, len(b)) for s, b in barcodes.items()):
        raise ValueError("a barcode must be used up")
    return "".join(out)


def infer_adapter(reads: DataFrame, seed: int = 12, tail: int = 200, sample: int = 5000, prefix: int = 0) -> str | None:
    """An adapter that many read ends share: the 12-base seed of most reads, extended while nine in ten
    of its reads agree.  Seeds are counted on Spark over the first `sample` reads by read_idx, a
    documented bound of this inference; only those with the seed come to the driver to extend it."""
    tails = reads.orderBy("read_idx").limit(sample).select(F.upper(F.substring("seq", F.greatest(F.lit(prefix), F.length("seq") - tail) + 1, F.length("seq"))).alias("t"))
    starts = F.when(F.length("t") >= seed, F.sequence(F.lit(1), F.length("t") - seed + 1))
    words = tails.select("t", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("t", i, F.lit(seed))))).alias("w"))
    counts = words.where(F.col("w").rlike("^[ACGT]+$") & is_informative(F.col("w"))).groupBy("w").count()
    n, best = tails.count(), counts.orderBy(F.desc("count"), "w").limit(1).collect()
    required = max(20, -(-n // 20))
    if not best or best[0]["count"] < required:
        return None
    word = best[0]["w"]
    rows = [(r["t"], r["t"].index(word)) for r in tails.where(F.instr("t", word) > 0).collect()]
    if len({p for _, p in rows}) < 3:
        return None
    for left in (True, False):
        while len(word) < tail:
            def flank(t, p):
                i = p - 1 if left else p + len(word)
                return t[i] if 0 <= i < len(t) and t[i] in _ORDER else ""

            votes = Counter(f for t, p in rows if (f := flank(t, p)))
            base, most = max(votes.items(), key=lambda x: (x[1], -_ORDER.index(x[0])), default=("", 0))
            if most < required or most * 10 < len(rows) * 9:
                break
            rows = [(t, p - left) for t, p in rows if flank(t, p) == base]
            word = base + word if left else word + base
    return word if len(word) >= 20 and informative(word) else None
