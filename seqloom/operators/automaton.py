"""Many adapters at once: an Aho-Corasick automaton over their anchors, and a table of their starts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.operators.adapters import Adapter

_BASES = frozenset("ACGT")


class _Searcher:
    """What a worker makes of the adapters, once."""

    def __init__(self, adapters: tuple[Adapter, ...]):
        import ahocorasick

        self.adapters = adapters
        by_word: dict[str, list[int]] = {}
        self.places = []
        for i, a in enumerate(adapters):
            self.places.append(a.anchor and a.anchor[0])
            if a.anchor:
                by_word.setdefault(a.anchor[1], []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, owners in by_word.items():
            self.automaton.add_word(word, (len(word), owners))
        if by_word:
            self.automaton.make_automaton()
        self.any_anchor = bool(by_word)
        self.known = [[(j, c) for j, c in enumerate(a.expected) if c in _BASES] for a in adapters]
        #: length of a start -> places of its known bases -> their letters; only the first adapter's evidence counts
        self.heads: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for a in adapters:
            for n, _ in a._heads():
                at = tuple(j for j in range(n) if a.expected[j] in _BASES)
                self.heads.setdefault(n, {}).setdefault(at, set()).add("".join(a.expected[j] for j in at))
        self.lengths = sorted(self.heads)

    def fits(self, read: str, i: int, start: int) -> bool:
        """Whether adapter i lies at start, beyond what its anchor says."""
        left = self.adapters[i].mismatches
        if start < 0 or start + len(self.adapters[i].expected) > len(read):
            return False
        for j, c in self.known[i]:
            base = read[start + j]
            if base != c:
                left -= 1
                if left < 0 or base not in _BASES:
                    return False
        return True

    def places_of(self, read: str) -> Iterator[tuple[int, int]]:
        """(start, adapter) of all whole adapters of a read."""
        if self.any_anchor:
            for end, (size, owners) in self.automaton.iter(read):
                for i in owners:
                    start = end + 1 - size - self.places[i]
                    if self.fits(read, i, start):
                        yield start, i

    def starts_at(self, read: str, n: int) -> int:
        """Known bases of the best start of an adapter that the last n bases are, or 0."""
        best, tail = 0, read[len(read) - n :]
        for at, words in self.heads.get(n, {}).items():
            if len(at) > best and (tail if len(at) == n else "".join([tail[j] for j in at])) in words:
                best = len(at)
        return best


@lru_cache(maxsize=8)
def _searcher(adapters: tuple[Adapter, ...]) -> _Searcher:
    return _Searcher(adapters)


@lru_cache(maxsize=8)
def _search(adapters: tuple[Adapter, ...]):
    """One function object for the same adapters, so that Spark calls it once where several columns use it."""

    @F.arrow_udf("struct<start:int,adapter:int,known:int,partial:int>")
    def search(reads: pa.Array) -> pa.Array:
        s, out = _searcher(adapters), []
        for read in pc.utf8_upper(reads).to_pylist():
            whole, best = (None, None), (0, None)
            if read is not None:
                whole = min(s.places_of(read), default=whole)
                for n in s.lengths:
                    if n > len(read):
                        break
                    known = s.starts_at(read, n)
                    if known > best[0]:
                        best = (known, len(read) - n)
            out.append((*whole, best[0] or None, best[1]))
        columns = zip(*out) if out else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["start", "adapter", "known", "partial"])

    return search


@lru_cache(maxsize=16)
def _test(adapters: tuple[Adapter, ...], whole: bool):
    @F.arrow_udf("boolean")
    def test(reads: pa.Array, starts: pa.Array) -> pa.Array:
        x, out = _searcher(adapters), []
        for read, start in zip(pc.utf8_upper(reads).to_pylist(), starts.to_pylist()):
            if read is None or start is None or not 0 <= start <= len(read):
                out.append(False)
            elif whole:
                out.append(any(at == start for at, _ in x.places_of(read)))
            else:
                out.append(x.starts_at(read, len(read) - start) > 0)
        return pa.array(out, pa.bool_())

    return test


@dataclass(frozen=True)
class AdapterSet:
    """Any number of adapters, looked for in one pass over each read; takes the place of an Adapter where
    bounds are found.  The plan has one expression, whatever their number."""

    adapters: tuple[Adapter, ...]

    def __post_init__(self):
        unusable = [a.expected for a in self.adapters if not a.anchor and not a._heads()]
        if unusable or not self.adapters:
            raise ValueError(f"adapters without an anchor or a start that is evidence: {unusable[:3]}")

    def found(self, seq: Column) -> Column:
        """struct(start, adapter, known, partial): where the first whole adapter begins and which it is (the
        first of several at one place), and the known bases and place of the strongest partial one."""
        return _search(self.adapters)(seq)

    def full(self, seq: Column) -> Column:
        return self.found(seq)["start"]

    def evidence(self, seq: Column) -> Column:
        x = self.found(seq)
        return F.when(x["known"].isNotNull(), F.struct(x["known"].alias("known"), x["partial"].alias("start")))

    def _at(self, seq: Column, s: Column, whole: bool) -> Column:
        return _test(self.adapters, whole)(seq, s.cast("int"))

    def full_at(self, seq: Column, s: Column) -> Column:
        return self._at(seq, s, True)

    def partial_at(self, seq: Column, s: Column) -> Column:
        return self._at(seq, s, False)
