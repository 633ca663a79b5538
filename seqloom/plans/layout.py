"""Read structures: the driver-side plan of what stands where in a read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.dna import revcomp

_PIECE = re.compile(r"(\d+)([A-Z])(\(rc\))?")


@dataclass(frozen=True)
class Segment:
    mate: int
    start: int
    end: int
    symbol: str
    reverse: bool


@dataclass(frozen=True)
class Structure:
    """`R1_10A10B4T`: lengths and symbols from the read's start; T is technical, others are barcodes."""

    mate: int
    segments: tuple[Segment, ...]

    @property
    def prefix(self) -> int:
        return self.segments[-1].end

    @classmethod
    def parse(cls, text: str) -> Structure:
        m = re.fullmatch(r"R([12])_(.+)", text)
        if not m:
            raise ValueError(f"structure {text!r} must begin with R1_ or R2_")
        mate, body, at, out = int(m[1]), m[2], 0, []
        pieces = list(_PIECE.finditer(body))
        if "".join(p[0] for p in pieces) != body:
            raise ValueError(f"structure {text!r} has something else than <length><symbol>[(rc)]")
        for p in pieces:
            n = int(p[1])
            if not n:
                raise ValueError(f"structure {text!r} has an empty segment")
            if p[2] == "T" and p[3]:
                raise ValueError(f"structure {text!r}: a technical segment has no orientation")
            out.append(Segment(mate, at, at + n, p[2], bool(p[3])))
            at += n
        return cls(mate, tuple(out))


@dataclass(frozen=True)
class Layout:
    """The structures of one or both mates."""

    structures: tuple[Structure, ...] = field(default=())

    @classmethod
    def parse(cls, *texts: str) -> Layout:
        found = tuple(Structure.parse(t) for t in texts if t)
        if len({s.mate for s in found}) != len(found):
            raise ValueError("one structure for each mate")
        out = cls(found)
        for s in out.symbols:
            if out.length(s) > 32:
                raise ValueError(f"barcode {s} is longer than 32 bases")
        return out

    @property
    def symbols(self) -> list[str]:
        return sorted({x.symbol for s in self.structures for x in s.segments} - {"T"})

    def pieces(self, symbol: str) -> list[Segment]:
        return [x for s in sorted(self.structures, key=lambda s: s.mate) for x in s.segments if x.symbol == symbol]

    def length(self, symbol: str) -> int:
        return sum(x.end - x.start for x in self.pieces(symbol))

    def prefix(self, mate: int) -> int:
        return next((s.prefix for s in self.structures if s.mate == mate), 0)

    def barcode(self, symbol: str, seqs: dict[int, Column]) -> Column:
        """The logical barcode in upper case, from all its pieces in both mates."""
        cut = [F.substring(seqs[x.mate], x.start + 1, x.end - x.start) for x in self.pieces(symbol)]
        return F.upper(F.concat(*(revcomp(c) if x.reverse else c for c, x in zip(cut, self.pieces(symbol)))))

    def long_enough(self, seqs: dict[int, Column]) -> Column:
        out = F.lit(True)
        for s in self.structures:
            out = out & (F.length(seqs[s.mate]) >= s.prefix)
        return out
