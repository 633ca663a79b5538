"""Clipping as expressions: every function takes and gives a pair (start, end) of columns.

Bounds count from 0 in the original read, ends are exclusive; the read is cut only at a sink.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.dna import letters

Bounds = tuple[Column, Column]


def whole(seq: Column) -> Bounds:
    return F.lit(0), F.length(seq)


def fixed(bounds: Bounds, front: int = 0, tail: int = 0) -> Bounds:
    start = F.least(bounds[0] + front, bounds[1])
    return start, F.greatest(bounds[1] - tail, start)


def max_length(bounds: Bounds, most: int) -> Bounds:
    return bounds[0], F.least(bounds[1], bounds[0] + most)


def _places(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _once(value: Column, f) -> Column:
    """f(value), with value computed once per row: inside a lambda an expression is computed anew each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _codes(qual: Column) -> Column:
    return F.transform(letters(qual), lambda c: F.ascii(c) - 33)


def _total(codes: Column, i: Column, w: int) -> Column:
    """Sum of w qualities from place i on."""
    return reduce(lambda a, b: a + b, (F.get(codes, i + j) for j in range(w)))


def _known(seq: Column, first: Column, last: Column, pick) -> Column:
    """The first or last (pick) place from first to last whose base is not N, or null."""
    return _once(letters(F.upper(seq)), lambda x: pick(F.filter(_places(first, last), lambda i: F.get(x, i) != "N")))


def cut_front(seq: Column, qual: Column, bounds: Bounds, w: int = 4, mean: int = 20) -> Bounds:
    """From the first window whose mean reaches the threshold on; its last base, then leading N skipped."""
    b, e = bounds
    good = _once(_codes(qual), lambda c: F.array_min(F.filter(_places(b, e - w), lambda i: _total(c, i, w) >= w * mean)))

    def after(g):
        s = F.coalesce(g, e)
        return F.when((b < s) & (s < e), F.least(s + w - 1, e)).otherwise(s)

    start = _once(good, lambda g: _once(after(g), lambda s: F.coalesce(_known(seq, s, e - 1, F.array_min), e)))
    return F.when(e - b < w, b).otherwise(start), e


def cut_right(seq: Column, qual: Column, bounds: Bounds, w: int = 4, mean: int = 20) -> Bounds:
    """Up to the first window that fails, and there up to its first low base."""
    b, e = bounds

    def end(c):
        bad = F.array_min(F.filter(_places(b, e - w), lambda i: _total(c, i, w) < w * mean))
        low = lambda x: F.array_min(F.filter(_places(x, e - 1), lambda i: F.get(c, i) < mean))
        return _once(bad, lambda x: F.when(x.isNull(), e).otherwise(F.coalesce(low(x), e)))

    return b, F.when(e - b < w, e).otherwise(_once(_codes(qual), end))


def cut_tail(seq: Column, qual: Column, bounds: Bounds, w: int = 4, mean: int = 20) -> Bounds:
    """Up to the last window whose mean reaches the threshold; its last bases, then trailing N dropped."""
    b, e = bounds
    good = _once(_codes(qual), lambda c: F.array_max(F.filter(_places(b + w, e), lambda x: _total(c, x - w, w) >= w * mean)))

    def before(g):
        x = F.coalesce(g, b)
        return F.when((b < x) & (x < e), F.greatest(x - (w - 1), b)).otherwise(x)

    end = _once(good, lambda g: _once(before(g), lambda x: F.coalesce(_known(seq, b, x - 1, F.array_max) + 1, b)))
    return b, F.when(e - b < w, e).otherwise(end)


def poly_g(seq: Column, bounds: Bounds, least: int = 10) -> Bounds:
    """Clip a tail of G with up to five others, one in eight places at most."""
    b, e = bounds
    back = letters(F.reverse(F.upper(_cut(seq, b, e))))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("mm"), F.lit(-1).alias("stop"), F.lit(-1).alias("g"))

    def step(a, c):
        mm = a["mm"] + (c != "G").cast("int")
        ends = (a["stop"] < 0) & ((mm > 5) | ((mm > F.floor((a["i"] + 1) / 8)) & (a["i"] + 1 >= least)))
        stop = F.when(ends, a["i"]).otherwise(a["stop"])
        g = F.when((stop < 0) & (c == "G"), a["i"]).otherwise(a["g"])
        return F.struct((a["i"] + 1).alias("i"), mm.cast("int").alias("mm"), stop.cast("int").alias("stop"), g.cast("int").alias("g"))

    def end(a):
        stop = F.when(a["stop"] < 0, e - b).otherwise(a["stop"])
        return F.when((stop >= least) & (a["g"] >= 0), e - 1 - a["g"]).otherwise(e)

    return b, _once(F.aggregate(back, start, step), end)


def poly_x(seq: Column, bounds: Bounds, least: int = 10) -> Bounds:
    """Clip a tail of any one base; N counts for each, the first of A, T, C, G with most wins.

    Going in from the end, a place stops the tail where the others than the leading base exceed
    five, or one in eight from the eighth place (or the one before the shortest length) on.
    """
    b, e = bounds
    names = ["A", "T", "C", "G"]
    start = F.struct(F.lit(0).alias("i"), *(F.lit(0).alias(x) for x in names), F.lit(-1).alias("stop"))

    def step(a, c):
        more = {x: a[x] + ((c == x) | (c == "N")).cast("int") for x in names}
        width = a["i"] + 1
        others = width - F.greatest(*more.values())
        ends = (a["stop"] >= 0) | ((others > F.least(F.lit(5), F.floor(width / 8))) & (width >= min(8, max(least - 1, 0))))
        stop = F.when(a["stop"] >= 0, a["stop"]).when(ends, a["i"]).otherwise(-1)
        return F.struct(width.alias("i"), *(F.when(ends, a[x]).otherwise(more[x]).cast("int").alias(x) for x in names), stop.cast("int").alias("stop"))

    def tail(back, a):
        most = F.greatest(*(a[x] for x in names))
        base = F.when(a["A"] == most, "A").when(a["T"] == most, "T").when(a["C"] == most, "C").otherwise("G")
        reach = F.when(a["stop"] < 0, e - b).otherwise(a["stop"])
        last = F.array_max(F.filter(_places(F.lit(0), reach - 1), lambda i: F.get(back, i) == base))
        return F.when(reach >= least, e - 1 - F.coalesce(last, F.lit(-1))).otherwise(e)

    back = letters(F.reverse(F.upper(_cut(seq, b, e))))
    return b, _once(back, lambda x: _once(F.aggregate(x, start, step), lambda a: tail(x, a)))


def _cut(seq: Column, b: Column, e: Column) -> Column:
    return F.substring(seq, b + 1, F.greatest(e - b, F.lit(0)))
