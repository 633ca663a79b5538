"""Mates: by name with orphans, by position with a bounded look-ahead, and interleaved input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.dna import core_read_id
from seqloom.operators.metrics import STRETCH
from seqloom.sources.scratch import settled

#: Records of either mate that a resynchronisation looks at, the one to match included.
LOOK_AHEAD = 1024
#: R1 records of one segment, about; and at most, whatever the files look like.
SEGMENT, MOST_IN_SEGMENT = 1 << 16, 1 << 22


def pair(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """read_idx, kind (pair, orphan_r1, orphan_r2) and id, seq, qual of either mate.

    Inputs have read_idx, id, seq, qual.  Mates meet by core name and its occurrence, so files that
    miss records on either side pair up again; what has no partner is an orphan.  read_idx is a
    fragment's own: even after R1's order, odd for orphans of R2.  One shuffle a side.
    """

    def keyed(df, m):
        occurrence = F.row_number().over(Window.partitionBy("core").orderBy("read_idx"))
        named = df.select(core_read_id(F.col("id")).alias("core"), *(F.col(c).alias(c if c == "read_idx" else f"{c}{m}") for c in ("read_idx", "id", "seq", "qual")))
        return named.withColumn("occ", occurrence).withColumnRenamed("read_idx", f"idx{m}")

    both = keyed(r1, 1).join(keyed(r2, 2), ["core", "occ"], "full_outer")
    kind = F.when(F.col("idx2").isNull(), "orphan_r1").when(F.col("idx1").isNull(), "orphan_r2").otherwise("pair")
    return both.select(F.coalesce(F.col("idx1") * 2, F.col("idx2") * 2 + 1).alias("read_idx"), kind.alias("kind"), "id1", "seq1", "qual1", "id2", "seq2", "qual2")


def numbered(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """df plus n: its rows counted from 0 by read_idx, without gaps."""
    dealt = df.withColumn("_stretch", F.floor(F.col("read_idx") / stretch))
    counts = dealt.groupBy("_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a stretch
    placed = dealt.join(counts.select("_stretch", before.alias("_before")), "_stretch")
    own = F.row_number().over(Window.partitionBy("_stretch").orderBy("read_idx"))
    return placed.withColumn("n", F.col("_before") + own - 1).drop("_stretch", "_before")


def anchors(names1: DataFrame, names2: DataFrame, segment: int = SEGMENT, stretch: int = STRETCH) -> DataFrame:
    """a, c: places (numbers n of R1 and R2) of names at which both files can be cut: the name is there once in
    each, and no name of both files lies before the place in one and behind it in the other.

    names1, names2: n, core.  About one for `segment` records of R1, and no two in one of R2.  Only
    names and numbers are shuffled; running extremes are taken by stretch, then within each."""
    def places(df, low, high):
        return df.groupBy("core").agg(F.min("n").alias(low), F.max("n").alias(high))

    met = places(names1, "a", "b").join(places(names2, "c", "d"), "core").withColumn("_stretch", F.floor(F.col("a") / stretch))
    whole = met.groupBy("_stretch").agg(F.max("b").alias("b"), F.max("d").alias("d"), F.min("c").alias("c"))
    by = Window.orderBy("_stretch")  # a row a stretch
    back = Window.orderBy(F.desc("_stretch"))  # frames that end at the last row are taken anew for each row, so what follows is read backwards
    up, down = by.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    none, far = F.lit(-1), F.lit(1 << 62)
    outside = whole.select("_stretch", F.coalesce(F.max("b").over(up), none).alias("_b"), F.coalesce(F.max("d").over(up), none).alias("_d"), F.coalesce(F.min("c").over(down), far).alias("_c"))
    before, after = (Window.partitionBy("_stretch").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("a"), F.desc("a")))
    inside = met.join(outside, "_stretch").select(
        "a", "b", "c", "d",
        F.greatest("_b", F.coalesce(F.max("b").over(before), none)).alias("_b"), F.greatest("_d", F.coalesce(F.max("d").over(before), none)).alias("_d"),
        F.least("_c", F.coalesce(F.min("c").over(after), far)).alias("_c"),
    )
    good = inside.where("a = b and c = d and _b < a and _d < c and _c > c")
    sparse = good.groupBy(F.floor(F.col("a") / segment)).agg(F.min(F.struct("a", "c")).alias("x")).select("x.*")
    return sparse.groupBy(F.floor(F.col("c") / segment)).agg(F.min(F.struct("a", "c")).alias("x")).select("x.*")


def _segments(reads: DataFrame, cuts: DataFrame, at: str, segment: int) -> DataFrame:
    """reads (with n) plus segment: the a of the last cut at or before n (-1: none)."""
    n = F.floor(F.col("n") / segment)
    blocks = reads.select(n.alias("_block")).distinct().join(cuts.select(F.floor(F.col(at) / segment).alias("_block"), F.col(at).alias("_at"), F.col("a").alias("_own")), "_block", "full_outer")
    before = F.last("_own", ignorenulls=True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    ready = blocks.select("_block", "_at", "_own", before.alias("_before"))
    own = F.coalesce(F.when(F.col("n") >= F.col("_at"), F.col("_own")), F.col("_before"), F.lit(-1))
    return reads.withColumn("_block", n).join(ready, "_block").withColumn("segment", own).drop("_block", "_at", "_own", "_before")


def merged(a: list, b: list, more: bool, window: int = LOOK_AHEAD) -> tuple[list[int], list[int]]:
    """Places in a and b of what belongs together, in order; -1 where there is no mate.

    Equal names at the fronts are a pair.  Else both files are read on in turn, R1 first, until a name
    was seen in both: what lies before it is orphaned.  A file is not read on beyond `window` records
    from its front; if neither can be read on and a name is open, that is an error.  Where one file
    has ended and nothing of it is open, the rest of the other is orphaned.  more: the lists end where a
    pair follows."""
    if more:
        a, b = [*a, None], [*b, None]  # the pair that follows
    i, j, step, left, right = 0, 0, 8, [], []
    one, two = np.array(a, object), np.array(b, object)
    while i < len(a) and j < len(b):
        size = min(len(a) - i, len(b) - j, step)
        equal = one[i : i + size] == two[j : j + size]
        run = size if equal.all() else int(equal.argmin())
        left += range(i, i + run)
        right += range(j, j + run)
        i, j, step = i + run, j + run, min(2 * step, 8192) if run == size else 8
        if run:
            continue
        seen1, seen2, t, found = {a[i]: 0}, {b[j]: 0}, 0, None
        while found is None:
            t += 1
            grown = False
            if t < window and i + t < len(a):
                grown = True
                seen1.setdefault(a[i + t], t)
                if a[i + t] in seen2:
                    found = (t, seen2[a[i + t]])
                    break
            if t < window and j + t < len(b):
                grown = True
                seen2.setdefault(b[j + t], t)
                if b[j + t] in seen1:
                    found = (seen1[b[j + t]], t)
                    break
            if not grown:
                if i + t < len(a) or j + t < len(b):
                    raise ValueError(f"no common name within {window} records: {a[i]!r} and {b[j]!r}")
                break
        x, y = found or (len(a) - i, len(b) - j)
        left += [*range(i, i + x), *[-1] * y]
        right += [*[-1] * x, *range(j, j + y)]
        i, j = i + x, j + y
    left += [*range(i, len(a)), *[-1] * (len(b) - j)]
    right += [*[-1] * (len(a) - i), *range(j, len(b))]
    return (left[:-1], right[:-1]) if more else (left, right)


def pair_in_order(r1: DataFrame, r2: DataFrame, window: int = LOOK_AHEAD, segment: int = SEGMENT, dense: bool = False) -> DataFrame:
    """What pair gives, by an ordered merge: files whose records stand in the same order, but for some that one of
    them lacks or that are out of place.

    Inputs have read_idx (their order; dense: numbers from 0 without gaps, as read_fastq gives over
    all files, which saves a shuffle), id, seq, qual; see merged for the rule.  Both files are cut
    where that cannot change the outcome (anchors), and segments are merged in parallel.  A name
    that stands far from its mate keeps what lies between in one segment; one of more than
    MOST_IN_SEGMENT records is an error, and pair takes such files.  The orphans and pairs of a name out
    of place are those of a merge that forgets, after each pair, what it had read ahead.
    """
    named = [df.select("read_idx", "id", "seq", "qual").withColumn("core", core_read_id(F.col("id"))) for df in (r1, r2)]
    sides = [df.withColumn("n", F.col("read_idx")) if dense else numbered(df) for df in named]
    cuts = settled(anchors(*(s.select("n", "core") for s in sides), segment))  # a row a segment
    last = cuts.agg(F.max("a").alias("a")).first()["a"]
    one, two = (_segments(s, cuts, at, segment) for s, at in zip(sides, ("a", "c")))
    schema = "read_idx long, kind string, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string"

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        if max(left.num_rows, right.num_rows) > MOST_IN_SEGMENT:
            raise ValueError(f"more than {MOST_IN_SEGMENT} records without a common order: pair them by name")
        left, right = (t.sort_by("n") for t in (left, right))
        seg = (left if left.num_rows else right).column("segment")[0].as_py()
        places = merged(left.column("core").to_pylist(), right.column("core").to_pylist(), last is not None and seg != last, window)
        take = [pa.array([None if p < 0 else p for p in side], pa.int64()) for side in places]
        kinds = ["orphan_r2" if i < 0 else "orphan_r1" if j < 0 else "pair" for i, j in zip(*places)]
        number = [2 * i if i is not None else 2 * j + 1 for i, j in zip(left.column("n").take(take[0]).to_pylist(), right.column("n").take(take[1]).to_pylist())]
        texts = [t.column(c).take(k) for t, k in zip((left, right), take) for c in ("id", "seq", "qual")]
        return pa.table([pa.array(number, pa.int64()), pa.array(kinds, pa.string()), *texts], names=["read_idx", "kind", "id1", "seq1", "qual1", "id2", "seq2", "qual2"])

    columns = ["segment", "n", "core", "id", "seq", "qual"]
    one, two = (df.select(columns).toDF(*columns) for df in (one, two))  # columns of its own, if both come from one table
    return one.groupBy("segment").cogroup(two.groupBy("segment")).applyInArrow(merge, schema)


def interleaved(reads: DataFrame) -> DataFrame:
    """Pairs from alternating records; an odd count or names that differ are an error."""
    def mate(c, m):
        return F.max(F.when(F.col("read_idx") % 2 == m - 1, F.col(c))).alias(f"{c}{m}")

    both = reads.groupBy(F.floor(F.col("read_idx") / 2).alias("read_idx")).agg(*(mate(c, m) for m in (1, 2) for c in ("id", "seq", "qual")))
    same = F.coalesce(core_read_id(F.col("id1")) == core_read_id(F.col("id2")), F.lit(False))
    checked = F.when(same, F.lit("pair")).otherwise(F.raise_error(F.concat(F.lit("interleaved mates differ at fragment "), F.col("read_idx").cast("string"))))
    return both.withColumn("kind", checked)
