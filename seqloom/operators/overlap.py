"""Mate overlap, its use for correction and merging, and the one-gap fallback.

Built-in expressions cannot compare a pair at every offset well; one Arrow stage does it for a batch of
pairs at a time, a matrix operation for each insert length, and is sent the bases alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[[_c, _c + 32]] = _i
_LETTER = np.frombuffer(b"ACGTN", np.uint8)


def _informative(x: np.ndarray) -> bool:
    counts = np.bincount(x[x < 4], minlength=4)
    ok = (x[1:] < 4) & (x[:-1] < 4)
    kinds = len(np.unique(x[:-1][ok] * 4 + x[1:][ok]))
    return (counts > 0).sum() >= 3 and counts.max() * 4 <= len(x) * 3 and kinds >= 6


def _informative_rows(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_informative of x[r, a[r]:b[r]] for each row r, whose bases there are all known."""
    at = np.arange(x.shape[1])
    inside = (at >= a[:, None]) & (at < b[:, None])
    counts = np.stack([((x == c) & inside).sum(axis=1) for c in range(4)])
    two = np.where(inside[:, 1:] & inside[:, :-1], np.uint16(1) << ((x[:, :-1] & 3) * 4 + (x[:, 1:] & 3)).astype(np.uint16), np.uint16(0))
    kinds = np.bitwise_count(np.bitwise_or.reduce(two, axis=1))
    return ((counts > 0).sum(axis=0) >= 3) & (counts.max(axis=0) * 4 <= (b - a) * 3) & (kinds >= 6)


def _matrix(reads: list[np.ndarray], right: bool, fill: int) -> np.ndarray:
    """Rows of codes, all to the left or all to the right."""
    out = np.full((len(reads), max(map(len, reads), default=0)), fill, np.uint8)
    for row, x in zip(out, reads):
        if len(x):
            row[-len(x) if right else 0 :][: len(x)] = x
    return out


def find_overlaps(r1: list[np.ndarray], r2: list[np.ndarray], least: int, limit: int, percent: float) -> list[tuple[str, int, int, int]]:
    """(status, insert, length, mismatches) of pairs: base codes of R1 and of R2's reverse complement."""
    n, m = (np.array([len(x) for x in reads], np.int64) for reads in (r1, r2))
    status, *values = _found(_matrix(r1, False, 8), _matrix(r2, True, 9), n, m, least, limit, percent)
    return list(zip(_STATUS[status].tolist(), *(v.tolist() for v in values)))


_STATUS = np.array(["none", "unique", "ambiguous"])


def _found(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: int, limit: int, percent: float) -> tuple[np.ndarray, ...]:
    """find_overlaps of matrices, R1 to the left and R2 to the right, and their lengths; status as its place in _STATUS.

    At an insert length, R2 ends where the insert does, so one slice of either matrix holds the overlaps of all pairs.
    """
    status, *values = (np.zeros(len(n), np.int32) for _ in range(4))
    able = np.flatnonzero((n >= least) & (m >= least)) if least else np.empty(0, np.int64)
    if not len(able):
        return status, *values
    n, m, x, y = n[able], m[able], x[able], y[able]
    known1, known2 = (np.concatenate([np.zeros((len(able), 1), np.int32), np.cumsum(z < 4, axis=1, dtype=np.int32)], axis=1) for z in (x, y))
    wide1, wide2 = x.shape[1], y.shape[1]
    by1, by2 = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)  # bases of a place side by side: sums run over whole rows
    count = np.min_scalar_type(max(wide1, wide2))
    for insert in range(least, wide1 + wide2 - least + 1):
        low, high = max(0, insert - wide2), min(wide1, insert)
        a, b = np.maximum(0, insert - m), np.minimum(n, insert)
        size = b - a
        shift = wide2 - insert
        near = np.flatnonzero((size >= least) & (insert <= n + m - least))
        if not len(near):
            continue
        if 2 * len(near) > len(n):
            same = np.add.reduce((by1[low:high] == by2[low + shift : high + shift]).view(np.uint8), axis=0, dtype=count)[near]
        else:  # few pairs are as long as that
            same = np.count_nonzero(x[near, low:high] == y[near, low + shift : high + shift], axis=1)
        miss = size[near] - same
        few = miss <= np.minimum(limit, (size[near] * percent / 100).astype(np.int64))
        near, miss = near[few], miss[few]
        c1 = known1[near, b[near]] - known1[near, a[near]]
        c2 = known2[near, b[near] + shift] - known2[near, a[near] + shift]
        whole = (c1 == size[near]) & (c2 == size[near])
        near, miss = near[whole], miss[whole]
        if not len(near):
            continue
        good = _informative_rows(x[near], a[near], b[near])
        near, miss = near[good], miss[good]
        at = able[near]
        again = status[at] > 0
        status[at] = np.where(again, 2, 1)
        for v, own in zip(values, (insert, size[near], miss)):
            v[at] = np.where(again, 0, own)
    return status, *values


def find_gap_overlap(r1: np.ndarray, r2: np.ndarray, least: int, limit: int, percent: float, fronts: tuple[int, int] = (0, 0)) -> tuple[int, int] | None:
    """Ends of both mates of a short insert that one mate has a base more of, or None.

    r2 in its own direction; fronts are the bases that clipping took in front of either mate, by
    which the other one reaches further.  The gap keeps eight bases from either edge; two
    different answers count as none.
    """
    found, (f1, f2) = None, fronts
    if least < 16:
        return None
    for size in range(least, min(len(r1) - f2, len(r2) - f1) + 1):
        gaps = np.arange(8, size - 7)
        for own in ((size + 1, size), (size, size + 1)):
            ends = (own[0] + f2, own[1] + f1)
            if ends[0] > len(r1) or ends[1] > len(r2) or not len(gaps):
                continue
            a, b = r1[: own[0]], r2[: own[1]]
            if not (_informative(a) and _informative(b)):
                continue
            back = np.where(b[::-1] < 4, 3 - b[::-1], 4)
            short, long = (back, a) if own[0] > own[1] else (a, back)
            before = np.concatenate([[0], np.cumsum(short != long[:-1])])
            after = np.concatenate([np.cumsum((short != long[1:])[::-1])[::-1], [0]])
            if (before[gaps] + after[gaps]).min() <= min(limit, int(size * percent / 100)):
                if found and found != ends:
                    return None
                found = ends
    return found


def _correct(s1, q1, s2, q2, n, m, insert) -> np.ndarray:
    """Of two bases that disagree, one of Q30 or more replaces one of Q14 or less; in place, counted by row.

    Rows of bases and qualities to the left, their lengths, and lengths of inserts."""
    i = np.arange(s1.shape[1])[None, :]
    j = insert[:, None] - 1 - i
    row, i = np.nonzero((i < n[:, None]) & (j >= 0) & (j < m[:, None]))
    j = j[row, i]
    x, y, k1, k2 = _CODE[s1[row, i]], _CODE[s2[row, j]], q1[row, i], q2[row, j]
    differ = ~((x < 4) & (y < 4) & (x == 3 - np.minimum(y, 3)))
    second = differ & (k1 >= 63) & (k2 <= 47)
    first = differ & ~second & (k2 >= 63) & (k1 <= 47)
    s2[row[second], j[second]], q2[row[second], j[second]] = _LETTER[np.where(x < 4, 3 - np.minimum(x, 3), 4)][second], k1[second]
    s1[row[first], i[first]], q1[row[first], i[first]] = _LETTER[np.where(y < 4, 3 - np.minimum(y, 3), 4)][first], k2[first]
    return np.bincount(row[first | second], minlength=len(n))


def _merge(s1, q1, s2, q2, n, m, insert, fronts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inserts from both mates and their lengths: R2's base where its quality is higher, else R1's; bases that
    front clipping took from one mate come back if the other has them."""
    left = np.minimum(fronts[0], np.maximum(0, m - insert))
    n1, m1 = np.minimum(n, insert + fronts[1]), np.minimum(m, insert + fronts[0])
    size = left + np.maximum(insert, n1)
    at = np.arange(size.max(initial=0))[None, :]
    i, j = at - left[:, None], (insert + left)[:, None] - at - 1
    told = at < size[:, None]
    in1, in2 = told & (i >= 0) & (i < n1[:, None]), told & (j >= 0) & (j < m1[:, None])
    row = np.arange(len(n))[:, None]

    def taken(of: np.ndarray, where: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, of[row, np.clip(where, 0, of.shape[1] - 1)], 0).astype(np.uint8)

    back = _CODE[s2]
    c1, k1, k2 = taken(s1, i, in1), taken(q1, i, in1), taken(q2, j, in2)
    c2 = taken(_LETTER[np.where(back < 4, 3 - back, 4)], j, in2)
    second = in2 & (~in1 | (k2 > k1))
    return np.where(second, c2, c1), np.where(second, k2, k1), size


_OVERLAP = [("overlap_status", pa.string()), *((c, pa.int32()) for c in ("insert_length", "overlap_length", "overlap_mismatches", "gap_end1", "gap_end2"))]
_MERGED = [(c, pa.string()) for c in ("seq1", "qual1", "seq2", "qual2")] + [("corrected", pa.int32())] + [(c, pa.string()) for c in ("merged_id", "merged_seq", "merged_qual")]


def _back(y: np.ndarray) -> np.ndarray:
    return np.where(y[::-1] < 4, 3 - y[::-1], 4).astype(np.uint8)


def _rows(column: pa.Array, fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts as rows, all to the left, and their lengths (null: 0)."""
    text = column.cast(pa.string())
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    n = np.diff(offsets).astype(np.int64)
    out = np.full((len(n), n.max(initial=0)), fill, np.uint8)
    if offsets[-1] > offsets[0]:
        out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return out, n


def _texts(rows: np.ndarray, n: np.ndarray) -> list[str]:
    """Texts of rows that are to the left."""
    return [row[:size].tobytes().decode() for row, size in zip(rows, n.tolist())]


def _added(df: DataFrame, fields: list, columns) -> DataFrame:
    """df with more columns: columns gives them for a batch; those of the same name are replaced."""
    kinds = {pa.string(): T.StringType(), pa.int32(): T.IntegerType()}
    new = [n for n, _ in fields]
    schema = T.StructType([f for f in df.schema if f.name not in new] + [T.StructField(n, kinds[k]) for n, k in fields])

    def run(batches):
        for batch in batches:
            old = [n for n in batch.schema.names if n not in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in old), *(v if isinstance(v, pa.Array) else pa.array(v, k) for v, (_, k) in zip(columns(batch), fields))], names=old + new)

    return df.mapInArrow(run, schema)


def overlaps(df: DataFrame, seqs: tuple[str, str] = ("seq1", "seq2"), least: int = 30, limit: int = 5, percent: float = 20, gap: bool = False, fronts: tuple[str, str] | None = None, where: str | None = None) -> DataFrame:
    """df with overlap_status (unique, ambiguous or none), insert_length, overlap_length,
    overlap_mismatches, gap_end1 and gap_end2.  seqs and fronts name its columns of clipped bases
    and of bases clipped in front; rows whose column `where` isn't true, or that lack a mate, have none.

    Only these columns go to Python, so that others are not made where nothing asks for them."""
    names = [name for name, _ in _OVERLAP]

    def found(*columns: pa.Array) -> pa.Array:
        (b1, n), (b2, m) = map(_rows, columns[:2])
        one, two = _CODE[b1], _CODE[b2]
        at1, at2 = (np.arange(b.shape[1])[None, :] < k[:, None] for b, k in ((b1, n), (b2, m)))
        x, y = np.where(at1, one, 8), np.where(at2, np.where(two < 4, 3 - two, 4), 9)[:, ::-1]
        status, *values = _found(x.astype(np.uint8), y.astype(np.uint8), n, m, least, limit, percent)
        ends = [(None, None)] * len(n)
        for r in np.flatnonzero((status == 0) & (n > 0) & (m > 0)) if gap else ():
            front = tuple(c[int(r)].as_py() for c in columns[2:]) or (0, 0)
            ends[r] = find_gap_overlap(one[r, : n[r]], two[r, : m[r]], least, limit, percent, front) or (None, None)
        told = [pa.array(_STATUS.tolist()).take(pa.array(status)), *values, [e[0] for e in ends], [e[1] for e in ends]]
        return pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, (_, k) in zip(told, _OVERLAP)], names)

    # not deterministic: else a filter on what it finds would call it once more
    udf = F.arrow_udf(found, ", ".join(f"{n}: {'string' if k == pa.string() else 'int'}" for n, k in _OVERLAP)).asNondeterministic()
    bases = [F.when(F.col(where), F.col(c)) if where else F.col(c) for c in seqs]
    old = [c for c in df.columns if c not in names]
    return df.select(*old, udf(*bases, *(F.col(c) for c in (fronts or ()) if gap)).alias("_overlap")).select(*old, "_overlap.*")


def consensus(df: DataFrame, columns: tuple[str, ...] = ("seq1", "qual1", "seq2", "qual2"), correct: bool = False, merge: bool = False, fronts: tuple[str, str] | None = None) -> DataFrame:
    """df (id1, insert_length and overlap_status of what columns hold) with seq1, qual1, seq2, qual2
    corrected, corrected (how many bases), and merged_id, merged_seq, merged_qual.  Correction comes
    first; pairs without a unique overlap keep their bases."""

    def made(batch):
        status = np.array(batch.column("overlap_status").to_pylist(), object)
        at = np.flatnonzero(status == "unique")
        own = [batch.column(c) for c in columns]
        fixed, merged = np.zeros(batch.num_rows, np.int32), [[None] * batch.num_rows for _ in range(3)]
        if len(at):
            taken = pa.array(at)
            (s1, n), (q1, _), (s2, m), (q2, _) = (_rows(c.take(taken)) for c in own)
            insert = np.array(batch.column("insert_length").take(taken).to_pylist(), np.int64)
            if correct:
                fixed[at] = _correct(s1, q1, s2, q2, n, m, insert)
                new = np.flatnonzero(fixed[at])
                own = [c.to_pylist() for c in own] if len(new) else own
                for side, rows, size in zip(own, (s1, q1, s2, q2), (n, n, m, m)) if len(new) else ():
                    for r, text in zip(at[new].tolist(), _texts(rows[new], size[new])):
                        side[r] = text
            if merge:
                front = [np.array(batch.column(c).take(taken).to_pylist(), np.int64) for c in fronts] if fronts else [np.zeros(len(at), np.int64)] * 2
                seq, qual, size = _merge(s1, q1, s2, q2, n, m, insert, front)
                for r, name, s, q in zip(at.tolist(), batch.column("id1").take(taken).to_pylist(), _texts(seq, size), _texts(qual, size)):
                    first, *_ = (name or "").split(None, 1) or [""]
                    merged[0][r], merged[1][r], merged[2][r] = first.removesuffix("/1") + (name or "")[len(first) :] + " merged", s, q
        return [*own, fixed, *merged]

    return _added(df, _MERGED, made)


def pair_features(pairs: DataFrame, least: int = 30, limit: int = 5, percent: float = 20, correct: bool = False, merge: bool = False, gap: bool = False) -> DataFrame:
    """overlaps and consensus of pairs (id1, seq1, qual1, id2, seq2, qual2, already clipped)."""
    return consensus(overlaps(pairs, least=least, limit=limit, percent=percent, gap=gap), correct=correct, merge=merge)


def overlapped_span(text: Column, other: Column) -> Column:
    """The part of R1's bases or qualities that a unique overlap without mismatches covers, or null;
    other: R2's bases."""
    start = F.greatest(F.col("insert_length") - F.length(other), F.lit(0))
    exact = (F.col("overlap_status") == "unique") & (F.col("overlap_mismatches") == 0)
    return F.when(exact, F.substring(text, start + 1, F.col("overlap_length")))
