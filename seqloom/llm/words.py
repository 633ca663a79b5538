"""Vectorised words, word hashes and shingles over Arrow text columns.

A word is a run of characters outside space and 0x09-0x0D.  Every function works on UTF-8 bytes
in blocks of a few MB, so that memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
W_SEED = np.uint64(0xD6E8FEB86659FD93)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64  # words of more bytes are hashed one by one
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)  # the first n of 8 bytes


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time: every step is a bijection of the
    hash for given bytes, and words of up to eight bytes never collide with others of their length."""
    size = ends - starts
    out = W_SEED ^ (size.astype(np.uint64) * _ODD)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # data has eight bytes to spare
    at = np.flatnonzero(size <= _LONG)
    s, n = starts[at], size[at]
    while len(at):
        out[at] = mix(out[at] ^ (eight[s] & _KEEP[np.minimum(n, 8)])) * _ODD
        go = n > 8
        at, s, n = at[go], s[go] + 8, n[go] - 8
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=int(size[i]))
    return mix(out)


@dataclass
class Words:
    """hashes, and byte starts and ends, of the words of several texts; text d has [first[d], first[d+1])."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def chunks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) for consecutive rows i..j of a string column; nulls are empty."""
    column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    sep = _SEP[data]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = sep
    before[offs[:-1]] = True
    before[n] = True
    starts = np.flatnonzero(~sep & before[:-1])
    after = np.empty(n, bool)
    after[:-1] = sep[1:]
    if n:
        after[-1] = True
    edges = offs[1:-1]
    after[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(~sep & after) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    hashes = _word_hashes(padded, starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, offs))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter sequence is one shingle; none without words."""
    if not len(h):
        return h
    if len(h) < k:
        out = np.uint64(len(h))
        with np.errstate(over="ignore"):
            for x in h:
                out = (out ^ x) * _ODD + np.uint64(1)
        return mix(np.array([out], np.uint64))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _ODD + np.uint64(1)
    return mix(out)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
