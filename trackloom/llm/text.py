"""Vectorised pieces of text work inside tasks: bytes of Arrow strings, words, shingles, fingerprints.

A *word* is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased, so
letters, digits and anything outside ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a task; a longer document is handled alone.
CHUNK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k below n at least."""
    if (size := len(_powers[0][0]) if 0 in _powers else 0) < n:
        size = max(n, 2 * size, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        both = []
        for base in (BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[0] = (both[0], both[1])
    return _powers[0][0][:n], _powers[0][1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets of the rows in them); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    lengths = np.diff(ends)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null().to_numpy(zero_copy_only=False)), 0, lengths)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for first, last in runs_of(ends, size):
        offsets = ends[first : last + 1]
        part, own = raw[offsets[0] : offsets[-1]], lengths[first:last]
        if own.sum() != len(part):  # a null row that still has bytes
            keep = np.repeat(own > 0, np.diff(offsets))
            part = part[keep]
        yield first, last, part, np.concatenate([[0], np.cumsum(own)]).astype(np.int64)


def runs_of(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(first row, last row + 1) of runs of at most ``size`` bytes; a longer row is a run of its own."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and how many words each row has.

    A word's is a sum of hashes of every byte with its place, so no pattern of letters cancels.
    """
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | edge[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sizes = e - s
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    parts = mixed(_LOWER[data[is_word]].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(8)))
    found = mixed(np.add.reduceat(parts, first)) if len(s) else np.zeros(0, np.uint64)
    return found, np.diff(np.searchsorted(s, offsets))


def sequence_keys(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each row's sequence of words: sums of hashes of every word with its place."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    place = (np.arange(len(found)) - np.repeat(ends[:-1], counts)).astype(np.uint64)
    keys = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        total = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(mixed(mixed(found ^ salt) + place * BASE), out=total[1:])
        keys.append(mixed(total[ends[1:]] - total[ends[:-1]] + counts.astype(np.uint64)))
    return keys[0], keys[1]


def shingles(found: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of k words, and how many each row has; a row of fewer words, but not none, has one."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    have = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not len(found):
        return np.zeros(0, np.uint64), have
    out_ends = np.concatenate([[0], np.cumsum(have)])
    row = np.repeat(np.arange(len(counts)), have)
    at = ends[:-1][row] + np.arange(out_ends[-1]) - out_ends[:-1][row]
    size = np.minimum(counts, k)[row]
    out = size.astype(np.uint64)
    for i in range(k):
        inside = size > i
        w = found[np.where(inside, at + i, 0)]
        out = np.where(inside, mixed(out * BASE + w), out)
    return out, have
