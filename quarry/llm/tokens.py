"""Words of whole texts as 64-bit hashes, vectorised over Arrow buffers.

Words are the runs of bytes outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased.
A word's hash is sum of T[byte] * R^position, modulo 2^64, over its bytes,
mixed with its length; T is a table of random 64-bit numbers.  Prefix sums
give all words of a buffer at once.  Words of ``LIMIT`` bytes or more are
hashed one by one with BLAKE2b, so no array grows with a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

LIMIT = 1 << 18
_R = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX
    return x ^ (x >> _SHIFT)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    t = mix((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)))
    t = mix(t + np.uint64(0x2545F4914F6CDD1D))
    t[65:91] = t[97:123]
    p = np.full(LIMIT + 1, _R, dtype=np.uint64)
    p[0] = 1
    return t, np.cumprod(p, dtype=np.uint64)


_T, _P = _tables()


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _hash(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words in ``data`` (at most LIMIT bytes); a word
    also ends at each of the positions ``cuts``."""
    n = len(data)
    space = _SPACE[data]
    c = _T[data]
    c *= _P[:n]
    s = np.empty(n + 1, np.uint64)
    s[0] = 0
    np.cumsum(c, out=s[1:])
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(space[1:], space[:-1], out=edge[1:n])
    edge[cuts] = True
    at = np.flatnonzero(edge)
    lo, hi = at[:-1], at[1:]
    word = ~space[lo]
    lo, hi = lo[word], hi[word]
    h = (s[hi] - s[lo]) * _P[len(_P) - 1 - lo]
    return lo, mix(h ^ mix((hi - lo).astype(np.uint64)))


def _long(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower(), digest_size=8).digest(), "little")


def _segments(data: np.ndarray, off: np.ndarray):
    """(first byte, last byte + 1) of pieces of at most LIMIT bytes that end
    at a text's end or at white space; a longer word is a piece of its own."""
    i, n, pos = 0, len(off) - 1, 0
    while pos < len(data):
        i = int(np.searchsorted(off, pos, side="right")) - 1
        j = int(np.searchsorted(off, pos + LIMIT - 1, side="right")) - 1
        end = int(off[j])
        if end <= pos:  # inside one text
            end = int(off[i + 1])
            if end - pos >= LIMIT:
                blank = np.flatnonzero(_SPACE[data[pos:pos + LIMIT]])
                if len(blank) and blank[-1] > 0:
                    end = pos + int(blank[-1])
                elif len(blank):
                    end = pos + 1
                else:
                    for k in range(pos, end, LIMIT):
                        blank = np.flatnonzero(_SPACE[data[k:min(k + LIMIT, end)]])
                        if len(blank):
                            end = k + int(blank[0])
                            break
        yield pos, end
        pos = end


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text) of a column."""
    data, off = buffers(col)
    starts, hashes = [], []
    with np.errstate(over="ignore"):
        for a, b in _segments(data, off):
            piece = data[a:b]
            if b - a >= LIMIT:  # one word: see _segments
                starts.append(np.asarray([a]))
                hashes.append(np.asarray([_long(piece.tobytes())], np.uint64))
                continue
            lo, hi = np.searchsorted(off, [a, b], side="right")
            cuts = off[lo:hi] - a
            s, h = _hash(piece, cuts[(cuts > 0) & (cuts < b - a)])
            starts.append(s + a)
            hashes.append(h)
    if not starts:
        return np.empty(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    s, h = np.concatenate(starts), np.concatenate(hashes)
    return h, np.diff(np.searchsorted(s, off, side="left"))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of equal values, its length)."""
    n = len(sorted_values)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return at, np.diff(np.append(at, n))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting is faster than hashing here)."""
    v = np.sort(values)
    return v[runs(v)[0]]
