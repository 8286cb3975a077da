"""Windows of a byte string by their minimiser: the first digit of the radix passes in suffix_dedup."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Bytes hashed at each place; odd multiplier and its inverse modulo 2^64, fixed values.
GRAM = 128
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Window starts that are worked on at once; places within them take 24 bits.
CHUNK = 1 << 21


@cache
def _powers(base: int, log2: int) -> np.ndarray:
    out = np.full(1 << log2, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _upto(base: int, n: int) -> np.ndarray:
    return _powers(base, max(12, (n - 1).bit_length()))[:n]


def gram_hashes(x: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A 64-bit hash of x[i:i+k] for each i."""
    p = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * _upto(_MULTIPLIER, len(x)), out=p[1:])
    h = (p[k:] - p[:-k]) * _upto(_INVERSE, len(x) - k + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of v[i:i+w] for each i."""
    n = len(v)
    if n <= w:
        return v.min(keepdims=True)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, anchor, gram): windows text[s:s+size] for s in lo..hi have their minimiser, the leftmost gram of least
    hash, at `anchor`. Which gram it is, and where in the window, follows from the window's bytes alone."""
    parts, x = [], np.frombuffer(text, np.uint8)
    w = size - GRAM + 1
    for c in range(0, len(x) - size + 1, CHUNK):
        y = x[c : c + CHUNK + size - 1]
        h = gram_hashes(y)
        least = sliding_min(h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64), w)
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        hi = np.append(lo[1:], len(at)) - 1
        parts.append((lo + c, hi + c, at[lo] + c, h[at[lo]]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)
