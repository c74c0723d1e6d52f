"""Words of many texts at once: spans and 64-bit hashes over one flat byte array (numpy)."""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial hash modulo 2**64 and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes whose powers of BASE are kept; also the piece in which spans are hashed.
STEP = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        p = np.full(max(n, 1), base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(p)
        if n <= 4 * STEP:
            _powers[key] = have
    return have[:n]


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves all else, UTF-8 parts included."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``is_word`` bytes; texts end runs."""
    if not len(buf):
        e = np.empty(0, np.int64)
        return e, e, e
    m = is_word[buf]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(buf)]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    stops = np.flatnonzero(m & ~after) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser with shifts and odd multipliers)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans in order, not overlapping).

    Prefix sums of a polynomial, piece by piece, so that the 8 bytes a byte
    that this takes stay small for texts of any length.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(stops, lo + STEP, side="right")))
            hi = int(stops[j - 1])
            p = powers(BASE, hi - lo)
            c = np.empty(hi - lo + 1, np.uint64)
            c[0] = 0
            np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * p, out=c[1:])
            s, e = starts[i:j] - lo, stops[i:j] - lo
            out[i:j] = (c[e] - c[s]) * powers(BASE_INV, hi - lo)[s]
            i = j
    return mix(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes (one value per possible first word)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h *= BASE
            h += words[k:k + m]
    return mix(h)
