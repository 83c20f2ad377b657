"""Words of many texts at once as numpy arrays: their places and 64-bit hashes, without a Python string per word."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between white space: all but space and the five controls from tab to carriage return.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words of letters and digits, after lower-casing: 0-9, a-z and all of a character beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        held = np.empty(size, np.uint64)
        held[0], filled, step = 1, 1, base
        while filled < size:
            held[filled:2 * filled] = held[:filled] * np.uint64(step)
            filled, step = 2 * filled, step * step % (1 << 64)
        _powers[base] = held
    return held[:n]


def spans(offsets: np.ndarray, data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (runs of bytes of `kind` inside one text), and the index of its text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first = np.zeros(len(data) + 1, bool)
    first[filled] = True
    first[-1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of every word, equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=total[1:])
    return mixed((total[end] - total[start]) * powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def rolling(word: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the index of each run's first word."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out + word[j:j + n] + np.uint64(j + 1))
    at = np.flatnonzero(text[:n] == text[k - 1:])
    return out[at], at
