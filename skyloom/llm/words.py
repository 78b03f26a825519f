"""Word hashes of a text, with NumPy over its bytes.

A word is a longest run of ASCII letters and digits and of bytes over 127 in the lower-case
UTF-8 text; all other ASCII characters separate words. Hashes are 64 bits, alike on every
machine: a polynomial in the bytes, finished by a mixing step.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_SEPARATES = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}
_BLOCK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64, at least n of them."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: np.ndarray) -> np.ndarray:
    gap = np.empty(len(raw) + 2, bool)
    gap[0] = gap[-1] = True
    np.take(_SEPARATES, raw, out=gap[1:-1])
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw))[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * powers(INVERSE, len(raw))[start])


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of the words of the whole text, in order; very long texts go block by block."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _BLOCK:
        return _hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        if end < len(raw):
            cuts = np.flatnonzero(_SEPARATES[raw[at:end]])
            while not len(cuts) and end < len(raw):  # one word longer than a block
                end = min(len(raw), end + _BLOCK)
                cuts = np.flatnonzero(_SEPARATES[raw[at:end]])
            if len(cuts) and end < len(raw):
                end = at + int(cuts[-1]) + 1
        parts.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; of all words if there are fewer than k."""
    k = min(k, len(words))
    if not k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + mix(words[i : i + n] + np.uint64(i))
    return mix(out)


def occurrence_labelled(items: np.ndarray) -> np.ndarray:
    """The i-th occurrence of an equal item gets a hash of its own, so that all are distinct."""
    order = np.argsort(items, kind="stable")
    same = np.empty(len(items), bool)
    same[:1] = False
    np.equal(items[order][1:], items[order][:-1], out=same[1:])
    if not same.any():
        return items
    at = np.arange(len(items))
    nth = np.empty(len(items), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return np.where(nth > 0, mix(items + nth * np.uint64(BASE)), items)
