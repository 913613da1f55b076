"""Word and window hashes over many texts at once, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd 64-bit constants (any would do): bases of the two window hashes and multipliers of the mixers.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2, MIX_3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(33))) * MIX_1
    h = (h ^ (h >> np.uint64(33))) * MIX_2
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or those of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        grown = np.full(max(n, 1 << 16) * 5 // 4, step, np.uint64)
        grown[0] = 1
        have = _POWERS[(base, inverse)] = np.cumprod(grown)
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the offset of each text's first (one more than texts).

    ``bytes.split`` parts words at ASCII white space: space, tab, newline, vertical tab, form feed, return.
    """
    digest = xxhash.xxh3_64_intdigest
    parts = [t.split() for t in texts]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.fromiter((digest(w) for p in parts for w in p), np.uint64, int(ends[-1]))
    return flat, ends


def window_hashes(words: np.ndarray, ends: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words that lies in one text, its text's number and its first word's place in the text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = BASES[which]
    terms = (mix(words + MIX_3) if which else words) * powers(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    h = mix((sums[size:] - sums[:-size]) * powers(base, n, inverse=True))
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    place = np.arange(n) - ends[text]
    inside = place + size <= ends[text + 1] - ends[text]
    return h[inside], text[inside], place[inside]
