"""Word-shingle sets of a block of texts, in numpy."""

from __future__ import annotations

import numpy as np

from trellis.llm.common import RollingHash, byte_table, mix

SHINGLE_WORDS = 5

#: Word separators; A-Z are lower-cased.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = byte_table(11)[_LOWER]


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACE = _odd(SHINGLE_WORDS, 0)


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in ``data``."""
    word = ~_SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    return (np.flatnonzero(word & (first[:-1] | ~before)),
            np.flatnonzero(word & (first[1:] | ~after)) + 1)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: of SHINGLE_WORDS
    words each, or of the whole sequence where a text has fewer."""
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * (len(starts) - 1)
    lo, hi = word_bounds(data, starts)
    words = mix(RollingHash(_VALUE[data]).raw(lo, hi))
    at = np.searchsorted(lo, starts)
    n = max(0, len(words) - SHINGLE_WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(SHINGLE_WORDS):
        rolled += words[j:j + n] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(rolled[a:b - SHINGLE_WORDS + 1]))
        elif b > a:
            whole = (words[a:b] * _PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def minhashes(sets: list[np.ndarray], n: int, seed: int = 3) -> np.ndarray:
    """[texts, n] 32-bit minima of ``n`` hash functions over each set (0 if empty)."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), n), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for f, (odd, shift) in enumerate(zip(_odd(n, seed), _odd(n, seed + 1))):
        h = flat ^ shift
        h *= odd
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[full, f] = np.minimum.reduceat(h, at) >> np.uint64(32)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b| for sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)
