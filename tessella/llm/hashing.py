"""Vectorised hashing of byte buffers: words, word shingles, windows of a fixed width."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
#: A random odd 64-bit value for every byte value.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHINGLE = 5


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, p * _U(pow(b, len(p), 1 << 64))))
            both.append(p)
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of a buffer: n + 1 values."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:-1], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte span, wherever it lies."""
    _, inverse = powers(len(sums))
    return mix((sums[stop] - sums[start]) * inverse[start])


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window of width bytes that begins at each place."""
    n = len(sums) - width
    _, inverse = powers(len(sums))
    return mix((sums[width:] - sums[:n]) * inverse[:n])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text of a chunk, sorted within a text, and where each text's begin (n + 1 places).

    Words are runs of other bytes than 0x20 and 0x09-0x0D, A-Z in lower case. A text of fewer words than a shingle has
    its whole sequence as the one shingle; one without words has none.
    """
    n_texts = len(offsets) - 1
    low = _LOWER[data]
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = spans(prefix(low), start, stop)
    first = np.searchsorted(start, offsets)  # words before each text
    n_words = np.diff(first)
    if len(h) >= SHINGLE:
        rolled = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _U(0xA0761D6478BD642F) + h[k : len(h) - SHINGLE + 1 + k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    sets, at = [], np.zeros(n_texts + 1, np.int64)
    for i in range(n_texts):
        w, f = n_words[i], first[i]
        if w >= SHINGLE:
            own = np.unique(rolled[f : f + w - SHINGLE + 1])
        elif w:
            x = _U(int(w))
            for k in range(w):
                x = mix(np.array([x]) * _U(0xE7037ED1A0B428DB) + h[f + k])[0]
            own = np.array([x], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        at[i + 1] = at[i] + len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), at


def set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; equal sets have equal keys, an empty set zeros."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ _U(salt)))))
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def coordinate_multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def min_hashes(values: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures, one row a non-empty set (in order), as unsigned 32-bit coordinates."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), coordinates), np.uint32)
    if len(full):
        starts = at[full]
        for k, m in enumerate(coordinate_multipliers(coordinates)):
            out[:, k] = np.minimum.reduceat(values * m, starts) >> _U(32)
    return out
