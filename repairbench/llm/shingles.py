"""Word and shingle hashes of whole texts, vectorised over batches of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text after lower-casing A-Z. A word's hash is a
polynomial over its bytes modulo 2**64, taken as a difference of prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; works in place on a uint64 array."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Bytes hashed at once (cut at white space; a longer word is hashed whole), and the longest power tables kept.
PIECE, KEPT_POWERS = 1 << 18, 1 << 19


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_M, _INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for text i the range bounds[i]:bounds[i + 1]."""
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b" ".join([t or b"" for t in texts] + [b""]), np.uint8)
    edge = np.flatnonzero(np.diff((~_SPACE[buf]).view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    h, i = [np.zeros(0, np.uint64)], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        h.append(_hashes(buf[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]))
        i = j
    return mix(np.concatenate(h)), np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(buf) + 1)
    v = _BYTE[buf]
    v *= power[: len(buf)]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    return (total[end] - total[start]) * inverse[start]


def shingle_sets(texts: list[bytes | None], size: int = SIZE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles.

    A text of fewer words is one shingle, a text without words (or null) has none.
    """
    w, bounds = word_hashes(texts)
    full = np.zeros(0, np.uint64)
    if len(w) >= size:
        full = _combined(w, size)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            s = np.sort(full[a : b - size + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield _combined(w[a:b], int(b - a))
        else:
            yield w[:0]


def _combined(w: np.ndarray, k: int) -> np.ndarray:
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h *= _M
        h += w[i : len(w) - k + 1 + i]
    h += np.uint64(k)
    return mix(h)
