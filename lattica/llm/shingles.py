"""Sets of hashed word shingles, by numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

from .order_minhash import mixed

#: The bytes that part words.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_rng = np.random.default_rng(4)
_LETTER = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
SALT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    for k, base in enumerate((BASE, INVERSE)):
        while len(_POWERS[k]) < n:
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~BLANK[data]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * SALT)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; of fewer words, the whole sequence as one."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = words[:n].copy()
    for i in range(1, width):
        out = mixed(out * SALT + words[i : i + n])
    return np.unique(mixed(out + np.uint64(width)))
