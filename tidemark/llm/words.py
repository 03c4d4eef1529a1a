"""Vectorised word and shingle hashing of UTF-8 text.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` (these
bytes never occur inside a multi-byte UTF-8 sequence, so byte runs and
character runs agree).  Every function works on whole texts: nothing is cut.
"""

from __future__ import annotations

import numpy as np

MASK64 = (1 << 64) - 1
#: Odd multiplier of the 64-bit polynomial word hash, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value per byte, so that hash bits do not depend on code order.
BYTE_VALUES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
#: The same with A-Z standing for a-z.
FOLDED_BYTE_VALUES = BYTE_VALUES.copy()
FOLDED_BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_STEP = 1 << 16
_powers = np.array([pow(BASE, i, 1 << 64) for i in range(_STEP)], dtype=np.uint64)
_inverse_powers = np.array([pow(BASE_INVERSE, i, 1 << 64) for i in range(_STEP)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    while len(_powers) < n:
        top = np.uint64(pow(BASE, len(_powers), 1 << 64))
        low = np.uint64(pow(BASE_INVERSE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * top])
        _inverse_powers = np.concatenate([_inverse_powers, _inverse_powers * low])
    return _powers, _inverse_powers


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a uint8 array."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; with ``fold`` A-Z equal a-z."""
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    powers, inverse = _power_table(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((FOLDED_BYTE_VALUES if fold else BYTE_VALUES)[data] * powers[: len(data)], out=total[1:])
    raw = (total[end] - total[start]) * inverse[start]
    return mix(raw + (end - start).astype(np.uint64)), start, end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, length = words, 1
    for bit in bin(k)[3:]:  # from runs of some length to twice that, and one word more where k's bit is set
        out = out[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + out[length:]
        length *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(BASE) + words[length:]
            length += 1
    return mix(out + np.uint64(k))


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in every run of ``width`` values."""
    at, least, length = np.arange(len(values)), values, 1
    while length < width:
        step = min(length, width - length)
        later = least[step:] < least[:-step]
        at, least = np.where(later, at[step:], at[:-step]), np.where(later, least[step:], least[:-step])
        length += step
    return at


def sequence_hash(words: np.ndarray) -> int:
    """Hash of the whole word sequence."""
    n = len(words)
    if not n:
        return 0
    powers, _ = _power_table(n)
    return int(mix(np.array([(words * powers[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))[0])
