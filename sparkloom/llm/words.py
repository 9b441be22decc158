"""Words of a batch of UTF-8 texts as arrays: where they stand, and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import SLICE_BYTES, runs

ALL = np.arange(256)
#: Anything but space and U+0009 to U+000D.
NOT_SPACE = (ALL != 0x20) & ~((ALL >= 0x09) & (ALL <= 0x0D))
#: ASCII digits and small letters, and anything beyond ASCII; for lower-cased bytes.
ALPHANUMERIC = (ALL >= 0x80) | (ALL >= 0x30) & (ALL <= 0x39) | (ALL >= 0x61) & (ALL <= 0x7A)
LOWER = np.where((ALL >= 0x41) & (ALL <= 0x5A), ALL + 0x20, ALL).astype(np.uint8)

_DRAW = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte, and the base of the polynomial; fixed by the seed.
BYTE_VALUE = _DRAW.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
BASE = int(_DRAW.integers(0, 1 << 64, dtype=np.uint64, endpoint=False)) | 5
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        found = np.full(max(n, 64), BASE, np.uint64)
        found[0] = 1
        _POWERS = np.cumprod(found, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find(lowered: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words, and for each text the place of its first word (one more at the end)."""
    starts, stops = runs(member[lowered], at, 1)
    return starts, stops, np.searchsorted(starts, at)


def hashes(lowered: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans must be sorted and apart. Works in steps of bounded size."""
    found = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        n = max(k + 1, int(np.searchsorted(stops, starts[k] + SLICE_BYTES, "right")))
        low, high = int(starts[k]), int(stops[n - 1])
        begin, size = starts[k:n] - low, stops[k:n] - starts[k:n]
        value = BYTE_VALUE[lowered[low:high]]
        edge = np.zeros(high - low + 1, np.int8)
        edge[begin] += 1
        edge[begin + size] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        place = np.arange(high - low) - np.repeat(begin, np.diff(np.append(begin, high - low)))
        place[~inside] = 0
        value = value * powers(int(size.max()))[place]
        value[~inside] = 0
        found[k:n] = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        k = n
    return found


def shingle_sets(lowered: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; fewer words make one shingle, none no set."""
    starts, stops, first = find(lowered, at, NOT_SPACE)
    words = hashes(lowered, starts, stops)
    n = len(words)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i])
    found = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= k:
            found.append(np.unique(whole[low : high - k + 1]))
        elif high > low:
            one = np.array([high - low], np.uint64)
            for i in range(low, high):
                one = mix(one * np.uint64(0xA0761D6478BD642F) + words[i : i + 1])
            found.append(one)
        else:
            found.append(np.zeros(0, np.uint64))
    return found
