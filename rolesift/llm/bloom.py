"""A blocked Bloom filter in numpy; all bits of a key lie in one block of 512."""

from __future__ import annotations

import numpy as np

BLOCK_BITS = 512
PROBES = 4
_STEP = 1 << 14  # keys put in or looked up at once, few enough for a core's cache
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each 64-bit key."""
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _scrambled(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return mix(keys + np.array([0x9E3779B97F4A7C15], dtype=np.uint64) * np.asarray(level, dtype=np.uint64))


def _place(scrambled: np.ndarray, probe: int) -> np.ndarray:
    """One of four places of 0..511 for each key."""
    return (scrambled >> np.uint64(9 * probe)) & np.uint64(BLOCK_BITS - 1)


def add(words: np.ndarray, blocks_of_keys: np.ndarray, keys: np.ndarray, level: np.ndarray | int) -> None:
    """Set the bits of (key, level); blocks are counted from the first one of `words`."""
    level = np.broadcast_to(level, len(keys))
    for k in range(0, len(keys), _STEP):
        base = blocks_of_keys[k : k + _STEP] * np.uint64(BLOCK_BITS)
        h = _scrambled(keys[k : k + _STEP], level[k : k + _STEP])
        for probe in range(PROBES):
            at = base + _place(h, probe)
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))


def has(words: np.ndarray, blocks_of_keys: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """Whether (key, level) may have been added."""
    found, filled = np.zeros(len(keys), dtype=bool), words.astype("<u8", copy=False).view(np.uint8)
    for k in range(0, len(keys), _STEP):
        h = _scrambled(keys[k : k + _STEP], level)
        first = (blocks_of_keys[k : k + _STEP] * np.uint64(BLOCK_BITS // 8)).view(np.int64)
        place, ok = np.arange(k, k + len(h)), np.ones(len(h), dtype=np.uint8)
        for probe in range(PROBES):
            bit = _place(h, probe).astype(np.uint16)
            ok &= filled[first + (bit >> 3)] >> (bit & 7).astype(np.uint8)
            if 2 * np.count_nonzero(ok) < len(ok):  # go on with those left
                left = np.flatnonzero(ok)
                place, first, h, ok = place[left], first[left], h[left], ok[left]
        found[place] = ok
    return found
