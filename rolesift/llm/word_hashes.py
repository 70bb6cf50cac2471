"""64-bit hashes of all words of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

from rolesift.llm.bloom import mix

BLOCK = 1 << 18
# A hash is mix(sum of BYTE[b] * FACTOR ** (BLOCK + i)) over a word's bytes b at its places i
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, FACTOR)), dtype=np.uint64)
SPACE = mix(BYTE[32:33] * _POWERS[BLOCK])[0]  # that of a space, which no word holds


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words of `data`, which spaces part.

    `data` has at most `BLOCK` bytes, or is one word of any length.
    """
    if len(data) > BLOCK:
        return _hash_long(data), np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    spaces = np.ones(len(raw) + 2, dtype=bool)
    np.equal(raw, 32, out=spaces[1:-1])
    edges = np.flatnonzero(spaces[1:] != spaces[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE[raw] * _POWERS[: len(raw)], out=sums[1:])
    # The sum of a word has powers from its place on; bring all words to the same ones
    return mix((sums[ends] - sums[starts]) * _POWERS[BLOCK - starts]), starts


def _hash_long(word: bytes) -> np.ndarray:
    total, power = np.zeros(1, dtype=np.uint64), _POWERS[BLOCK:].copy()
    for at in range(0, len(word), BLOCK):
        raw = np.frombuffer(word[at : at + BLOCK], dtype=np.uint8)
        total += (BYTE[raw] * _POWERS[: len(raw)]).sum(dtype=np.uint64) * power
        power *= _POWERS[BLOCK]
    return mix(total)
