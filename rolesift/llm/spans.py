"""A table-driven pass over UTF-8 bytes: word spans, characters, and hashes of spans, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
SYMBOLS = b"#$%&*|"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")

# States: outside and inside a word. Marks that a byte gives:
WORD_START, WORD_END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state after each byte, and the marks of each byte in each state."""
    byte = np.arange(256)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    after = (~space).astype(np.uint8)
    plain = (
        CAPITAL * ((byte >= 65) & (byte <= 90))
        + POINT * ((byte < 0x80) | (byte > 0xBF))
        + SYMBOL * np.isin(byte, list(SYMBOLS))
    )
    marks = np.stack([plain + WORD_START * ~space, plain + WORD_END * space])
    return after, marks.astype(np.uint8)


_AFTER, _MARKS = _tables()

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


class _Powers:
    """Powers of the hash factor and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            first = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate([first, np.full(n - 1, _FACTOR)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([first, np.full(n - 1, _INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass(frozen=True)
class Chunk:
    """Whole pieces of texts one after the other, each with a space behind it.

    `piece_of` names the text of each piece; `starts` are the pieces' first bytes.
    """

    piece_of: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    marks: np.ndarray

    def count(self, mark: int) -> np.ndarray:
        """How many bytes of each piece have the mark; the space behind counts too."""
        return np.add.reduceat((self.marks & mark) != 0, self.starts, dtype=np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and piece of each word."""
        begin = np.flatnonzero((self.marks & WORD_START) != 0)
        end = np.flatnonzero((self.marks & WORD_END) != 0)
        return begin, end, np.repeat(np.arange(len(self.starts)), self.count(WORD_START))

    def hashes(self) -> SpanHashes:
        return SpanHashes(self.data)


class SpanHashes:
    """Hashes of any spans of the bytes, equal for equal bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]


def scramble(hashes: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; the high bits depend on all bits."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about a chunk, cut behind white space: no word is cut."""
    at = 0
    while len(text) - at > CHUNK_BYTES and (space := _SPACE.search(text, at + CHUNK_BYTES)):
        yield text[at : space.end()]
        at = space.end()
    if at < len(text) or not text:
        yield text[at:]


def chunks(texts: list[bytes]) -> Iterator[Chunk]:
    """All texts, in chunks of about `CHUNK_BYTES`."""
    pieces: list[bytes] = []
    owners: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        for piece in _pieces(text):
            pieces.append(piece)
            owners.append(n)
            size += len(piece) + 1
            if size >= CHUNK_BYTES:
                yield _chunk(pieces, owners)
                pieces, owners, size = [], [], 0
    if pieces:
        yield _chunk(pieces, owners)


def _chunk(pieces: list[bytes], owners: list[int]) -> Chunk:
    data = np.frombuffer(b" ".join([*pieces, b""]), dtype=np.uint8)
    after = _AFTER[data]
    # Each piece has a space behind it, so each begins outside a word
    before = np.concatenate([np.zeros(1, dtype=np.uint8), after[:-1]])
    lengths = np.array([len(p) + 1 for p in pieces])
    marks = _MARKS.ravel()[(before.astype(np.uint16) << 8) | data]
    return Chunk(np.array(owners), np.cumsum(lengths) - lengths, data, marks)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at `a` and at `b`, of equal lengths over 0, have the same bytes."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    starts = np.cumsum(lengths) - lengths
    off = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    equal = data[np.repeat(a, lengths) + off] == data[np.repeat(b, lengths) + off]
    return np.logical_and.reduceat(equal, starts)


def first_of_each(chunk: Chunk, begin: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """For each word the first word of its piece with the same bytes, or a later one if that one is later put in.

    All words are put into one open hash table by (piece, hash). A word that meets a taken
    place compares piece, length and bytes with its holder: if they are the same it is that
    word again, else it goes on to the next place.
    """
    n = len(begin)
    holder_of = np.arange(n)
    if not n:
        return holder_of
    bits = max(4, int(2 * n - 1).bit_length())
    table = np.full(1 << bits, -1, dtype=np.int64)
    key = scramble(chunk.hashes()(begin, end) + piece.astype(np.uint64) * _FACTOR)
    place = (key >> np.uint64(64 - bits)).astype(np.int64)
    length = end - begin
    left = np.arange(n)
    while len(left):
        at = place[left]
        free = table[at] < 0
        # Written from the last to the first: the first word to come takes a free place
        table[at[free][::-1]] = left[free][::-1]
        holder = table[at]
        same = holder == left
        ask = np.flatnonzero(~same & (key[holder] == key[left]) & (piece[holder] == piece[left]) & (length[holder] == length[left]))
        same[ask] = _same_bytes(chunk.data, begin[holder[ask]], begin[left[ask]], length[left[ask]])
        holder_of[left[same]] = holder[same]
        left = left[~same]
        place[left] = (place[left] + 1) & ((1 << bits) - 1)
    return holder_of
