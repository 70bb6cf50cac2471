"""Words of texts of any length, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator

SLICE_BYTES = 8 << 20


def _table(is_space) -> bytes:
    return bytes(32 if is_space(b) else b + 32 if 65 <= b <= 90 else b for b in range(256))


# Bytes of UTF-8 text to A-Z in lower case, and to a space what parts words
SPACED = _table(lambda b: b == 32 or 9 <= b <= 13)
ALNUM = _table(lambda b: b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128)


def byte_slices(text: bytes | None, table: bytes, size: int) -> Iterator[bytes]:
    """`text` by `table` in slices of about `size` bytes; no word is cut, so one word may be a longer slice."""
    at, end = 0, len(text or b"")
    while at < end:
        cut = at + size
        part = text[at:cut].translate(table)
        if cut < end and (space := part.rfind(b" ")) >= 0:
            part = part[: space + 1]
        elif cut < end:  # one word longer than a slice: take all of it
            while cut < end and table[text[cut]] != 32:
                cut += 1
            part = text[at:cut].translate(table)
        at += len(part)
        yield part


def word_slices(text: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of each slice of `text`; no word is cut."""
    for part in byte_slices(text, table, SLICE_BYTES):
        yield part.split()
