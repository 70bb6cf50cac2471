"""Language-model scores from n-gram counts in a log-frequency Bloom filter."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial, reduce
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm import bloom
from rolesift.llm.columns import crc_remainder
from rolesift.llm.word_hashes import BLOCK, SPACE, hash_words
from rolesift.llm.words import SPACED, byte_slices
from rolesift.operators.joins import many_to_one
from rolesift.session import arrow_batches, drop_shuffles, stage, unstage

_COUNT_TOKENS = 1 << 18
_BATCH_BYTES = 4 << 20  # of rows that a task hands to Python at once
_COUNT_BITS = 62  # of the largest count
_LEVELS = 255  # a level is kept in one byte
_LEVEL_STEP = 1 << 14  # counts turned into levels at once
_BLOCK_BYTES = 2 << 20  # of texts that ask for their levels together, on average
_SHARE_BYTES = 16 << 20  # of texts that a task scores, on average
_TURNS = 2  # the texts ask in so many turns, so that only a part of the questions is on disk at once
_RUN_HEAD = np.dtype([("used", "<u2"), ("n", "<u4"), ("first", "<u8")])


@dataclass(frozen=True)
class Settings:
    """Of the model: n-gram order, least count of n-grams of two words and more, base of the
    count levels, filter bits per entry, bytes of the part of the filter that a task holds at
    once (about `part_bytes` and, unless one range has more, on average at most
    `broadcast_bytes`), weight of the shorter history. A word is frequent if it is over
    1/`frequent` of all tokens, so there are fewer than `frequent` such words. `range_bytes` of
    text on average fill a range of keys, which one task sums up and whose blocks it fills.
    N-grams of several words have keys of `key_bits` bits: two of them share one with a chance
    far below that of a false hit of the filter. Single words have 64 bits, as their counts
    are exact."""

    order: int = 3
    min_count: int = 1
    base: float = 1.5
    bits_per_entry: int = 10
    broadcast_bytes: int = 128 << 20
    part_bytes: int = 4 << 20
    page_blocks: int = 1 << 13
    weight: float = 20.0
    frequent: int = 1_000_000
    range_bytes: int = 4 << 20
    key_bits: int = 48

    def __post_init__(self):
        if self.levels > _LEVELS:
            raise ValueError(f"base {self.base} needs {self.levels} levels for the largest count, over {_LEVELS}")

    @property
    def levels(self) -> int:
        """As many as the largest count may need."""
        return levels_needed(self.base)


class _Chunk(NamedTuple):
    """Token hashes of consecutive pieces of documents, each after its history.

    `off`: a token's place in its piece; `own`: it is no history; `doc`: its document.
    """

    tokens: np.ndarray
    off: np.ndarray
    own: np.ndarray
    doc: np.ndarray

    def keys(self, order: int, bits: int) -> np.ndarray:
        """A key for the n-gram that ends at each place; use only where `off >= order - 1`."""
        keys = self.tokens
        for k in range(1, order):
            keys = bloom.mix(np.roll(self.tokens, k) * np.uint64(3) + keys + np.uint64(k))
        return keys if order == 1 else keys & np.uint64((1 << 64) - (1 << (64 - bits)))


def _whole(first: int, texts: list[bytes]) -> _Chunk:
    """Texts number `first` and on, of a block in all: each after one end, and with one at its end."""
    hashes, at = hash_words(b" ".join(texts).translate(SPACED))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    words = np.diff(np.searchsorted(at, begins), append=len(at))
    lengths = words + 2
    off = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    tokens = np.full(len(off), SPACE)
    tokens[(off > 0) & (off <= np.repeat(words, lengths))] = hashes
    return _Chunk(tokens, off, off > 0, np.repeat(np.arange(first, first + len(texts)), lengths))


def _sliced(doc: int, text: bytes, order: int) -> Iterator[_Chunk]:
    """A text over a block: one piece for each slice, and its end."""
    history = np.array([SPACE])
    for part in chain(byte_slices(text, SPACED, BLOCK), [None]):
        tokens = np.append(history, SPACE if part is None else hash_words(part)[0])
        off = np.arange(len(tokens))
        yield _Chunk(tokens, off, off >= len(history), np.full(len(tokens), doc))
        history = tokens[-max(1, order - 1) :]


def _pieces(texts: Iterable, order: int) -> Iterator[_Chunk]:
    group, size = [], 0
    for doc, text in enumerate(texts):
        text = text.as_py() or b""
        if group and size + len(text) >= BLOCK:
            yield _whole(doc - len(group), group)
            group, size = [], 0
        if len(text) >= BLOCK:
            yield from _sliced(doc, text, order)
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        yield _whole(doc + 1 - len(group), group)


def _chunks(texts: Iterable, order: int, limit: int) -> Iterator[_Chunk]:
    """Pieces of about `limit` tokens in all, in the order of the documents."""
    pieces, size = [], 0
    for piece in _pieces(texts, order):
        pieces.append(piece)
        size += len(piece.tokens)
        if size >= limit:
            yield _Chunk(*map(np.concatenate, zip(*pieces)))
            pieces, size = [], 0
    if pieces:
        yield _Chunk(*map(np.concatenate, zip(*pieces)))


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The key range of each key: equal parts of all 64-bit values, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _pack_runs(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Sorted keys and their counts, cut into runs at `starts`: of each run the first key, then the steps
    between keys and the counts byte by byte, without bytes that are all 0."""
    if not len(starts):
        return []
    steps = np.diff(keys, prepend=keys[:1])
    steps[starts] = 0
    rows = np.stack([steps, counts.astype(np.uint64)])
    heads = np.empty(len(starts), dtype=_RUN_HEAD)
    used = np.bitwise_or.reduceat(rows, starts, axis=1).astype("<u8").view(np.uint8).reshape(2, -1, 8) > 0
    heads["used"] = np.packbits(used.transpose(1, 0, 2).reshape(-1, 16), axis=1, bitorder="little").view("<u2")[:, 0]
    heads["n"], heads["first"] = np.diff(starts, append=len(keys)), keys[starts]
    used, head = _used(int(np.bitwise_or.reduce(heads["used"]))), heads.tobytes()
    columns = rows.astype("<u8").view(np.uint8).reshape(2, -1, 8)
    planes = {k: columns[k // 8, :, k % 8].tobytes() for k in used}
    size = _RUN_HEAD.itemsize
    return [
        head[k * size : (k + 1) * size] + b"".join([planes[p][a : a + n] for p in _used(bits)])
        for k, (a, n, bits) in enumerate(zip(starts.tolist(), heads["n"].tolist(), heads["used"].tolist()))
    ]


@cache
def _used(bits: int) -> tuple[int, ...]:
    return tuple(k for k in range(16) if bits >> k & 1)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _pack_runs(keys, counts, np.zeros(1, dtype=np.int64))[0]


def _run_length(run: bytes) -> int:
    return int.from_bytes(run[2:6], "little")


def _unpack_runs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all runs, one run after the other, and their counts."""
    heads = np.frombuffer(b"".join([run[: _RUN_HEAD.itemsize] for run in runs]), dtype=_RUN_HEAD)
    sizes = heads["n"].astype(np.int64)
    rows = [np.zeros((sizes.sum(), 8), dtype=np.uint8) for _ in range(2)]  # apart, so that one can go before the other
    at = 0
    for run, n, bits in zip(runs, sizes.tolist(), heads["used"].tolist()):
        for k, plane in enumerate(_used(bits)):
            rows[plane // 8][at : at + n, plane % 8] = np.frombuffer(run, np.uint8, n, _RUN_HEAD.itemsize + k * n)
        at += n
    steps, counts = (r.view("<u8")[:, 0] for r in rows)
    keys = np.cumsum(steps, dtype=np.uint64)
    # The sums go on from run to run; bring each run to its own first key
    keys += np.repeat(heads["first"].astype(np.uint64) - keys[np.cumsum(sizes) - sizes], sizes)
    return keys, counts


def _count(batches: Iterator[pa.RecordBatch], order: int, bits: int, ranges: int, apart: bool = False) -> Iterator[pa.RecordBatch]:
    """Summed n-gram counts of each chunk, one row per key range for single words and one for all longer n-grams,
    whose order is given as 2, or one for each order if they are to be kept `apart`."""
    texts = (text for batch in batches for text in batch.column("text"))
    for chunk in _chunks(texts, order, _COUNT_TOKENS):
        orders = [[k] for k in range(1, order + 1)] if apart else [[1], [*range(2, order + 1)]][: order]
        for k, *more in orders:
            keys = [chunk.keys(j, bits)[chunk.own & (chunk.off >= j - 1)] for j in (k, *more)]
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            place = _ranges(found, ranges).astype(np.int64)
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            runs = _pack_runs(found, n, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[starts]), pa.array(np.full(len(starts), k, dtype=np.int8)), pa.array(runs, pa.binary())],
                names=["range", "order", "run"],
            )


def _merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all runs, sorted, with their summed counts."""
    keys, counts = _unpack_runs(runs)
    by_key = np.argsort(keys)
    keys = keys[by_key]
    counts = counts[by_key]
    del by_key  # each of these arrays is as long as a range; no more of them at once than needed
    starts = np.flatnonzero(np.append(np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def levels_needed(base: float) -> int:
    return math.ceil(_COUNT_BITS * math.log(2) / math.log(base)) + 1 if base > 1 else _LEVELS + 1


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    """The quantised level of each count: 1 for 1, one more for each factor of `base`."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def level_counts(base: float) -> np.ndarray:
    """The count a level stands for: the middle of the counts it is given to; 0 for level 0."""
    edges = np.ceil(np.array([base**k for k in range(levels_needed(base) + 1)]) - 1e-9)
    return np.concatenate([[0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2])


@dataclass(frozen=True)
class Model:
    """The filter and the counts of single words on shared files, and what places a key in the filter.

    The filter is a row of blocks; each key range has its own blocks in it, as many as its
    entries need. `ends` has the place behind the last block of each range.
    """

    pages: DataFrame
    words: DataFrame
    runs: DataFrame
    tokens: int
    distinct: int
    ends: np.ndarray
    settings: Settings

    @property
    def ngrams(self) -> DataFrame:
        """(order, key, n) of all n-grams in the filter, to look at; counted from the texts again."""
        return self.runs.mapInArrow(partial(_ngrams, min_count=self.settings.min_count), "order byte, key long, n long")

    @property
    def blocks(self) -> int:
        return int(self.ends[-1])

    @property
    def part_ranges(self) -> int:
        """The key ranges in a row that make a part of the filter."""
        size, s = max(1, self.blocks) * bloom.BLOCK_BITS // 8, self.settings
        return max(1, len(self.ends) * min(s.part_bytes, s.broadcast_bytes) // size)


def block_of(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of each key's block in the whole filter; that behind the last for a range without any."""
    place = _ranges(keys, len(ends)).astype(np.int64)
    first = np.append(0, ends[:-1])[place]
    blocks = (ends[place] - first).astype(np.uint64)
    at = first + bloom.block_of(bloom.mix(keys), blocks).astype(np.int64)
    return np.where(blocks > 0, at, ends[-1])


def _fill(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Per key range the exact counts of its single words, and its blocks of the filter in rows of `page_blocks`."""

    def out(place: int, single: list[bytes], longer: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, n = _merge(single)
        keys, counts = _merge(longer)
        often = counts >= s.min_count
        keys, counts = np.append(words, keys[often]), np.append(n, counts[often])
        levels = np.empty(len(keys), dtype=np.uint8)
        for k in range(0, len(keys), _LEVEL_STEP):
            levels[k : k + _LEVEL_STEP] = levels_of(counts[k : k + _LEVEL_STEP], s.base)
        del counts, often
        blocks = math.ceil(int(levels.sum()) * s.bits_per_entry / bloom.BLOCK_BITS)
        filled = np.zeros(blocks * bloom.BLOCK_BITS // 64, dtype=np.uint64)
        at = bloom.block_of(bloom.mix(keys), blocks)
        for q in range(1, int(levels.max(initial=0)) + 1):
            still = levels >= q
            keys, levels, at = keys[still], levels[still], at[still]
            bloom.add(filled, at, keys, q)
        size = s.page_blocks * bloom.BLOCK_BITS // 64
        parts = [filled[k : k + size].tobytes() for k in range(0, len(filled), size)]
        yield row(place, -1, None, blocks, words, n)
        for k, part in enumerate(parts):
            yield row(place, k * s.page_blocks, part, 0, words[:0], n[:0])

    def row(place, part, filled, blocks, words, n) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        values = (place, part, filled, blocks, words.view(np.int64), n.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                          names=["range", "part", "filled", "blocks", "keys", "counts"])

    for place, runs in _by_range(batches):
        yield from out(place, runs.pop(1, []), [run for rest in runs.values() for run in rest])


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The runs of one key range after the other, by order; the rows are sorted by range."""
    now, runs = None, {}
    for batch in batches:
        for place, order, run in zip(*(batch.column(c).to_pylist() for c in ("range", "order", "run"))):
            if now is not None and place != now:
                yield now, runs
                runs = {}
            now = place
            runs.setdefault(order, []).append(run)
    if now is not None:
        yield now, runs


def _ngrams(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    for _, runs in _by_range(batches):
        for order, packed in runs.items():
            keys, n = _merge(packed)
            keep = n >= (min_count if order > 1 else 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(keep.sum(), order, dtype=np.int8)), pa.array(keys[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))],
                names=["order", "key", "n"],
            )


def train(texts: DataFrame, settings: Settings = Settings()) -> Model:
    """Count all n-grams of column `text` (binary) and put them into the filter, in one shuffle.

    Tasks sum the n-grams of chunks and send them packed, one row per chunk and key range. The
    task that gets a range sums it up, knows from that how many blocks it needs, and fills
    them. N-grams are never rows of a table. The sizes of the ranges, one number for each
    `range_bytes` of text, go through the driver.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(size / settings.range_bytes))
    runs, runs_apart = (texts.select("text").mapInArrow(
        partial(_count, order=settings.order, bits=settings.key_bits, ranges=ranges, apart=apart), "range long, order byte, run binary"
    ).repartition(ranges, "range").sortWithinPartitions("range") for apart in (False, True))
    schema = "range long, part long, filled binary, blocks long, keys array<long>, counts array<long>"
    with arrow_batches(texts.sparkSession, _BATCH_BYTES), drop_shuffles(texts.sparkSession):
        parts = stage(runs.mapInArrow(partial(_fill, s=settings), schema), "lm-filter")
    heads = parts.filter(F.col("part") < 0)
    words = heads.select(F.explode(F.arrays_zip("keys", "counts")).alias("w")).select(
        F.col("w.keys").alias("key"), F.col("w.counts").alias("n")
    )
    sums = heads.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens"),
                     F.sum(F.size("keys")).alias("distinct")).first()
    blocks = np.zeros(ranges, dtype=np.int64)
    known = heads.select("range", "blocks").toArrow()
    blocks[known.column("range").to_numpy()] = known.column("blocks").to_numpy()
    pages = parts.filter(F.col("part") >= 0).select("range", "part", "filled")
    return Model(pages, words, runs_apart, sums.tokens or 0, sums.distinct or 0, np.cumsum(blocks), settings)


def _frequent_words(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of frequent words, by key; fewer than `Settings.frequent`."""
    rows = model.words.filter(F.col("n") * model.settings.frequent > model.tokens)
    table = rows.select("key", "n").toArrow()
    keys, counts = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _levels(keys: np.ndarray, words: np.ndarray, first: int, ends: np.ndarray, most: int) -> np.ndarray:
    """Levels of keys whose blocks are in this part, by probes of one level after the other."""
    level = np.zeros(len(keys), dtype=np.uint8)
    at = block_of(keys, ends) - first
    left = np.flatnonzero((at >= 0) & (at < len(words) * 64 // bloom.BLOCK_BITS))
    at = at.astype(np.uint64)
    for q in range(1, most + 1):
        left = left[bloom.has(words, at[left], keys[left], q)]
        if not len(left):
            break
        level[left] = q
    return level


class _Known(NamedTuple):
    """What all scoring tasks share."""

    settings: Settings
    frequent: tuple[np.ndarray, np.ndarray]
    tokens: int
    distinct: int


# Levels of sorted keys, which are of single words or else of longer n-grams
_Lookup = Callable[[bool, np.ndarray], np.ndarray]


def _longer(chunk: _Chunk, s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """The places where n-grams of 2, 3 and more words end, and the keys of all these n-grams."""
    places = [np.flatnonzero(chunk.off >= k - 1) for k in range(2, s.order + 1)]
    keys = [chunk.keys(k, s.key_bits)[at] for k, at in enumerate(places, 2)]
    return places, np.concatenate([np.zeros(0, dtype=np.uint64), *keys])


def _row_sums(chunks: Iterable[tuple[_Chunk, _Lookup]], known: _Known) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Sums of consecutive chunks; gets their rows' ids last and gives all of it as one batch."""
    s, frequent, tokens, distinct, middle = *known, level_counts(known.settings.base)
    given: list[tuple[int, np.ndarray]] = []
    rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for chunk, lookup in chunks:
        single, single_back = np.unique(chunk.tokens, return_inverse=True)
        level = np.zeros((len(chunk.tokens), s.order), dtype=np.uint8)
        level[:, 0] = lookup(False, single)[single_back]
        places, keys = _longer(chunk, s)
        keys, back = np.unique(keys, return_inverse=True)
        found, begin = lookup(True, keys)[back], 0
        for k, at in enumerate(places, 1):
            level[at, k] = found[begin : begin + len(at)]
            begin += len(at)
        del keys, back, found
        count = middle[level.T]
        # A level may stand for more than its count, but never for more than all tokens
        p = (np.minimum(count[0], tokens) + 1) / (tokens + distinct + 1)
        for k in range(2, s.order + 1):
            before = np.roll(count[k - 2], 1)
            longer = (np.minimum(count[k - 1], before) + s.weight * p) / (before + s.weight)
            p = np.where(chunk.off >= k - 1, longer, p)
        own, doc, first = chunk.own, chunk.doc, int(chunk.doc[0])
        place = np.minimum(np.searchsorted(frequent[0], single), max(0, len(frequent[0]) - 1))
        hit = frequent[0][place] == single if len(frequent[0]) else np.zeros(len(single), dtype=bool)
        exact = np.zeros(len(single))
        exact[hit] = frequent[1][place[hit]]
        c, of = exact[single_back], doc[own] - first
        given.append((first, np.stack([
            np.bincount(of), np.bincount(of, c[own] > 0), np.bincount(of, np.log10(c[own] + 1)), np.bincount(of, np.log10(p[own])),
        ])))
        # Other words that the filter may hold; what it does not hold has a count of 0
        ask = own & (c == 0) & (level[:, 0] > 0)
        asked, times = np.unique(doc[ask] << 32 | single_back[ask], return_counts=True)
        rare.append((asked >> 32, single[asked & 0xFFFFFFFF].view(np.int64), times))

    def batch(ids: pa.RecordBatch) -> pa.RecordBatch:
        rows = ids.num_rows
        n_tokens, n_known, base, score = sums = np.zeros((4, rows))
        for first, values in given:
            sums[:, first : first + values.shape[1]] += values
        of, *asked = map(np.concatenate, zip(*rare))
        starts = pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                ids.column("_id"), ids.column("_row"), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)),
                pa.array(base - n_tokens * math.log10(tokens + distinct + 1)), pa.array(score),
                *(pa.ListArray.from_arrays(starts, pa.array(values, pa.int64())) for values in asked),
            ],
            names=["_id", "_row", "n_tokens", "n_known", "base_score", "score", "keys", "times"],
        )

    return batch


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per row its sums; the answers to each block's questions stand before its texts."""
    for _, parts in groupby(_cut(batches), itemgetter(0)):
        yield _score_block(parts, shared.value)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(number, whether of texts, rows): answers and the texts after them have one number."""
    number, before = 0, True
    for batch in batches:
        texts = batch.column("piece").is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(texts, prepend=~texts[:1])).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(texts)]):
            number += bool(before and not texts[a])
            before = texts[a]
            yield number, texts[a], batch.slice(a, z - a)


def _score_block(parts: Iterable[tuple[int, bool, pa.RecordBatch]], known: _Known) -> pa.RecordBatch:
    answers: dict[tuple[int, bool], list[bytes]] = {}
    ids: list[pa.RecordBatch] = []

    def texts() -> Iterator[pa.Scalar]:
        for _, of_texts, rows in parts:
            if of_texts:
                ids.append(rows.select(["_id", "_row"]).take(pa.array(np.arange(rows.num_rows))))  # a copy without the texts
                yield from rows.column("text")
                continue
            for piece, longer, run in zip(*(rows.column(c).to_pylist() for c in ("piece", "longer", "run"))):
                answers.setdefault((piece, longer), []).append(zlib.decompress(run))

    def lookup(piece: int, longer: bool, keys: np.ndarray) -> np.ndarray:
        levels = np.frombuffer(b"".join(answers.pop((piece, longer), [])), dtype=np.uint8)
        if len(levels) != len(keys):
            raise RuntimeError(f"{len(levels)} answers for {len(keys)} keys")
        return levels

    chunks = _chunks(texts(), known.settings.order, _COUNT_TOKENS)
    sums = _row_sums(((chunk, partial(lookup, piece)) for piece, chunk in enumerate(chunks)), known)
    return sums(pa.Table.from_batches(ids).combine_chunks().to_batches()[0])


def _ask(batches: Iterator[pa.RecordBatch], s: Settings, ranges: int, part_ranges: int) -> Iterator[pa.RecordBatch]:
    """The keys whose levels the texts of each block need: per piece of a block and part of the filter a run
    of single words and one of longer n-grams. Read in another task, a block may come in several pieces of rows;
    the number of its first row tells which they are."""
    rows = (row for b in batches for row in zip(b.column("block").to_pylist(), b.column("_row").to_pylist(), b.column("text")))
    for _, block in groupby(rows, itemgetter(0)):
        block = iter(block)
        head = next(block)
        for piece, chunk in enumerate(_chunks((row[2] for row in chain([head], block)), s.order, _COUNT_TOKENS)):
            for longer, keys in enumerate((chunk.tokens, _longer(chunk, s)[1])):
                keys = np.sort(keys)
                keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
                part = _ranges(keys, ranges).astype(np.int64) // part_ranges
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                same = lambda value, kind: pa.array(np.full(len(starts), value), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[starts]), pa.nulls(len(starts), pa.int64()), same(head[1], pa.int64()), same(piece, pa.int32()),
                     same(bool(longer), pa.bool_()), pa.array(_pack_runs(keys, np.zeros(len(keys)), starts), pa.binary())],
                    names=["part", "page", "_row", "piece", "longer", "run"],
                )


def _answer(batches: Iterator[pa.RecordBatch], s: Settings, ends: np.ndarray, part_ranges: int) -> Iterator[pa.RecordBatch]:
    """The levels of each run of keys, one byte each, deflated; in each part the filter's pages come first."""
    size, starts = bloom.BLOCK_BITS // 64, np.append(0, ends[:-1])
    now, first, words, held, keys = None, 0, np.zeros(0, dtype=np.uint64), [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            *same, runs = zip(*held)
            levels, cuts = _levels(_unpack_runs(runs)[0], words, first, ends, s.levels).tobytes(), np.cumsum([0, *map(_run_length, runs)])
            found = [zlib.compress(levels[a:z], 1) for a, z in zip(cuts[:-1], cuts[1:])]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*same, found], kinds)],
                                             names=["part", "_row", "piece", "longer", "run"])

    for batch in batches:
        for part, page, row, piece, longer, run in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                yield from out()
                now, held, keys = part, [], 0
                first = int(starts[part * part_ranges])
                words = np.zeros((int(ends[min((part + 1) * part_ranges, len(ends)) - 1]) - first) * size, dtype=np.uint64)
            if page is not None:  # of range number `row`
                at = (int(starts[row]) + page - first) * size
                words[at : at + len(run) // 8] = np.frombuffer(run, dtype=np.uint64)
                continue
            held.append((part, row, piece, longer, run))
            keys += _run_length(run)
            if keys >= _COUNT_TOKENS:
                yield from out()
                held, keys = [], 0
    yield from out()


def _answers(rows: DataFrame, model: Model, turn: int) -> DataFrame:
    """Runs of levels for the pieces of those `rows` whose turn it is, each run from one part of the filter."""
    s, per = model.settings, model.part_ranges
    pages = model.pages.select(
        F.floor(F.col("range") / per).alias("part"), F.col("part").alias("page"), F.col("range").alias("_row"),
        F.lit(None).cast("int").alias("piece"), F.lit(None).cast("boolean").alias("longer"), F.col("filled").alias("run"),
    )
    ask = partial(_ask, s=s, ranges=len(model.ends), part_ranges=per)
    asked = _in_turn(rows, turn).select("block", "_row", "text").mapInArrow(
        ask, "part long, page long, _row long, piece int, longer boolean, run binary")
    by_part = asked.unionByName(pages).repartition(math.ceil(len(model.ends) / per), "part")
    return by_part.sortWithinPartitions("part", F.col("page").asc_nulls_last()).mapInArrow(
        partial(_answer, s=s, ends=model.ends, part_ranges=per), "part long, _row long, piece int, longer boolean, run binary")


def _in_turn(rows: DataFrame, turn: int) -> DataFrame:
    return rows.filter(F.col("block") % _TURNS == turn)


def _block(bits: int) -> Column:
    """Rows that stood together, some 2 to the `bits` of them."""
    return F.shiftright("_row", bits)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_tokens, n_known, base_score, score.

    `score` sums log10 of each token's smoothed probability: the count of its n-gram plus
    `weight` times the probability by the shorter history, over the count of the history plus
    `weight`; counts are those that the levels found in the filter stand for. `base_score` and
    `n_known` use exact counts: of frequent words, which are few by division, in the same
    pass, of others by a join.

    The filter is never in one place: a task holds a part of it, and the texts ask it by a shuffle of
    their n-grams' keys, which the part's task answers by a second one, to which the texts are dealt too.
    So each text and each part is read as often however many there are. The texts are written once for it;
    what is written is dropped after the scoring.
    Null and empty texts are one end token. Repeated rows and null ids get a row each.
    """
    spark, s = docs.sparkSession, model.settings
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("_row"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    rows = stage(rows, "lm-texts")
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = max(0, int(math.log2(_BLOCK_BYTES * max(1, n) / max(1, size or 0))))
    tasks = max(1, math.ceil((size or 0) / _SHARE_BYTES / _TURNS))
    rows = rows.withColumn("block", _block(bits))
    shared = spark.sparkContext.broadcast(_Known(s, _frequent_words(model), model.tokens, model.distinct))
    schema = (
        f"_id {kind}, _row long, n_tokens long, n_known long, base_score double, score double, "
        "keys array<long>, times array<long>"
    )
    with arrow_batches(spark, _BATCH_BYTES), drop_shuffles(spark):
        answers, sums = [stage(_answers(rows, model, turn), "lm-answers") for turn in range(_TURNS)], []
        for turn, given in enumerate(answers):
            both = _in_turn(rows, turn).unionByName(given.withColumn("block", _block(bits)), allowMissingColumns=True)
            dealt = both.repartition(tasks, "block").sortWithinPartitions(
                "block", "_row", F.col("piece").asc_nulls_last(), "longer", "part")
            sums.append(stage(dealt.mapInArrow(partial(_score, shared=shared), schema), "lm-sums"))
            unstage(given)
    unstage(rows)
    shared.destroy()
    rows = reduce(DataFrame.unionByName, sums)
    asked = rows.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select(
        "_row", F.col("w.keys").alias("key"), F.col("w.times").alias("times")
    )
    words = model.words.filter(F.col("n") * s.frequent <= model.tokens)
    with drop_shuffles(spark):
        found = many_to_one(asked, words, ["key"])
    more = found.groupBy("_row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_base")
    )
    return rows.join(more, "_row", "left").select(
        F.col("_id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
    )


def lm_digest(docs: DataFrame, settings: Settings = Settings(), folds: int = 7, held: int = 2,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows whose id's crc32 modulo `folds` is known and not `held`; a
    null id is held out. Other edge cases as in `score_texts`; an empty table gives an empty
    result, and without rows to learn from all counts are 0.
    """
    learned = F.coalesce(crc_remainder(F.col(id_col), folds) != held, F.lit(False))
    model = train(docs.filter(learned).select(F.col(text_col).cast("binary").alias("text")), settings)
    return score_texts(docs, model, id_col, text_col).select(
        id_col, (~learned).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
