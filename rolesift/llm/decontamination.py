"""Benchmark passages in documents, found by an FM-index per shard of the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.columns import numbered, place_of
from rolesift.llm.fm_index import FMIndex
from rolesift.llm.words import ALNUM, word_slices

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16 << 20
HELD_BYTES = 24 << 20

_FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("item_ids", pa.list_(pa.string())),
])
FOUND_TYPE = "struct<n_words:bigint, spans:array<struct<start:bigint,end:bigint>>, item_ids:array<string>>"


class PhraseBlock:
    """The phrases of some benchmark items as symbol arrays, by length, and their items."""

    def __init__(self, items: Sequence[tuple[str | None, bytes | None]], window: int):
        self.window, self.symbols = window, {}
        phrases: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item_id, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for words in word_slices(text, ALNUM) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                phrases.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item_id)
        self.bits = max(1, len(self.symbols).bit_length())
        self.phrases = {
            size: (np.array(list(found), dtype=np.int64), list(found.values()))
            for size, found in phrases.items()
        }


class _Shard:
    """Symbols of whole documents, or of overlapping pieces of a very long one."""

    def __init__(self, block: PhraseBlock):
        self.block, self.parts, self.size = block, [], 0

    def add(self, doc: int, first_word: int, ids: np.ndarray) -> None:
        """A run of words; other words than the block's become one terminator a run."""
        keep = np.ones(len(ids), dtype=bool)
        keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
        places = np.flatnonzero(keep)
        self.parts.append((doc, first_word, ids[places], places))
        self.size += len(places) + 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str | None]]]:
        """Of each occurrence: its document, first word, length, and the items it is of."""
        docs, firsts, lengths, items = [], [], [], []
        if self.size and self.block.phrases:
            text = np.zeros(self.size, dtype=np.int64)
            doc_at, word_at = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
            at = 0
            for doc, first_word, ids, places in self.parts:
                to = at + len(ids)
                text[at:to], doc_at[at:to], word_at[at:to] = ids, doc, places + first_word
                at = to + 1
            index = FMIndex(text, self.block.bits)
            for size, (phrases, of) in self.block.phrases.items():
                which, low, high = index.search(phrases)
                count = high - low
                rows = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
                position = index.locate(rows)
                docs.append(doc_at[position])
                firsts.append(word_at[position])
                lengths.append(np.full(len(position), size))
                items += [of[w] for w in np.repeat(which, count)]
        self.parts, self.size = [], 0
        whole = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (docs, firsts, lengths)]
        return *whole, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order; touching ones are one."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _search(batches: Iterator[pa.RecordBatch], block: PhraseBlock, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Adds the block's hits to column `_found`; columns `_text` and the rest pass through."""
    shard, symbol = _Shard(block), block.symbols
    held: list[pa.RecordBatch] = []
    counts: list[int] = []
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str | None]] = {}

    def settle() -> None:
        for doc, first, size, of in zip(*(x if isinstance(x, list) else x.tolist() for x in shard.hits())):
            spans.setdefault(doc, []).append((first, first + size))
            items.setdefault(doc, set()).update(of)
        for doc, found in spans.items():
            spans[doc] = merge_spans(found)

    def flush() -> Iterator[pa.RecordBatch]:
        settle()
        at = 0
        for batch in held:
            column = batch.schema.get_field_index("_found")
            found = []
            for k, old in enumerate(batch.column(column).to_pylist(), at):
                old = old or {"spans": [], "item_ids": []}
                both = [(s["start"], s["end"]) for s in old["spans"]] + spans.get(k, [])
                found.append({
                    "n_words": counts[k],
                    "spans": [{"start": s, "end": e} for s, e in merge_spans(both)],
                    "item_ids": sorted({*old["item_ids"], *(i for i in items.get(k, ()) if i is not None)}),
                })
            at += batch.num_rows
            yield batch.set_column(column, "_found", pa.array(found, _FOUND))
        held.clear(), counts.clear(), spans.clear(), items.clear()

    for batch in batches:
        for text in batch.column(batch.schema.get_field_index("_text")):
            first, tail = 0, np.empty(0, dtype=np.int64)
            for words in word_slices(text.as_py(), ALNUM):
                ids = np.fromiter((symbol.get(w, 0) for w in words), dtype=np.int64, count=len(words))
                piece = np.concatenate([tail, ids])  # begins with what a phrase may need of the last slice
                shard.add(len(counts), first - len(tail), piece)
                first, tail = first + len(words), piece[-(block.window - 1):] if block.window > 1 else tail
                if shard.size >= shard_words:
                    settle()
            counts.append(first)
        held.append(batch)
        if sum(b.nbytes for b in held) >= HELD_BYTES:
            yield from flush()
    yield from flush()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int
            ) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """Benchmark items by blocks of at most `block_bytes` of text, read one at a time."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")
    ).filter(F.col("text").isNotNull())
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.id, bytes(row.text)))
        size += len(row.text)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column `found`: n_words, spans, item_ids.

    Words are runs of bytes 0-9, a-z, A-Z (in lower case) and non-ASCII letters. A phrase
    is any `window` consecutive words of an item, or all words of a shorter one. `spans`
    are the merged, half-open word ranges that phrases cover; `item_ids` the items with
    occurring phrases, as sorted text.

    Each task indexes its documents in shards of about `shard_words` words and searches
    all phrases in each index; nothing is shuffled. The benchmark reaches the tasks in
    blocks of at most `block_bytes` of text (or one longer item); every further block is
    one more pass over rows that stay in place.

    A null or empty text has no words and no spans. An item with a null id hits but is not
    named; repeated rows count once per document and give each document row its own result.
    Without items nothing is found. A column of `docs` named `found`, in any case, is replaced by
    the result; all others stay, whatever their names.
    """
    spark = docs.sparkSession
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != "found"]
    # Own names inside the tasks: those of `docs` may repeat or clash
    out = numbered(docs).select(
        *(f"_{i}" for i in kept),
        F.col(f"_{place_of(docs, text_col)}").cast("binary").alias("_text"),
        F.lit(None).cast(FOUND_TYPE).alias("_found"),
    )
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        block = spark.sparkContext.broadcast(PhraseBlock(items, window))
        out = out.mapInArrow(lambda batches, block=block: _search(batches, block.value, shard_words), out.schema)
    return out.select(*(f"_{i}" for i in kept), "_found").toDF(*(docs.columns[i] for i in kept), "found")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: at least one word in twenty is hit. The digest is of the comma-joined item
    ids. Edge cases as in `find_contamination`; a null id is kept.
    """
    wanted = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_body"))
    found = find_contamination(wanted, benchmark, "_body", **options)
    return found.select(
        id_col, "found.n_words", words_hit().alias("n_hit"), F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.item_ids"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def words_hit() -> Column:
    """How many words the spans of column `found` cover."""
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)


def is_contaminated() -> Column:
    """At least one hit word, and at least one in twenty, by column `found`."""
    return (words_hit() > 0) & (20 * words_hit() >= F.col("found.n_words"))
