"""Spelling variants: words at one edit from each other, found in sorted lists, and their usual forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.columns import take
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

_SLICE_BYTES = 8 << 20
_HELD_WORDS = 1 << 18

# U+00C0 to U+00FF are the byte C3 and one of 80 to BF
_RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
_OUTSIDE = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def letter_runs(text: bytes) -> Iterator[list[bytes]]:
    """The runs of Latin letters of each slice of `text`, A-Z in lower case; no run is cut."""
    at = 0
    while at < len(text):
        cut = _OUTSIDE.search(text, at + _SLICE_BYTES)
        end = cut.start() if cut else len(text)
        yield _RUN.findall(text[at:end].lower())
        at = end


def _length(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def varied(word: bytes, prefix: int, every: int) -> bytes:
    """The word, or for one hash in `every` the word without one code point.

    `prefix` is the crc32 of what comes before the word in the hashed text.
    """
    h = zlib.crc32(word, prefix)
    if h % every:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count_words(batches: Iterator[pa.RecordBatch], every: int, shortest: int) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array([w.decode() for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
            prefix = zlib.crc32(f"{key}:".encode())
            for runs in letter_runs(text):
                for run, n in Counter(runs).items():
                    if _length(run) >= shortest and _length(word := varied(run, prefix, every)) >= shortest:
                        total[word] += n
            if len(total) > _HELD_WORDS:
                yield out()
                total.clear()
    yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31,
               shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of all whole texts: words of `shortest` code points or more, `least` times or more.

    Null and empty texts hold no words; a null id is hashed as the empty text.
    """
    rows = take(docs, _id=id_col, _text=text_col).filter(F.col("_text").isNotNull()).select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"), F.col("_text").cast("binary")
    )
    counts = rows.mapInArrow(partial(_count_words, every=every, shortest=shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _with_windows(words: DataFrame, windows: Column) -> DataFrame:
    """`words` once per window (size, first, last), with the key of its block.

    A block holds words of `size` and of `size + 1` that agree before place `first` and behind
    place `last`, counted in the shorter word.
    """
    at = words.withColumn("_w", F.explode(windows)).select("word", "n", "_w.*")
    behind = F.greatest(F.col("size") - F.col("last"), F.lit(0))
    key = F.xxhash64(
        "size", "first", "last", F.substring("word", F.lit(1), F.col("first")),
        F.substring("word", F.length("word") - behind + 1, behind),
    )
    return at.withColumn("key", key)


def _window(size: Column, first: Column, last: Column) -> Column:
    return F.struct(size.alias("size"), first.alias("first"), last.alias("last"))


def _halves(size: Column, first: Column, last: Column) -> list[Column]:
    middle = F.floor((first + last) / 2).cast("int")
    return [_window(size, first, middle), _window(size, middle, last)]


def blocks(words: DataFrame, most: int, shortest: int = 1) -> DataFrame:
    """`words` (word, n) in blocks such that any two near words share exactly one that finds them.

    Two near words agree before the first place where they differ, and behind it. So that
    place falls into one half of the shorter word, and the other half is the same in both:
    the halves are the first blocks. A block of over `most` words is split by the halves of
    its own window, until the window is one place: then its words differ in two letters at
    most. Each round is a written table of the blocks still too large.
    """
    length = F.length("word")
    zero = F.lit(0)
    sizes = [length, length - 1]
    windows = [w for size in sizes for w in _halves(size, zero, size + 1)]
    level = _with_windows(words, F.array(*windows)).filter(F.col("size") >= shortest)
    done = []
    while True:
        level = stage(level, "spelling-blocks")
        wide = level.filter(F.col("last") - F.col("first") > 1)
        large = stage(wide.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("key"), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, level])
        done.append(many_to_one(level, large, ["key"], "left_anti"))
        split = many_to_one(level, large, ["key"], "left_semi").select("word", "n", "size", "first", "last")
        level = _with_windows(split.select(F.struct("word", "n", "size", "first", "last").alias("_r")).select(
            "_r.word", "_r.n", F.array(*_halves(F.col("_r.size"), F.col("_r.first"), F.col("_r.last"))).alias("_halves"),
        ), F.col("_halves"))


def _common(a: str, b: str) -> int:
    """How many letters both begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def near_pairs(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """All (i, j, common) with i < j of sorted distinct words at one edit; `common` first letters agree.

    Each word is compared with the words behind it by an edit matrix of which only the three
    cells next to the diagonal are kept. Its rows belong to the letters of the other word,
    so the next word in the list keeps the rows of the letters that it shares with the one
    before. Where all three cells exceed one, every word with these first letters does, and
    that whole range is passed over.
    """
    shared = [0, *(_common(a, b) for a, b in zip(words, words[1:]))]
    n = len(words)
    for i, word in enumerate(words):
        size = len(word)
        padded = word + "\0\0"
        # rows[d]: from the first d letters to the first d - 1, d and d + 1 of `word`
        rows = [(2, 0, 1), *([(1, 0, 1)] * size)]
        common, j = size, i + 1
        while j < n:
            at = shared[j]
            common = min(common, at)
            del rows[at + 1 :]
            other = words[j]
            dead = 0
            for d in range(len(rows) - 1, len(other)):
                if d > size:
                    dead = d + 1
                    break
                c = other[d]
                left, middle, right = rows[d]
                x = min(middle + 1, left + (padded[d - 1] != c))
                y = min(right + 1, middle + (padded[d] != c), x + 1)
                z = min(right + (padded[d + 1] != c) if d < size else 2, y + 1)
                if x > 1 and y > 1 and z > 1:
                    dead = d + 1
                    break
                rows.append((x, y, z))
            j += 1
            if dead:
                while j < n and shared[j] >= dead:
                    j += 1
            elif abs(len(other) - size) <= 1 and rows[len(other)][size - len(other) + 1] == 1:
                yield i, j - 1, common


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block after the other; holds one block and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "size", "first")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and tuple(ids[:, 0]) != last:
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            if held:
                yield pa.concat_batches([*held, batch.slice(a, b - a)])
                held = []
            elif b - a > 1:
                yield batch.slice(a, b - a)
        held.append(batch.slice(cuts[-2]))
        last = tuple(ids[:, -1])
    if held:
        yield pa.concat_batches(held)


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many near words each word has in each block, and the one of largest n, the least of equals."""
    out: list[tuple[str, int, int, str]] = []

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"]
        )

    for block in _block_ends(batches):
        if block.num_rows < 2:
            continue
        words, counts = block.column("word").to_pylist(), block.column("n").to_pylist()
        size, first, last = (block.column(c)[0].as_py() for c in ("size", "first", "last"))
        found: dict[int, list[int]] = {}
        for i, j, common in near_pairs(words):
            if first <= common < last and min(len(words[i]), len(words[j])) == size:
                for a, b in ((i, j), (j, i)):
                    mine = found.setdefault(a, [0, b])
                    mine[0] += 1
                    if (-counts[b], words[b]) < (-counts[mine[1]], words[mine[1]]):
                        mine[1] = b
        out.extend((words[a], k, counts[b], words[b]) for a, (k, b) in found.items())
        if len(out) >= 10_000:
            yield flush()
            out = []
    yield flush()


def near_words(words: DataFrame, most: int = 1024, shortest: int = 1) -> DataFrame:
    """Per word of `words` (word, n; distinct): word, n, n_near, best_n, best.

    `n_near` counts the words at exactly one inserted, deleted or replaced code point; `best`
    is that of largest n, the least in code-point order of equals, with its `best_n`; null
    without near words. Pairs are not written out: each block sums its own.
    """
    sorted_blocks = blocks(words, most, shortest).repartition("key").sortWithinPartitions("key", "size", "first", "word")
    found = sorted_blocks.select("key", "size", "first", "last", "word", "n").mapInArrow(
        _near_in_blocks, "word string, n_near long, best_n long, best string"
    )
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"),
                        F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = none.unionByName(found, allowMissingColumns=True)
    rank = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return both.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(rank).alias("_best")
    ).select("word", "n", "n_near", (-F.col("_best.k")).alias("best_n"), F.col("_best.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without circles: each round doubles the steps taken."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(many_to_one(roots, onward, ["root"], "left"), "roots-moved")
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return roots
        roots = moved.select("word", F.coalesce("_next", "root").alias("root"))


def variant_groups(words: DataFrame, times: int = 10, most: int = 1024, shortest: int = 1) -> DataFrame:
    """Per word of `words` (word, n; distinct): word, form, root, n, n_near, form_n.

    A word's form is its best near word if that has `times` its n or more; n grows along
    forms, so they end. An empty table gives an empty result.
    """
    near = stage(near_words(words, most, shortest), "spelling-near")
    has_form = F.col("best_n") >= times * F.col("n")
    named = near.select("word", "n", "n_near", F.when(has_form, F.col("best")).alias("form"),
                        F.when(has_form, F.col("best_n")).alias("form_n"))
    roots = _roots(named.filter(F.col("form").isNotNull()))
    return many_to_one(named, roots, ["word"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7) -> DataFrame:
    """The variant groups of all words of whole texts; see `vocabulary` and `variant_groups`.

    Repeated rows count each. Texts without words, and empty tables, add nothing.
    """
    words = stage(vocabulary(docs, id_col, text_col, shortest=shortest), "spelling-words")
    return variant_groups(words, shortest=shortest)
