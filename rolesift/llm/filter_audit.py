"""How quality filters work together: what each removes in each order, and its share over all orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm import spans
from rolesift.llm.columns import take
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

_MOST_FILTERS = 6
_COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each whole text."""
    totals = {name: np.zeros(len(texts), dtype=np.int64) for name in _COUNTS}
    seen: dict[int, set[bytes]] = {}  # words of the texts that take more than one piece
    for chunk in spans.chunks(texts):
        begin, end, piece = chunk.words()
        new = np.flatnonzero(spans.first_of_each(chunk, begin, end, piece) == np.arange(len(begin)))
        counts = {
            "n_words": chunk.count(spans.WORD_START),
            "n_distinct": np.bincount(piece[new], minlength=len(chunk.starts)),
            "n_capitals": chunk.count(spans.CAPITAL),
            "n_points": chunk.count(spans.POINT) - 1,  # the space behind the piece
            "n_symbols": chunk.count(spans.SYMBOL),
        }
        for name, count in counts.items():
            np.add.at(totals[name], chunk.piece_of, count)
        sizes = np.diff(np.append(chunk.starts, len(chunk.data)))
        for p in np.flatnonzero(sizes - 1 < [len(texts[d]) for d in chunk.piece_of]).tolist():
            raw = chunk.data.tobytes()
            words = seen.setdefault(int(chunk.piece_of[p]), set())
            words.update(raw[begin[w] : end[w]] for w in new[piece[new] == p].tolist())
    for d, words in seen.items():
        totals["n_distinct"][d] = len(words)
    return totals


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        counts = measure(texts)
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *(pa.array(counts[n]) for n in _COUNTS), digests],
            names=[*kept, *_COUNTS, "digest"],
        )


def text_counts(docs: DataFrame, text_col: str, keep: Mapping[str, str]) -> DataFrame:
    """Per row the `keep` columns (new name: column), the counts of `measure`, and `digest`.

    `digest` is the text's SHA-256. Null texts are empty: all counts are 0.
    """
    rows = take(docs, **keep, _text=text_col).withColumn("_text", F.coalesce(F.col("_text").cast("binary"), F.lit(b"")))
    kinds = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep]
    schema = ", ".join([*kinds, *(f"{n} long" for n in _COUNTS), "digest binary"])
    return rows.mapInArrow(_measure_batches, schema)


def later_copies(rows: DataFrame, id_col: str = "id", digest_col: str = "digest") -> DataFrame:
    """`rows` with boolean `is_copy`: whether an equal text has a smaller id; false for null ids.

    Only digests are grouped, and only those of several rows are joined.
    """
    groups = rows.groupBy(digest_col).agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    several = stage(groups.filter(F.col("_n") > 1).drop("_n"), "copies")
    joined = many_to_one(rows, several, [digest_col], "left")
    return joined.withColumn("is_copy", F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))).drop("_first")


def audit(rows: DataFrame, filters: Mapping[str, Column], part_col: str, losses: Sequence[str]) -> DataFrame:
    """What each filter does in each order of all filters, per part.

    `filters` maps a one-letter name, of at most six, to the condition under which a row
    fails; a null condition is not a failure. Boolean columns `losses` are counted among the
    removed rows under their own names. Rows are summed per part and set of failed filters;
    everything else is computed from those sums, 64 a part at most. Returns, per part, order
    and step: part, filter_order, step, kept, removed, redundant, unique_fails, `losses`,
    shapley (the filter's removed rows summed over all orders). An empty table gives no rows.
    """
    letters = "".join(filters)
    if len(letters) != len(filters) or len(letters) > _MOST_FILTERS:
        raise ValueError(f"filters need one-letter names, at most {_MOST_FILTERS}")
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    failed = reduce(add, [F.when(condition, bit[letter]).otherwise(0) for letter, condition in filters.items()])
    sums = rows.select(F.col(part_col).alias("part"), failed.alias("_failed"), *losses).groupBy("part", "_failed").agg(
        F.count(F.lit(1)).alias("_n"), *(F.count(F.when(F.col(c), 1)).alias(c) for c in losses)
    )
    steps = [
        f"named_struct('o', '{''.join(order)}', 's', {k + 1}, 'b', {bit[letter]}, 'e', {sum(bit[x] for x in order[:k])})"
        for order in permutations(letters)
        for k, letter in enumerate(order)
    ]
    at = sums.withColumn("_at", F.explode(F.expr(f"array({', '.join(steps)})")))
    mask, own, earlier, n = F.col("_failed"), F.col("_at.b"), F.col("_at.e"), F.col("_n")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(earlier) != 0
    removed = fails & ~gone
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(F.lit(0).cast("long")))
    orders = factorial(len(letters))
    return at.groupBy("part", F.col("_at.o").alias("filter_order"), F.col("_at.s").alias("step")).agg(
        total(~fails & ~gone, n).alias("kept"), total(removed, n).alias("removed"),
        total(fails & gone, n).alias("redundant"), total(mask == own, n).alias("unique_fails"),
        *(total(removed, F.col(c)).alias(c) for c in losses),
        # Of the filters that a row fails each comes first in an equal share of the orders
        total(fails, n * F.floor(orders / F.bit_count(mask)).cast("long")).alias("shapley"),
    )


def audit_digest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The audit of five filters on whole texts, per language.

    A: under 200 words. B: under half of the words distinct. C: over 3 of 100 code points
    are A-Z. D: any of `#$%&*|`. E: the text of a smaller id, kept or not. Losses are good_lost
    (a label row with quality 1) and toxic_lost (one with toxic 1); a document's label rows
    are taken together. Null texts are empty, a null language is the empty one, and rows with a
    null id are no copies and have no labels. Repeated rows count each.
    """
    rows = stage(text_counts(docs, text_col, {"id": id_col, "part": lang_col}), "audit-counts")
    marks = take(labels, id="doc_id", quality="quality", toxic="toxic").filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good_lost"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic_lost"),
    )
    known = many_to_one(later_copies(rows), stage(marks, "audit-labels"), ["id"], "left")
    filters = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("is_copy"),
    }
    named = known.withColumn("part", F.coalesce(F.col("part"), F.lit("")))
    return audit(named, filters, "part", ["good_lost", "toxic_lost"])
