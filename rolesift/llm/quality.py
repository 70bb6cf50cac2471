"""Quality rules: counts with fixed limits, and a calibrated classifier on hashed word and character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm import spans
from rolesift.llm.columns import crc_remainder, take
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

SPACES = bytes([32, *range(9, 14)])
SYMBOLS = b"#*$%&|<>"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point behind its first one
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Training:
    """Settings of the fit. `max_rows` bounds the labelled rows it reads; nothing else is bounded.

    Rows whose id's crc32 modulo `folds` is 0 are never learned from. One classifier is fitted
    per remaining fold, on the others, and calibrated on that fold.
    """

    max_rows: int = 4_000
    folds: int = 5
    bits: int = 16
    characters: tuple[int, ...] = (3, 4)
    rounds: int = 100
    rate: float = 0.1
    penalty: float = 1e-5
    scale: float = 300.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """A linear score of the log-odds that a text is good: `bias` plus the mean weight of its n-grams."""

    weights: np.ndarray
    bias: float


def _word_ids(text: bytes) -> np.ndarray:
    """A number for each word, the same for equal words."""
    ids: dict[bytes, int] = {}
    found = (ids.setdefault(m.group(), len(ids)) for m in _WORD.finditer(text))
    return np.fromiter(found, dtype=np.int64)


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """How many words lie in a window of `width` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    window = words[:n]
    for k in range(1, width):
        # Windows are numbered anew at each step, so the product stays small
        _, window = np.unique(window * np.int64(words.max() + 1) + words[k : k + n], return_inverse=True)
    again = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _word_ids(text)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text.translate(None, SPACES + _FOLLOWING)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _bucket(hashes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (spans.scramble(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def features(chunk: spans.Chunk, t: Training) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and pieces of all n-grams, by kind: words, pairs of words, and characters."""
    hashes = chunk.hashes()
    begin, end, piece = chunk.words()
    word = hashes(begin, end)
    yield _bucket(word, 1, t.bits), piece
    both = piece[1:] == piece[:-1]
    yield _bucket(word[:-1][both] * np.uint64(3) + word[1:][both], 2, t.bits), piece[1:][both]
    first = np.flatnonzero((chunk.marks & spans.POINT) != 0)
    piece = np.repeat(np.arange(len(chunk.starts)), chunk.count(spans.POINT))
    for width in t.characters:
        n = len(first) - width + 1
        if n > 0:
            inside = piece[:n] == piece[width - 1 :]
            ends = np.append(first[width:], len(chunk.data))[:n]
            yield _bucket(hashes(first[:n], ends)[inside], width, t.bits), piece[:n][inside]


def _vectors(batches: Iterator[pa.RecordBatch], t: Training) -> Iterator[pa.RecordBatch]:
    """The n-gram shares of each text as buckets and values."""
    for batch in batches:
        for row, text in enumerate(batch.column("_text").to_pylist()):
            total = np.zeros(1 << t.bits)
            n = 0
            for chunk in spans.chunks([text]):
                for bucket, _ in features(chunk, t):
                    total += np.bincount(bucket, minlength=1 << t.bits)
                    n += len(bucket)
            at = np.flatnonzero(total)
            values = (total[at] * (t.scale / max(1, n))).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold").slice(row, 1), batch.column("good").slice(row, 1),
                 pa.array([at.astype(np.int32).tobytes()]), pa.array([values.tobytes()])],
                names=["fold", "good", "at", "value"],
            )


def _chance(log_odds: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * log_odds))


def _log_odds_fit(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, by Newton steps of at most 1; the targets are kept off 0 and 1."""
    n_good, n_bad = good.sum(), len(good) - good.sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    center, spread = score.mean(), max(score.std(), 1e-9)
    x = np.stack([(score - center) / spread, np.ones(len(score))])
    at = np.array([0.0, np.log((n_good + 1) / (n_bad + 1))])
    for _ in range(100):
        p = _chance(at @ x)
        curve = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x @ (p - target) + 1e-3 * at * [1, 0])
        at -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    slope = max(at[0], 1e-6) / spread
    return slope, at[1] - slope * center


def fit(rows: pd.DataFrame, t: Training) -> pd.DataFrame:
    """One classifier: logistic regression on the rows that are not `left_out`, calibrated on those that are."""
    n_features = 1 << t.bits
    at = [np.frombuffer(a, dtype=np.int32) for a in rows["at"]]
    size = np.array([len(a) for a in at])
    row = np.repeat(np.arange(len(rows)), size)
    at = np.concatenate([*at, np.zeros(0, dtype=np.int32)])
    value = np.concatenate([np.frombuffer(v, dtype=np.float32) for v in rows["value"]] + [np.zeros(0, dtype=np.float32)])
    good, out = rows["good"].to_numpy(dtype=bool), rows["left_out"].to_numpy(dtype=bool)
    learn = ~out if len(set(good[~out])) == 2 else np.ones(len(rows), dtype=bool)
    check = out if len(set(good[out])) == 2 else np.ones(len(rows), dtype=bool)
    # Both labels weigh the same in the fit; the calibration brings their shares back
    weigh = np.where(good, 0.5 / max(1, good[learn].sum()), 0.5 / max(1, (~good)[learn].sum())) * learn
    weights, bias = np.zeros(n_features), 0.0
    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    margins = lambda: np.bincount(row, value * weights[at], minlength=len(rows)) + bias
    for step in range(1, t.rounds + 1):
        error = (_chance(margins()) - good) * weigh
        gradient = np.append(np.bincount(at, value * error[row], minlength=n_features) + t.penalty * weights, error.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = t.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    slope, offset = _log_odds_fit(margins()[check], good[check])
    out_weights = (weights * (slope * t.scale)).astype(np.float32)
    return pd.DataFrame({"weights": [out_weights.tobytes()], "bias": [slope * bias + offset]})


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, t: Training, id_col: str, text_col: str,
             label_col: str) -> DataFrame:
    """(fold, good, text) of at most about `max_rows` labelled rows, chosen by a hash of their id.

    A document is good if all its label rows are 1. The sample is taken from the labels, so the
    texts are read once and only those chosen are kept.
    """
    marks = take(labels, id=id_col, label=label_col).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    marks = stage(marks.filter(learn).groupBy("id").agg((F.min("label") == 1).alias("good")), "quality-labels")
    total = marks.count()
    if total > t.max_rows:
        share = t.max_rows / total
        marks = marks.filter(F.pmod(F.xxhash64(F.col("id"), F.lit(t.seed)), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = take(docs, id=id_col, _text=text_col).filter(F.col("_text").isNotNull())
    return many_to_one(rows, stage(marks, "quality-sample"), ["id"]).select(
        crc_remainder(F.col("id"), t.folds).alias("fold"), "good", F.col("_text").cast("binary").alias("_text")
    )


def train(docs: DataFrame, labels: DataFrame, t: Training = Training(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The mean of the calibrated classifiers; None if the learnable rows hold one label only.

    Each is fitted by one task on at most `max_rows` vectors of n-gram shares, averaged as
    log-odds; that is one linear score again.
    """
    learn = crc_remainder(F.col("id"), t.folds) != 0
    rows = labelled(docs, labels, learn, t, id_col, text_col, label_col)
    vectors = stage(rows.mapInArrow(partial(_vectors, t=t), "fold long, good boolean, at binary, value binary"), "quality-rows")
    if vectors.select("good").distinct().count() < 2:
        return None
    folds = F.array(*(F.lit(k) for k in range(1, t.folds)))
    dealt = vectors.select("*", F.explode(folds).alias("k")).withColumn("left_out", F.col("fold") == F.col("k"))
    fitted = dealt.groupBy("k").applyInPandas(
        lambda rows: fit(rows, t), "weights binary, bias double"
    ).toPandas()
    weights = np.mean([np.frombuffer(w, dtype=np.float32) for w in fitted["weights"]], axis=0)
    return Model(weights.astype(np.float32), float(fitted["bias"].mean()))


def log_odds(texts: list[bytes], weights: np.ndarray, bias: float, t: Training) -> np.ndarray:
    """The calibrated log-odds of each whole text; a text without n-grams has the bias alone."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for chunk in spans.chunks(texts):
        pieces = len(chunk.starts)
        for bucket, piece in features(chunk, t):
            np.add.at(total, chunk.piece_of, np.bincount(piece, weights[bucket], minlength=pieces))
            np.add.at(count, chunk.piece_of, np.bincount(piece, minlength=pieces))
    return bias + total / np.maximum(count, 1)


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast | None, t: Training) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        counts = np.array([base_counts(x) for x in texts], dtype=np.int64).reshape(-1, len(_COUNTS))
        if shared is None:
            score = np.ones(len(texts))
        else:
            model = shared.value
            score = _chance(log_odds(texts, model.weights, model.bias, t))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), *(pa.array(c) for c in counts.T), pa.array(score)], names=["_id", *_COUNTS, "score"]
        )


def score_texts(docs: DataFrame, model: Model | None, t: Training = Training(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per row: id, the counts of `base_counts`, and `score`, the probability that the text is good.

    Null texts are empty. Without a model every score is 1. Columns of `docs` beside the two
    named ones are not read, whatever their names.
    """
    rows = take(docs, _id=id_col, _text=text_col).withColumn("_text", F.coalesce(F.col("_text").cast("binary"), F.lit(b"")))
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"_id {rows.schema['_id'].dataType.simpleString()}", *(f"{c} long" for c in _COUNTS), "score double"])
    return rows.mapInArrow(partial(_score, shared=shared, t=t), schema).withColumnRenamed("_id", id_col)


def quality_digest(docs: DataFrame, labels: DataFrame, t: Training = Training(), keep_at: float = 0.5,
                   min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, base_failed, kept, score, held_out.

    base_failed: under `min_words` words, or over half of them in repeated windows. kept: not
    so, and a score of `keep_at` or more. Rows held out are those the fit never learns from, also
    rows with a null id. Empty and null texts fail the base rules; repeated rows get a row each;
    an empty table gives an empty result.
    """
    model = train(docs, labels, t, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return score_texts(docs, model, t, id_col, text_col).select(
        id_col, *_COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= keep_at)).alias("kept"), "score",
        F.coalesce(crc_remainder(F.col(id_col), t.folds) == 0, F.lit(True)).alias("held_out"),
    )
