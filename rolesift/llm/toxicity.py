"""Toxicity by non-negative positive-unlabelled learning on word and word-beginning counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.columns import crc_remainder, numbered, place_of
from rolesift.llm.words import ALNUM, word_slices
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

HASH_BITS = 20
BEGINNINGS = (3, 4, 5, 6, 7, 8)
MAX_COUNT = 3
_CACHE_WORDS = 1 << 20


@dataclass(frozen=True)
class Training:
    """Limits and settings of the fit; none of them touches the scoring, which is of all rows."""

    max_positive: int = 8_000
    max_unlabelled: int = 20_000
    features: int = 512
    min_docs: int = 5
    classifiers: int = 4
    epochs: int = 20
    batch: int = 512
    rate: float = 0.3
    penalty: float = 1e-2
    default_prior: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """A linear score over chosen feature hashes."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    index: dict[int, int] = field(default_factory=dict)


def feature_hashes(word: bytes) -> set[int]:
    """The word and its beginnings of 3 to 8 characters, hashed."""
    text = word.decode("utf-8", "replace")
    forms = {word} | {text[:k].encode() + b"*" for k in BEGINNINGS if len(text) >= k}
    return {xxhash.xxh3_64_intdigest(f) >> (64 - HASH_BITS) for f in forms}


class _Forms(dict):
    """What a word adds, kept for a bounded number of words."""

    def __init__(self, of, most: int = _CACHE_WORDS):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.of(word)
        return value


def _word_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for words in word_slices(text, ALNUM):
        counts.update(words)
    return counts


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive texts, and in how many of all texts, of the task each feature is."""
    seen = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
    forms = _Forms(lambda w: np.array(sorted(feature_hashes(w)), dtype=np.int32), _CACHE_WORDS // 4)
    for batch in batches:
        for text, positive in zip(batch.column("text"), batch.column("positive")):
            parts = [forms[w] for w in _word_counts(text.as_py())]
            if parts:
                found = np.unique(np.concatenate(parts))
                seen[0, found] += positive.as_py()
                seen[1, found] += 1
    at = np.flatnonzero(seen.any(axis=0))
    columns = [pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])]
    yield pa.RecordBatch.from_arrays(columns, names=["feature", "p", "u"])


def _chosen_counts(texts, forms: _Forms) -> Iterator[Counter]:
    """For each text the counts, up to MAX_COUNT, of the chosen features in it."""
    for text in texts:
        counts: Counter = Counter()
        for words in word_slices(text.as_py(), ALNUM):
            for places in filter(None, map(forms.__getitem__, words)):
                counts.update(places)
        yield counts


def _chosen_forms(index: dict[int, int]) -> _Forms:
    return _Forms(lambda w: tuple(index[h] for h in feature_hashes(w) if h in index) or None)


def _vectors(batches: Iterator[pa.RecordBatch], index: dict[int, int]) -> Iterator[pa.RecordBatch]:
    forms = _chosen_forms(index)
    for batch in batches:
        rows = list(_chosen_counts(batch.column("text"), forms))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("positive", "unlabelled", "negative", "fold")),
                pa.array([list(c) for c in rows], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c in rows], pa.list_(pa.int32())),
            ],
            names=["positive", "unlabelled", "negative", "fold", "at", "count"],
        )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, training: Training, seed: int
             ) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss.

    risk = prior * loss(P, +) + max(0, loss(U, -) - prior * loss(P, -)). Where the second
    term falls below 0, a step is taken that raises it, so the estimate cannot overfit to a
    negative risk. What is returned is the mean over the later half of the steps.
    """
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    scale_w, scale_b = np.full(width, 1e-8), 1e-8
    sum_w, sum_b, steps = np.zeros(width), 0.0, 0
    for epoch in range(training.epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), training.batch):
            u = unlabelled[order[at : at + training.batch]]
            p = positive[rng.integers(0, len(positive), max(1, training.batch // 4))]
            zp, zu = p @ w + b, u @ w + b
            sp, su = _sigmoid(zp), _sigmoid(zu)
            if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
                gp, gu = np.full(len(p), -prior / len(p)), su / len(u)
            else:
                gp, gu = prior * sp / len(p), -su / len(u)
            gw, gb = gp @ p + gu @ u + training.penalty * w, gp.sum() + gu.sum()
            scale_w, scale_b = scale_w + gw * gw, scale_b + gb * gb
            w, b = w - training.rate * gw / np.sqrt(scale_w), b - training.rate * gb / np.sqrt(scale_b)
            if epoch >= training.epochs // 2:
                sum_w, sum_b, steps = sum_w + w, sum_b + b, steps + 1
    return sum_w / steps, float(sum_b / steps)


def _within(prior: float) -> float:
    return min(0.95, max(0.005, prior))


def prior_bound(positives: int, unlabelled: int) -> Column:
    """What a feature in `p` positive and `u` unlabelled texts allows the class prior to be.

    Unlabelled texts hold a feature at least as often as their positives do, so the prior is at
    most the ratio of its frequencies; each is taken two deviations to the safe side.
    """
    most, least = F.col("u") + 2 * F.sqrt("u") + 1, F.col("p") - 2 * F.sqrt("p")
    return F.when(least > 0, most / unlabelled / (least / positives))


def _fit(rows: pd.DataFrame, width: int, prior: float, training: Training) -> pd.DataFrame:
    """A classifier of all folds but its own, which sets its bias; none without rows to learn from."""
    x = np.zeros((len(rows), width), dtype=np.float32)
    for k, (at, count) in enumerate(zip(rows["at"], rows["count"])):
        x[k, at] = np.minimum(count, MAX_COUNT)
    number = int(rows["classifier"].iloc[0])
    own = rows["fold"].to_numpy() == number
    kinds = {c: rows[c].to_numpy() for c in ("positive", "unlabelled", "negative")}
    positive, unlabelled = x[kinds["positive"] & ~own], x[kinds["unlabelled"] & ~own]
    if not len(positive) or not len(unlabelled):
        return pd.DataFrame({"weights": [], "bias": []})
    w, b = fit_nnpu(positive, unlabelled, prior, training, training.seed + number)
    z = x @ w
    least = _least_risk(**{c: z[k & own] for c, k in kinds.items()}, prior=prior)
    return pd.DataFrame({"weights": [w.tolist()], "bias": [b if least is None else -least]})


def _least_risk(positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray, prior: float
                ) -> float | None:
    """The margin from which on to call texts positive so that the risk of 0-1 loss is least.

    It is the middle of the widest gap between margins among the best places. Negatives stand
    for themselves; without any, unlabelled texts less the prior's share of positives do. With
    neither or without positives it is None, and the fitted bias stays.
    """
    others, gain = (negative, prior / (1 - prior)) if len(negative) else (unlabelled, 2 * prior)
    if not len(positive) or not len(others):
        return None
    z = np.concatenate([positive, others])
    cost = np.concatenate([np.full(len(positive), -gain / len(positive)), np.full(len(others), 1 / len(others))])
    z, back = np.unique(z, return_inverse=True)
    cost = np.bincount(back, cost)[::-1].cumsum()[::-1]  # of calling this margin and all above it positive
    best = np.flatnonzero(cost <= min(0.0, cost.min()) + 1e-9)
    if not len(best):  # nothing is worth calling positive
        return float(z[-1] + 1)
    below = np.where(best > 0, z[best - 1], z[best] - 1)
    at = int((z[best] - below).argmax())
    return float((z[best[at]] + below[at]) / 2)


def train(docs: DataFrame, labels: DataFrame, learnable, training: Training = Training(),
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on confirmed positives and unlabelled texts among rows where `learnable` holds.

    Features are chosen by counts over all those rows. The fit takes bounded samples
    (`Training`) of them; the classifiers differ by the order of
    steps and leave out one fold each, and their weights and biases are averaged. A bias puts 0.5
    where the risk on the fold left out is least (`_least_risk`), whatever share of texts that is:
    the class prior is a weight of the risk only. It is the share of positives among learnable
    labels, at most `prior_bound`, or that bound if no label is 0. Labels of 0 serve the prior and the risk on left
    out folds, not the weights. Repeated labels of one id count as positive if any is. Without
    positives or texts the model is the prior alone.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    known = known.filter(learnable(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = stage(known, "toxic-labels")
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p")).first()
    prior = _within(stats.p / stats.n) if stats.p and stats.p < stats.n else training.default_prior
    nothing = Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not stats.p:
        return nothing

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.filter(learnable(F.col("id")))
    few = min(1.0, training.max_positive / max(1, stats.n - stats.p))
    known = known.sampleBy(F.col("label") == 1, {True: 1.0, False: few}, training.seed)
    known = known.select("id", (F.col("label") == 1).alias("positive"), (F.col("label") != 1).alias("negative"))
    flagged = many_to_one(texts, known, ["id"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("positive", "negative")}
    )
    kinds = (F.sum(F.col(c).cast("long")).alias(c) for c in ("positive", "negative"))
    sizes = flagged.agg(*kinds, F.count(F.lit(1)).alias("unlabelled")).first()
    if not sizes.positive or not sizes.unlabelled:
        return nothing
    counts = flagged.select("text", "positive").mapInArrow(_document_counts, "feature int, p long, u long")
    p, u = F.col("p") / sizes.positive, F.col("u") / sizes.unlabelled
    both = (F.col("p") + F.col("u")) / (sizes.positive + sizes.unlabelled)
    spread = F.sqrt(both * (1 - both) * (1 / sizes.positive + 1 / sizes.unlabelled) + 1e-12)
    ranked = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    ranked = stage(ranked.filter(F.col("p") >= training.min_docs), "toxic-features")
    top = ranked.orderBy(F.desc(F.abs((p - u) / spread)), "feature").limit(training.features).select("feature").collect()
    if not top:
        return nothing
    # Labels may hold positives alone, or more of them than the texts do
    bound = ranked.agg(F.min(prior_bound(sizes.positive, sizes.unlabelled))).first()[0]
    if bound is not None:
        prior = _within(bound) if stats.p == stats.n else min(prior, _within(bound))
    hashes = np.array(sorted(r.feature for r in top))
    index = {int(h): k for k, h in enumerate(hashes)}

    def drawn(number: int, most: int, size: int) -> Column:
        return F.rand(training.seed + number) < min(1.0, most / max(1, size))

    sample = stage(
        flagged.select(
            "text",
            (F.col("positive") & drawn(1, training.max_positive, sizes.positive)).alias("positive"),
            drawn(0, training.max_unlabelled, sizes.unlabelled).alias("unlabelled"),
            (F.col("negative") & drawn(2, training.max_positive, sizes.negative)).alias("negative"),
            # Equal texts are in one fold
            F.pmod(F.xxhash64("text"), F.lit(training.classifiers)).cast("int").alias("fold"),
        ).filter(F.col("positive") | F.col("unlabelled") | F.col("negative")),
        "toxic-sample",
    ).repartition(16)
    vectors = stage(
        sample.mapInArrow(
            partial(_vectors, index=index),
            "positive boolean, unlabelled boolean, negative boolean, fold int, at array<int>, count array<int>",
        ),
        "toxic-vectors",
    )
    copies = vectors.withColumn("classifier", F.explode(F.sequence(F.lit(0), F.lit(training.classifiers - 1))))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return _fit(rows, len(hashes), prior, training)

    fitted = copies.groupBy("classifier").applyInPandas(
        fit, "weights array<double>, bias double"
    ).collect()
    if not fitted:
        return nothing
    weights = np.mean([r.weights for r in fitted], axis=0)
    return Model(hashes, weights, float(np.mean([r.bias for r in fitted])), index)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    forms = _chosen_forms(model.index)
    for batch in batches:
        place = batch.schema.get_field_index("_text")
        z = [
            model.bias + sum(model.weights[k] * min(n, MAX_COUNT) for k, n in counts.items())
            for counts in _chosen_counts(batch.column(place), forms)
        ]
        yield batch.set_column(place, "_score", pa.array(_sigmoid(np.array(z, dtype=np.float64))))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """`docs` with `score_col`, 0 to 1, higher for text that is likelier toxic.

    Whole texts are read and nothing is shuffled. A null or empty text gets the score of no
    features. A column of `docs` named `score_col`, in any case, is replaced by the result; all
    others stay, whatever their names.
    """
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != score_col.lower()]
    out = numbered(docs).select(*(f"_{i}" for i in kept), F.col(f"_{place_of(docs, text_col)}").cast("binary").alias("_text"))
    schema = out.drop("_text").schema.add("_score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most Training.features weights
    scored = out.mapInArrow(lambda batches: _score(batches, shared.value), schema)
    return scored.select(*(f"_{i}" for i in kept), "_score").toDF(*(docs.columns[i] for i in kept), score_col)


def not_held_out(key, folds: int = 5):
    """Rows to learn from: crc32 of the id as text is no multiple of `folds`; never a null id."""
    return F.coalesce(crc_remainder(key, folds) != 0, F.lit(False))


def toxicity_digest(docs: DataFrame, labels: DataFrame, training: Training = Training(),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, held_out, score, predicted (1 from a score of 0.5).

    Repeated rows get a row each; a null id is held out. Edge cases as in `train` and
    `score_texts`; other columns are not read.
    """
    model = train(docs, labels, not_held_out, training, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    scored = score_texts(rows, model, "_body", "score")
    return scored.select(
        F.col("_id").alias(id_col), (~not_held_out(F.col("_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
