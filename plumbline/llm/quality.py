"""Quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text are all the classifier sees. It minimises
the non-negative unbiased risk

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

with the logistic loss, for a logistic model on statistics of the whole text (shares of
letters, capitals, digits, symbols and separators, word lengths, repeated words). All
unlabelled texts count: their features are stored once, centre, scale, risk, gradient and
curvature are sums over every row, made by the tasks. Of the positives, labelled rows, a
sample of at most ``FIT_ROWS`` is used. With the logistic loss the risk is convex; Newton's
steps go down it and are shortened where the second part, the risk of negatives, would fall
below zero: beyond that point the unlabelled would be learned by heart.

The prior, the share of good text in the unlabelled, is estimated from positives and
unlabelled alone: a first classifier tells them apart, and its mean odds for the unlabelled
are set against those for the positives. Label 0 is not used.

Defined results: a text that is null or holds no word scores 0. Without positives nothing is
known: texts with words score 0.5. Labels that are null are ignored; a document with several
labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, named, stored, uniform, with_ids

# Labelled positives that the fit uses at most.
FIT_ROWS = 10_000
STEPS = 12
DECAY = 2e-2
THRESHOLD = 0.7

FEATURES = (
    "letters", "capitals", "digits", "symbols", "commas", "stops", "bangs", "pipes",
    "other_marks", "word_length", "repeats", "marked_words", "short_words", "capital_words",
    "bare_marks",
)

_SENTENCE = np.zeros(128, dtype=bool)
_SENTENCE[[ord(c) for c in ".,;:!?'\"-()"]] = True


def text_features(text: str) -> list[float]:
    """The statistics named in ``FEATURES``, each over the whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(text), len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ascii_counts = np.bincount(codes[codes < 128], minlength=128)
    wide = int((codes >= 128).sum())
    upper = int(ascii_counts[65:91].sum())
    letters = upper + int(ascii_counts[97:123].sum()) + wide
    digits = int(ascii_counts[48:58].sum())
    spaces = int(ascii_counts[[9, 10, 11, 12, 13, 32]].sum())
    sentence = int(ascii_counts[_SENTENCE].sum())
    symbols = n - letters - digits - spaces - sentence
    at = lambda c: int(ascii_counts[ord(c)])
    repeats = sum(map(eq, words, words[1:]))
    plain = sum(map(str.isalpha, words))
    return [
        letters / n,
        upper / max(1, letters),
        digits / n,
        symbols / n,
        at(",") / count,
        at(".") / count,
        at("!") / count,
        at("|") / count,
        sum(at(c) for c in "#$%&*+=<>@^_~{}[]\\/") / count,
        (n - spaces) / count / 10,
        repeats / count,
        1 - plain / count,
        sum(len(w) < 3 for w in words) / count,
        sum(map(str.isupper, words)) / count,
        sum(not any(map(str.isalnum, w)) for w in set(words)) / count,
    ]


def _expanded(rows: np.ndarray) -> np.ndarray:
    return np.hstack([rows, np.ones((len(rows), 1))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        scaled = np.clip((rows - self.centre) / self.scale, -8, 8)
        return sigmoid(_expanded(scaled) @ self.weights)

    def predict(self, docs: DataFrame, text: str, into: str) -> DataFrame:
        """Adds the column ``into``: 0 to 1, higher where label 1 is likelier."""
        sent = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                rows = np.array([text_features(t or "") for t in texts]).reshape(-1, len(FEATURES))
                worded = np.array([bool(t) and not t.isspace() for t in texts], dtype=float)
                yield pd.Series(sent.value.scores(rows) * worded)
                give_back()

        return docs.withColumn(into, score(named(docs, text)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    prior: float | None = None,
) -> QualityModel:
    """Learns from ``labels`` and the texts of ``docs``; both hold training rows only.

    Label 1 gives the positives; ``docs`` as a whole are the unlabelled text.
    """
    trusted = labels.select(named(labels, key).alias("id"), named(labels, label).alias("label"))
    trusted = trusted.filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    good = trusted.filter(F.col("label") == 1).select("id")
    texts = docs.select(named(docs, key).alias("id"), named(docs, text).alias("text"))
    draw = uniform(F.lit("quality"), F.col("id")) < F.lit(min(1.0, FIT_ROWS / max(1, good.count())))
    chosen = stored(good.filter(draw), "quality-ids")
    positives = _collected(_measured(with_ids(texts, chosen, "id")))
    rows = stored(_measured(texts).select("features"), "quality-features")
    width = len(FEATURES)
    (count,), sums, squares = _summed(rows, _moments, 1, width, width)
    if not len(positives) or not count:
        return QualityModel(np.zeros(width), np.ones(width), None, prior or 0.5)
    centre = sums / count
    scale = np.sqrt(np.maximum(squares / count - centre**2, 0.0)) + 1e-6
    scaled = _expanded(np.clip((positives - centre) / scale, -8, 8))

    def unlabelled(weights: np.ndarray) -> Means:
        def pieces(x: np.ndarray) -> list[np.ndarray]:
            return _risk_sums(_expanded(np.clip((x - centre) / scale, -8, 8)), weights)

        parts = _summed(rows, pieces, *_sizes(width + 1))
        return _means(count, parts)

    if prior is None:
        prior = estimated_prior(scaled, unlabelled)
    prior = min(max(prior, 0.01), 0.99)
    return QualityModel(centre, scale, minimise(scaled, unlabelled, prior), prior)


@dataclass(frozen=True)
class Means:
    """Over unlabelled rows, with each one taken as 0: loss, its gradient and curvature, and
    the mean score."""

    loss: float
    gradient: np.ndarray
    curvature: np.ndarray
    score: float


def _sizes(width: int) -> tuple[int, int, int, int]:
    return 1, width, width * width, 1


def _risk_sums(x: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    z = x @ weights
    s = sigmoid(z)
    curved = (x * (s * (1 - s))[:, None]).T @ x
    return [np.array([np.logaddexp(0.0, z).sum()]), s @ x, curved.ravel(), np.array([s.sum()])]


def _means(count: float, parts: list[np.ndarray]) -> Means:
    loss, gradient, curved, score = (part / count for part in parts)
    width = len(gradient)
    return Means(float(loss[0]), gradient, curved.reshape(width, width), float(score[0]))


def means_of(rows: np.ndarray) -> Callable[[np.ndarray], Means]:
    """The same figures for rows that are at hand."""
    return lambda weights: _means(len(rows), _risk_sums(rows, weights))


def _moments(x: np.ndarray) -> list[np.ndarray]:
    return [np.array([float(len(x))]), x.sum(axis=0), (x**2).sum(axis=0)]


def _summed(
    rows: DataFrame, pieces: Callable[[np.ndarray], list[np.ndarray]], *sizes: int
) -> list[np.ndarray]:
    """Sums over all rows of what ``pieces`` makes of a batch: one array per task, added up
    element by element."""
    width = sum(sizes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(values):
                total += np.concatenate(pieces(values.reshape(-1, len(FEATURES))))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(partial, "sums array<double>")
    added = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum"))
    flat = np.zeros(width)
    for row in added.collect():  # one row per element
        flat[row["pos"]] = row["sum"]
    return np.split(flat, np.cumsum(sizes)[:-1])


def _measured(texts: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def measure(batch: pd.Series) -> pd.Series:
        give_back()
        return pd.Series([text_features(t) for t in batch])

    worded = texts.filter(F.col("text").rlike(r"\S"))
    return worded.select("id", measure("text").alias("features"))


def _collected(measured: DataFrame) -> np.ndarray:
    """The features of a bounded sample, in an order that does not depend on the tasks."""
    rows = sorted((r["features"] for r in measured.select("features").collect()))
    return np.array(rows).reshape(-1, len(FEATURES))


def _descend(
    start: np.ndarray,
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray, bool]],
) -> np.ndarray:
    """Newton's method; ``evaluate`` gives value, gradient, curvature and whether weights are
    allowed. A step that is not, or that leads up, is halved."""
    weights = start
    value, gradient, curvature, _ = evaluate(weights)
    for _ in range(STEPS):
        step = np.linalg.solve(curvature, gradient)
        if gradient @ step < 1e-9:
            return weights
        for _ in range(6):
            tried = evaluate(weights - step)
            if tried[3] and tried[0] <= value + 1e-12:
                break
            step = step / 2
        else:
            return weights
        weights = weights - step
        value, gradient, curvature, _ = tried
    return weights


def minimise(
    positives: np.ndarray, unlabelled: Callable[[np.ndarray], Means], prior: float
) -> np.ndarray:
    """The weights of least non-negative risk."""
    width = positives.shape[1]
    centre = positives.mean(axis=0)

    def evaluate(weights: np.ndarray):
        means = unlabelled(weights)
        z = positives @ weights
        # The loss as 1 less the loss as 0 is -z: what is left of the positives is linear.
        value = means.loss - prior * z.mean() + DECAY / 2 * weights @ weights
        gradient = means.gradient - prior * centre + DECAY * weights
        negative = means.loss - prior * np.logaddexp(0.0, z).mean()
        return value, gradient, means.curvature + DECAY * np.eye(width), negative >= 0

    return _descend(np.zeros(width), evaluate)


def estimated_prior(positives: np.ndarray, unlabelled: Callable[[np.ndarray], Means]) -> float:
    """Mean odds of being labelled among the unlabelled, against those of the positives."""
    width, ridge = positives.shape[1], 1e-3
    known = means_of(-positives)  # the loss as 1 is the loss as 0 of the opposite

    def evaluate(weights: np.ndarray):
        one, zero = known(weights), unlabelled(weights)
        value = one.loss + zero.loss + ridge / 2 * weights @ weights
        gradient = one.gradient + zero.gradient + ridge * weights
        return value, gradient, one.curvature + zero.curvature + ridge * np.eye(width), True

    weights = _descend(np.zeros(width), evaluate)
    return unlabelled(weights).score / float(sigmoid(positives @ weights).mean())
