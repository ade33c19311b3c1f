"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are character 1- to 3-grams of the lower-cased whole text, hashed to ``BUCKETS``
numbers: ``log(1 + count)`` times the inverse document frequency, scaled to unit length. The
document frequencies come from every training row. The weights are fitted with
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties, so most are exactly
zero) on a bounded sample of each language, in ``SHARDS`` tasks whose weights are averaged,
and one temperature is then fitted on sampled rows that training did not see.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any
labelled training row every text is. Rows with a null language are not learned from. Repeated
rows count as often as they occur, ties go to the first language in code-point order, and
other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import named, stored, uniform

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
# Sampled different training texts of one language; the fit's cost does not depend on the corpus.
FIT_ROWS = 2_000
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
# Characters that are hashed at once: texts of any length need the same memory.
_SLICE = 1 << 18

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the n-grams of a text fall into, and how often."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.zeros(buckets, dtype=np.int64)
    widest = max(ORDERS)
    for start in range(0, len(codes), _SLICE):
        own = min(_SLICE, len(codes) - start)
        part = codes[start : start + own + widest - 1].astype(np.uint64) + np.uint64(1)
        rolling = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, widest + 1):
            ends = len(part) - n + 1
            if ends <= 0:
                break
            rolling = (rolling[:ends] * _MIX[0]) ^ (part[n - 1 :] * _MIX[1])
            if n in ORDERS:
                mixed = (rolling[: min(own, ends)] + np.uint64(n)) * _MIX[0]
                counts += np.bincount(
                    (mixed >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets
                )
    found = np.flatnonzero(counts)
    return found, counts[found]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = gram_counts(text, len(idf))
    values = np.log1p(counts) * idf[found]
    length = np.sqrt(values @ values)
    return found, values / length if length else values


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for multinomial logistic regression with an elastic net."""

    def __init__(self, buckets: int, classes: int):
        self.pull = np.zeros((buckets, classes))
        self.spread = np.zeros((buckets, classes))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        pull, spread = self.pull[rows], self.spread[rows]
        active = np.abs(pull) > L1
        return np.where(
            active,
            -(pull - np.sign(pull) * L1) / ((BETA + np.sqrt(spread)) / ALPHA + L2),
            0.0,
        )

    def learn(self, rows: np.ndarray, values: np.ndarray, target: int) -> None:
        weights = self.weights(rows)
        error = softmax(values @ weights)
        error[target] -= 1.0
        gradient = values[:, None] * error
        before = self.spread[rows]
        after = before + gradient**2
        self.pull[rows] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights
        self.spread[rows] = after


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, docs: DataFrame, text: str, into: str) -> DataFrame:
        """Adds ``into``, a struct of ``lang`` and ``score``."""
        column = named(docs, text)
        readable = F.when(column.rlike(r"\p{L}"), column)
        return docs.withColumn(into, self.scored()(readable))

    def scored(self):
        spread = _Broadcasted(self)

        @F.pandas_udf("lang string, score double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = spread.value
            for texts in batches:
                rows = [model.best(t) for t in texts]
                yield pd.DataFrame(rows, columns=["lang", "score"])

        return score

    def logits(self, text: str) -> np.ndarray:
        rows, values = features(text, self.idf)
        return values @ self.weights[rows]

    def best(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages:
            return UNKNOWN, 0.0
        shares = softmax(self.logits(text) / self.temperature)
        first = int(shares.argmax())
        return self.languages[first], float(shares[first])


class _Broadcasted:
    """A model sent to each worker once: some MB, whatever the corpus holds."""

    def __init__(self, model: LanguageModel):
        self._sent = SparkSession.active().sparkContext.broadcast(model)

    @property
    def value(self) -> LanguageModel:
        return self._sent.value


def train(rows: DataFrame, text: str, lang: str) -> LanguageModel:
    """Learns from all rows of ``rows`` with text and language; only those two columns count."""
    spark = rows.sparkSession
    known = rows.select(named(rows, text).alias("text"), named(rows, lang).alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = tuple(sorted(counts, key=lambda x: x.encode()))
    total = sum(counts.values())
    idf = np.log((1 + total) / (1 + _document_frequencies(known))) + 1.0
    empty = np.zeros((BUCKETS, len(languages)))
    if not languages:
        return LanguageModel((), idf, empty, 1.0)
    sample = stored(_sampled(known, _distinct_texts(known)), "langid-sample")
    index = {language: i for i, language in enumerate(languages)}
    sent = spark.sparkContext.broadcast((idf, index))

    def fit(_: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        idf, index = sent.value
        shard = shard.sort_values(["turn", "text"])
        examples = [(*features(t, idf), index[k]) for t, k in zip(shard["text"], shard["lang"])]
        model = Ftrl(BUCKETS, len(index))
        for _ in range(EPOCHS):
            for found, values, target in examples:
                model.learn(found, values, target)
        weights = model.weights(np.arange(BUCKETS))
        rows, classes = np.nonzero(weights)
        return pd.DataFrame({"bucket": rows, "lang": classes, "weight": weights[rows, classes]})

    fitted = (
        sample.filter("part = 'fit'")
        .groupBy("shard")
        .applyInPandas(fit, "bucket long, lang long, weight double")
        .groupBy("bucket", "lang")
        .agg((F.sum("weight") / F.lit(float(SHARDS))).alias("weight"))
    )
    weights = empty
    for bucket, language, weight in fitted.collect():
        weights[bucket, language] = weight
    held = spark.sparkContext.broadcast(LanguageModel(languages, idf, weights, 1.0))

    @F.pandas_udf("array<double>")
    def logits(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.logits(t) for t in texts])

    rows = sample.filter("part = 'calibrate'").select(logits("text").alias("logits"), "lang")
    return LanguageModel(languages, idf, weights, _temperature(rows.collect(), index))


def _document_frequencies(known: DataFrame) -> np.ndarray:
    """In how many rows each bucket occurs: counted per task, then summed per bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                seen[gram_counts(text)[0]] += 1
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": found, "rows": seen[found]})

    frequencies = np.zeros(BUCKETS)
    per_task = known.select("text").mapInPandas(count, "bucket long, rows long")
    for bucket, rows in per_task.groupBy("bucket").agg(F.sum("rows")).collect():
        frequencies[bucket] = rows
    return frequencies


def _distinct_texts(known: DataFrame) -> dict[str, int]:
    """How many different texts each language has."""
    texts = known.select("lang", F.xxhash64("text").alias("print")).distinct()
    return {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}


def _sampled(known: DataFrame, texts: dict[str, int]) -> DataFrame:
    """At most ``FIT_ROWS`` texts of a language, by a hash of the text: ``fit`` or ``calibrate``.

    ``texts`` has the number of different texts of each language. A text that occurs often is
    drawn as one text, so copies cannot fill the sample, nor thin it.
    """
    draw = uniform(F.lit("langid"), F.col("text"))
    share = F.create_map(
        *[x for k, n in texts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * FIT_ROWS / n)))]
    )
    picked = (
        known.withColumn("turn", draw)
        .filter(F.col("turn") < share[F.col("lang")])
        .dropDuplicates(["lang", "text"])
    )
    first = Window.partitionBy("lang").orderBy("turn", "text")
    return (
        picked.withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") <= FIT_ROWS)
        .withColumn("shard", F.pmod(F.col("__rank"), F.lit(SHARDS)))
        .withColumn(
            "part", F.when(F.pmod(F.col("__rank"), F.lit(5)) == 0, "calibrate").otherwise("fit")
        )
        .drop("__rank")
    )


def _temperature(rows: list, index: dict[str, int]) -> float:
    """The divisor of the scores under which held-back rows are likeliest."""
    if not rows:
        return 1.0
    scores = np.array([r["logits"] for r in rows])
    target = np.array([index[r["lang"]] for r in rows])

    def loss(temperature: float) -> float:
        shares = softmax(scores / temperature)[np.arange(len(target)), target]
        return float(-np.log(np.maximum(shares, 1e-12)).mean())

    return float(min(np.geomspace(0.02, 20, 121), key=loss))


def identify(docs: DataFrame, training: Column, text: str, lang: str, into: str) -> DataFrame:
    """Learns from the rows where ``training`` holds and adds ``into`` to every row."""
    return train(docs.filter(training), text, lang).predict(docs, text, into)
