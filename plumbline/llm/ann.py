"""Nearest neighbours by inner product along shifted Hilbert curves.

Vectors get one more coordinate, ``sqrt(M^2 - |v|^2)`` with the greatest norm ``M``, so the
largest inner product becomes the smallest distance. Each of ``CURVES`` orderings projects
them on ``DIMENSIONS`` random directions, shifts them at random, and sorts them by their
Hilbert curve index: range-partitioned in Spark, which yields each vector's position.

A query is compared with all vectors within ``window`` positions of its own, in every
ordering. Queries that lie next to each other share one merged window, cut into blocks of
vectors; a block of queries meets each block of vectors of its window as one matrix product,
keeps its best, and the best of all orderings are ranked again on the original vectors.

The window is not a constant: for ``PROBES`` sampled queries the exact neighbours are found
by brute force, and the window is what brings ``RECALL`` of them within reach. The more a
data set is spread evenly over many dimensions, the wider it gets.

Equal vectors are one vector with a list of the ``k + 1`` smallest ids, which is all that can
ever be ranked; so a vector that a third of all rows share costs as much as any other.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows without id. Vectors of different lengths are not compared: the commonest
length takes part, of equally common ones the greatest. Ties go to the smaller id, repeated
ids count once per vector, and an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import named, stored, with_positions
from .hilbert import hilbert_keys

CURVES = 16
DIMENSIONS = 6
BITS = 8
PROBES = 64
RECALL = 0.97
# Vectors and queries of one block.
BLOCK = 8_192
QUERY_BLOCK = 512
_SEED = 20


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, summed from the first component on."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


@dataclass(frozen=True)
class Curves:
    """The random projections, shifts and scales of all orderings."""

    directions: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    shifts: np.ndarray
    norm: float

    @staticmethod
    def over(sample: np.ndarray, norm: float, curves: int = CURVES) -> Curves:
        rng = np.random.default_rng(_SEED)
        width = sample.shape[1] + 1
        dims = min(DIMENSIONS, width)
        directions = np.stack(
            [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        )
        shifts = rng.uniform(0.0, 0.25, size=(curves, dims))
        empty = np.zeros((curves, dims))
        raw = Curves(directions, empty, empty + 1, shifts, norm)
        projected = raw._projected(sample)
        return Curves(
            directions, projected.mean(axis=1), projected.std(axis=1) + 1e-12, shifts, norm
        )

    def _projected(self, vectors: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0.0, self.norm**2 - (vectors**2).sum(axis=1)))
        return np.einsum("nd,cde->cne", np.column_stack([vectors, lift]), self.directions)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One row of curve indexes per vector."""
        scaled = (self._projected(vectors) - self.centre[:, None]) / self.spread[:, None]
        # A logistic squeeze makes cells of about equal shares of the data.
        even = 1.0 / (1.0 + np.exp(-1.702 * np.clip(scaled, -20, 20)))
        cells = ((even * 0.75 + self.shifts[:, None]) * (1 << BITS)).astype(np.int64)
        return np.stack([hilbert_keys(c, BITS) for c in cells], axis=1)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _top(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` best of each row, ties to the smaller id."""
    if scores.shape[1] > count:
        edge = -np.partition(-scores, count - 1, axis=1)[:, count - 1 : count]
        rows = [np.flatnonzero(s >= e) for s, e in zip(scores, edge)]
    else:
        rows = [np.arange(scores.shape[1])] * len(scores)
    best = []
    for at, s in zip(rows, scores):
        order = np.lexsort((ids[at], -s[at]))[:count]
        best.append((ids[at][order], s[at][order]))
    return [b[0] for b in best], [b[1] for b in best]


class Index:
    """All distinct vectors of a table, in their orders along the curves."""

    def __init__(self, rows: DataFrame, key: str, vector: str, k: int):
        self.k = k
        found = rows.select(
            named(rows, key).cast("long").alias("id"), named(rows, vector).alias("vector")
        ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
        lengths = found.groupBy(F.size("vector").alias("n")).count().collect()
        self.width = max(((r["count"], r["n"]) for r in lengths), default=(0, 0))[1]
        found = found.filter(F.size("vector") == self.width).withColumn("print", F.xxhash64("vector"))
        self.rows = stored(found, "ann-rows")
        # The k + 1 smallest ids of each vector: the limit by rank is cut in the map tasks.
        turn = Window.partitionBy("print", "vector").orderBy("id")
        distinct = self.rows.select("print", "vector", "id").distinct()
        first = distinct.withColumn("turn", F.row_number().over(turn)).filter(
            F.col("turn") <= k + 1
        )
        grouped = first.groupBy("print", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        self.vectors = stored(
            grouped.withColumn("vec", F.col("ids")[0]).select("vec", "print", "vector", "ids"),
            "ann-vectors",
        )
        self.count = self.vectors.count()

    def search(self, wanted: Column) -> DataFrame:
        """The ``k`` nearest of each row whose ``id`` fulfils ``wanted``."""
        queries = self.rows.filter(wanted)
        asked = stored(
            self.vectors.join(
                queries.select("print", "vector").distinct(), ["print", "vector"], "left_semi"
            ).select("vec"),
            "ann-asked",
        )
        if not self.count:
            return self._ranked(asked.select(F.col("vec").alias("query"), "vec"), queries)
        order = self._positions(asked)
        window = self._window(order, asked)
        return self._ranked(self._near(order, window), queries)

    def _positions(self, asked: DataFrame) -> DataFrame:
        """``curve``, ``vec``, ``vector``, ``asked`` and the ``position`` along each curve."""
        sample = self.vectors.orderBy(F.xxhash64("vec"), "vec").limit(2_000).select("vector")
        norm = self.vectors.select(F.max(F.sqrt(inner_product(F.col("vector"), F.col("vector")))))
        curves = Curves.over(
            np.array([r["vector"] for r in sample.collect()], dtype=np.float64),
            norm.first()[0],
        )
        sent = self.vectors.sparkSession.sparkContext.broadcast(curves)

        @F.pandas_udf("array<long>")
        def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                yield pd.Series(list(sent.value.keys(_matrix(vectors))))

        marked = self.vectors.join(asked.withColumn("asked", F.lit(True)), "vec", "left")
        placed = marked.select(
            "vec", F.coalesce("asked", F.lit(False)).alias("asked"),
            F.posexplode(keys("vector")).alias("curve", "key"),
        )
        ordered = with_positions(placed, ["curve", "key", "vec"], "ann-orders")
        # Positions count on over the curves, each of which holds every vector.
        return ordered.select(
            "curve", "vec", "asked", F.pmod("position", F.lit(self.count)).alias("position")
        )

    def _window(self, order: DataFrame, asked: DataFrame) -> int:
        """Positions to either side within which sampled queries find their neighbours."""
        probes = asked.orderBy(F.xxhash64(F.lit("probe"), "vec"), "vec").limit(PROBES)
        chosen = self.vectors.join(probes, "vec", "left_semi").orderBy("vec").collect()
        if not chosen:
            return 1
        k = self.k
        sent = self.vectors.sparkSession.sparkContext.broadcast(
            (
                np.array([r["vec"] for r in chosen]),
                np.array([r["vector"] for r in chosen], dtype=np.float64),
            )
        )

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors = sent.value
            for batch in batches:
                other = batch["vec"].to_numpy()
                scores = vectors @ _matrix(batch["vector"]).T
                best, values = _top(scores, other, k + 1)
                yield pd.DataFrame(
                    {
                        "query": np.repeat(ids, [len(b) for b in best]),
                        "vec": np.concatenate(best),
                        "score": np.concatenate(values),
                    }
                )

        near = self.vectors.select("vec", "vector").mapInPandas(
            exact, "query long, vec long, score double"
        )
        turn = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
        true = stored(
            near.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= k + 1),
            "ann-probes",
        )
        of_query = order.select("curve", F.col("vec").alias("query"), F.col("position").alias("p"))
        of_found = order.select("curve", "vec", F.col("position").alias("q"))
        gaps = (
            true.join(of_query, "query")
            .join(of_found, ["curve", "vec"])
            .groupBy("query", "vec")
            .agg(F.min(F.abs(F.col("p") - F.col("q"))).alias("gap"))
        )
        return max(1, int(gaps.agg(F.percentile("gap", F.lit(RECALL))).first()[0]) + 1)

    def _near(self, order: DataFrame, window: int) -> DataFrame:
        """``query``, ``vec``: the best of each query's windows."""
        k = self.k
        blocks = order.join(self.vectors.select("vec", "vector"), "vec")
        candidates = blocks.groupBy("curve", F.floor(F.col("position") / BLOCK).alias("block")).agg(
            F.collect_list(F.struct("position", "vec", "vector")).alias("members")
        )
        turn = Window.partitionBy("curve", "stretch").orderBy("position")
        # Queries are numbered in stretches of positions, so no curve is one task's work.
        asked = (
            blocks.filter("asked")
            .withColumn("stretch", F.floor(F.col("position") / (BLOCK * 4)))
            .withColumn("part", F.floor((F.row_number().over(turn) - 1) / QUERY_BLOCK))
            .groupBy("curve", "stretch", "part")
            .agg(
                F.collect_list(F.struct("position", "vec", "vector")).alias("queries"),
                F.min("position").alias("from"),
                F.max("position").alias("to"),
            )
        )
        reach = asked.withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.greatest(F.lit(0), F.col("from") - window) / BLOCK),
                    F.floor(F.least(F.lit(self.count - 1), F.col("to") + window) / BLOCK),
                )
            ),
        )
        met = (
            reach.join(candidates, ["curve", "block"])
            .repartition("curve", "stretch", "part")
            .sortWithinPartitions("curve", "stretch", "part", "block")
        )

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows of one query block follow each other: its best so far are all that is kept."""
            current, asked_ids, ids, scores = None, None, None, None

            def best() -> pd.DataFrame:
                return pd.DataFrame(
                    {
                        "query": np.repeat(asked_ids, [len(x) for x in ids]),
                        "vec": np.concatenate(ids),
                        "score": np.concatenate(scores),
                    }
                )

            for batch in batches:
                for row in batch.itertuples(index=False):
                    this = (row.curve, row.stretch, row.part)
                    if this != current:
                        if current is not None:
                            yield best()
                        current = this
                        asked_ids = np.array([q["vec"] for q in row.queries])
                        at = np.array([q["position"] for q in row.queries])
                        matrix = np.array([q["vector"] for q in row.queries], dtype=np.float64)
                        ids = [np.zeros(0, dtype=np.int64)] * len(asked_ids)
                        scores = [np.zeros(0)] * len(asked_ids)
                    others = np.array([m["vec"] for m in row.members])
                    places = np.array([m["position"] for m in row.members])
                    vectors = np.array([m["vector"] for m in row.members], dtype=np.float64)
                    products = matrix @ vectors.T
                    products[np.abs(at[:, None] - places) > window] = -np.inf
                    found, values = _top(products, others, k + 1)
                    for i, (f, v) in enumerate(zip(found, values)):
                        near = np.isfinite(v)
                        both = np.concatenate([ids[i], f[near]])
                        of = np.concatenate([scores[i], v[near]])
                        order = np.lexsort((both, -of))[: k + 1]
                        ids[i], scores[i] = both[order], of[order]
            if current is not None:
                yield best()

        return (
            met.mapInPandas(compare, "query long, vec long, score double")
            .groupBy("query", "vec")
            .agg(F.max("score").alias("score"))
            .withColumn(
                "turn",
                F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec")),
            )
            .filter(F.col("turn") <= k + 1)
            .select("query", "vec")
        )

    def _ranked(self, near: DataFrame, queries: DataFrame) -> DataFrame:
        """Scores on the original vectors, all ids of each vector, and the rows that asked."""
        near = stored(near, "ann-near")
        of_query = self.vectors.select(
            F.col("vec").alias("query"), F.col("print").alias("query_print"),
            F.col("vector").alias("query_vector"),
        )
        scored = (
            near.join(self.vectors.select("vec", "vector", "ids"), "vec")
            .join(of_query, "query")
            .withColumn("score", inner_product(F.col("query_vector"), F.col("vector")))
            .select("query", "query_print", "score", F.explode("ids").alias("vec_id"))
        )
        turn = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = (
            scored.withColumn("turn", F.row_number().over(turn))
            .filter(F.col("turn") <= self.k + 1)
            .groupBy("query", "query_print")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("best"))
        )
        asking = queries.select(F.col("id").alias("query_id"), F.col("print").alias("query_print"))
        others = F.slice(
            F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, self.k
        )
        return (
            asking.distinct()
            .join(best, "query_print")
            .select("query_id", F.posexplode(others).alias("rank", "b"))
            .select(
                "query_id", (F.col("rank") + 1).alias("rank"),
                F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"),
            )
        )
