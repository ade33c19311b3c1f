"""Hard negatives by a secondary sort of scored pairs.

A row's score is the inner product of its quantised vector, ``floor(256 * x)`` of each
component, with that of an anchor: an integer, so that every order and tie is exact. The
positives of an anchor are its first rows of the same label, its negatives the first rows of
other labels whose score lies within a share of the positive's.

1. Anchors are taken in chunks of at most ``CHUNK_BYTES``; a chunk is sent to all tasks, and
   every task multiplies it with the rows it reads, block by block: no pair is shuffled that
   cannot be in the result. A first pass keeps each block's best positives of each anchor,
   of which the best of all blocks are taken.
2. A second pass knows the positives' scores and keeps, of each block, the first negatives of
   every window. The pairs' keys pack (anchor, descending score, id) into bytes that sort in
   that order; rows are dealt by anchor and sorted within partitions by key (the DataFrame
   form of ``repartitionAndSortWithinPartitions``).
3. One pass over the sorted rows opens a window at each positive, gives out negatives until
   it is full or the score has left it, and holds nothing of an anchor but its open windows
   and the first negatives of the score at hand.

Defined results: rows with a null label, a null vector or a null or non-finite component take
no part. Ties go to the smaller id; a null id ranks last and is no anchor. Repeated rows are rows of their own,
also where one of them is the anchor. Vectors of different lengths are not compared. A score
beyond 64 bits counts as the nearest number of 64 bits. An empty table gives no rows. Columns
besides the three that are named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import named, stored, with_positions

SCALE = 256
# Bytes of the anchors sent to the tasks at once.
CHUNK_BYTES = 24 << 20
# Anchors multiplied with a block of rows at once.
_ANCHORS_AT_ONCE = 256
_LONGEST = (1 << 63) - 1
_SIGN = np.uint64(1 << 63)
_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def mine(
    rows: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``anchors`` is a condition on ``id``, the key of a row. A negative's score lies between
    ``low`` and ``high`` (at most 100) hundredths of its positive's.
    """
    if not 0 < low <= high <= 100:
        raise ValueError("0 < low <= high <= 100 is needed")
    taking_part = stored(_taking_part(rows, key, vector, label), "negatives-rows")
    placed = with_positions(taking_part.filter(anchors).filter("id is not null"), ["uid"], "negatives-sorted")
    placed = stored(_known_ids(placed, "position"), "negatives-anchors")
    taking_part = _known_ids(taking_part)
    extent = placed.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    per_chunk = max(1, CHUNK_BYTES // (8 * extent[1] + 64))
    pairs = [
        _pairs(taking_part, placed, start, start + per_chunk, positives, negatives, low, high)
        for start in range(0, extent[0], per_chunk)
    ]
    if not pairs:
        return rows.sparkSession.createDataFrame([], _RESULT)
    packed = F.pandas_udf(packed_keys, "binary")
    sorted_pairs = (
        reduce(DataFrame.union, pairs)
        .select(
            "anchor", "anchor_id", packed("anchor", "score", "unknown", "id").alias("key"),
            "positive",
        )
        .repartition("anchor")
        .sortWithinPartitions("key")
    )
    return sorted_pairs.drop("anchor").mapInPandas(_windows(negatives, low, high), _RESULT)


def _taking_part(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    found = rows.select(
        named(rows, key).cast("long").alias("id"),
        named(rows, label).alias("label"),
        named(rows, vector).cast("array<double>").alias("vector"),
    )
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return found.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"),
        "id",
        # Equal labels have equal numbers; only equality counts.
        F.xxhash64("label").alias("label"),
        "vector",
    )


def _known_ids(rows: DataFrame, *more: str) -> DataFrame:
    """``id`` without nulls, which ``unknown`` marks: pandas has no nulls among 64-bit ids."""
    return rows.select(
        "uid", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("unknown"),
        "label", "vector", *more,
    )


class _Block:
    """Rows of one dimension: ids in their order, null ids last, and quantised vectors."""

    def __init__(self, frame: pd.DataFrame):
        missing, ids = frame["unknown"].to_numpy(), frame["id"].to_numpy()
        order = np.lexsort((frame["uid"].to_numpy(), ids, missing))
        self.ids, self.missing = ids[order], missing[order]
        self.uids = frame["uid"].to_numpy()[order]
        self.labels = frame["label"].to_numpy()[order]
        values = np.stack([np.asarray(v, dtype=np.float64) for v in frame["vector"].iloc[order]])
        with np.errstate(over="ignore"):
            self.grid = np.floor(values * SCALE)
        self.exact: np.ndarray | None = None
        self.most = float(np.abs(self.grid).max(initial=0.0))
        if self.most >= float(1 << 52):
            self.exact = np.array(
                [[int(x) * SCALE if abs(x) >= 1 << 52 else int(np.floor(x * SCALE)) for x in row]
                 for row in values], dtype=object,
            )

    def rows(self, chosen: slice) -> tuple[np.ndarray, np.ndarray | None]:
        return self.grid[chosen], None if self.exact is None else self.exact[chosen]


def _blocks(frame: pd.DataFrame) -> Iterator[_Block]:
    """One block for each dimension, vectors of very large components apart."""
    if len(frame):
        sizes = frame["vector"].map(len)
        wide = frame["vector"].map(lambda v: bool(len(v)) and float(np.abs(v).max()) >= 1 << 15)
        for _, part in frame.groupby([sizes.rename("size"), wide.rename("wide")], sort=False):
            yield _Block(part)


def _scores(anchors: _Block, chosen: slice, block: _Block) -> np.ndarray:
    """Exact inner products, a row per anchor."""
    (a, exact_a), (b, exact_b) = anchors.rows(chosen), block.rows(slice(None))
    bound = a.shape[1] * anchors.most * block.most
    if bound < float(1 << 53):
        return (a @ b.T).astype(np.int64)
    if bound < float(1 << 62):
        return a.astype(np.int64) @ b.astype(np.int64).T
    left = exact_a if exact_a is not None else np.vectorize(int, otypes=[object])(a)
    right = exact_b if exact_b is not None else np.vectorize(int, otypes=[object])(b)
    products = left.dot(right.T)
    return np.clip(products, -_LONGEST - 1, _LONGEST).astype(np.int64)


def _first(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` highest allowed scores of each row; of equal ones the
    earlier columns."""
    least = np.iinfo(np.int64).min
    if scores.shape[1] > most:
        shown = np.where(allowed, scores, least)
        bar = np.partition(shown, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        allowed = allowed & (scores >= bar[:, None])
    at, col = np.nonzero(allowed)
    order = np.lexsort((col, ~scores[at, col], at))
    at, col = at[order], col[order]
    starts = np.searchsorted(at, at, side="left")
    chosen = np.arange(len(at)) - starts < most
    return at[chosen], col[chosen]


def _frame(anchors: _Block, block: _Block, numbers: np.ndarray, at, col, scores) -> pd.DataFrame:
    return pd.DataFrame({
        "anchor": numbers[at],
        "anchor_id": anchors.ids[at],
        "score": scores,
        "unknown": block.missing[col],
        "id": block.ids[col],
        "uid": block.uids[col],
    })


_PAIR = "anchor long, anchor_id long, score long, unknown boolean, id long, uid long"
_Pairs = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _multiplied(sent, choose) -> _Pairs:
    """Every block of rows times every anchor of the same dimension; ``choose`` says which
    pairs stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = [(_Block(part), part) for part in sent.value]
        # The position of each anchor, in the order of its block.
        placed = []
        for group, part in groups:
            positions = dict(zip(part["uid"].tolist(), part["position"].tolist()))
            placed.append((group, np.array([positions[u] for u in group.uids.tolist()])))
        for frame in batches:
            for block in _blocks(frame):
                for group, numbers in placed:
                    if group.grid.shape[1] != block.grid.shape[1]:
                        continue
                    for start in range(0, len(numbers), _ANCHORS_AT_ONCE):
                        chosen = slice(start, start + _ANCHORS_AT_ONCE)
                        scores = _scores(group, chosen, block)
                        at, col = choose(group, chosen, numbers[chosen], block, scores)
                        if len(at):
                            yield _frame(
                                group, block, numbers, at + start, col, scores[at, col]
                            )

    return run


def _pairs(
    rows: DataFrame, placed: DataFrame, start: int, stop: int,
    positives: int, negatives: int, low: int, high: int,
) -> DataFrame:
    """``anchor``, ``anchor_id``, ``score``, ``unknown``, ``id``, ``positive`` of the pairs that may be
    in the result of the anchors from ``start`` to ``stop``."""
    context = rows.sparkSession.sparkContext
    chunk = placed.filter((F.col("position") >= start) & (F.col("position") < stop)).toPandas()
    sizes = chunk["vector"].map(len).rename("size")
    wide = chunk["vector"].map(lambda v: bool(len(v)) and float(np.abs(v).max()) >= 1 << 15)
    groups = [part for _, part in chunk.groupby([sizes, wide.rename("wide")], sort=False)]
    sent = context.broadcast(groups)

    def same_label(group, chosen, numbers, block, scores):
        allowed = group.labels[chosen][:, None] == block.labels[None, :]
        allowed &= group.uids[chosen][:, None] != block.uids[None, :]
        return _first(scores, allowed, positives)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "unknown", "id", "uid")
    found = stored(
        rows.mapInPandas(_multiplied(sent, same_label), _PAIR)
        .withColumn("turn", F.row_number().over(best))
        .filter(F.col("turn") <= positives),
        "negatives-positives",
    )
    # As many scores as positives of the chunk's anchors.
    bars = np.full((stop - start, positives), np.iinfo(np.int64).min, dtype=np.int64)
    known = found.select("anchor", "turn", "score").toPandas()
    bars[known["anchor"] - start, known["turn"] - 1] = known["score"]
    bars_sent = context.broadcast(bars)

    def within_windows(group, chosen, numbers, block, scores):
        other = group.labels[chosen][:, None] != block.labels[None, :]
        kept: list[np.ndarray] = []
        width = scores.shape[1]
        for turn in range(positives):
            bar = bars_sent.value[numbers - start, turn]
            top = np.array([high * b // 100 for b in bar.tolist()], dtype=object)
            bottom = np.array([-((-low * b) // 100) for b in bar.tolist()], dtype=object)
            least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            top = np.clip(top, least, most).astype(np.int64)
            bottom = np.clip(bottom, least, most).astype(np.int64)
            inside = other & (scores <= top[:, None]) & (scores >= bottom[:, None])
            inside &= (bar > least)[:, None]
            at, col = _first(scores, inside, negatives)
            kept.append(at * width + col)
        both = np.unique(np.concatenate(kept))
        return both // width, both % width

    others = stored(rows.mapInPandas(_multiplied(sent, within_windows), _PAIR), "negatives-others")
    columns = ["anchor", "anchor_id", "score", "unknown", "id"]
    return (
        found.select(*columns, F.lit(True).alias("positive"))
        .union(others.select(*columns, F.lit(False).alias("positive")))
    )


def packed_keys(
    anchor: pd.Series, score: pd.Series, unknown: pd.Series, key: pd.Series
) -> pd.Series:
    """Bytes in the order of anchor, score from high to low, and id, null ids last."""
    fields = np.zeros(len(anchor), dtype=[("a", ">u8"), ("s", ">u8"), ("m", "u1"), ("k", ">u8")])
    fields["a"] = anchor.to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN
    fields["s"] = ~(score.to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN)
    fields["m"] = unknown.to_numpy()
    fields["k"] = key.to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN
    raw, width = fields.tobytes(), fields.dtype.itemsize
    return pd.Series([raw[i * width : (i + 1) * width] for i in range(len(fields))], dtype=object)


def unpacked_keys(keys: pd.Series) -> tuple[list[int], list[int], list[int | None]]:
    fields = np.frombuffer(
        b"".join(keys), dtype=[("a", ">u8"), ("s", ">u8"), ("m", "u1"), ("k", ">u8")]
    )
    anchors = (fields["a"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    scores = (~fields["s"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    ids = (fields["k"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    return anchors, scores, [None if m else i for m, i in zip(fields["m"].tolist(), ids)]


def _windows(negatives: int, low: int, high: int) -> _Pairs:
    """Streams sorted pairs and gives the negatives of each positive's window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor = score = None
        open_windows: list[list] = []  # positive's score, its id, negatives given
        level: list[int | None] = []  # first negatives of the score at hand
        for frame in batches:
            out: list[tuple] = []
            anchors, scores, ids = unpacked_keys(frame["key"])
            names = frame["anchor_id"].tolist()
            for a, s, i, name, positive in zip(anchors, scores, ids, names, frame["positive"]):
                if a != anchor:
                    anchor, score, open_windows, level = a, None, [], []
                if s != score:
                    score, level = s, []
                    open_windows = [
                        w for w in open_windows if w[2] < negatives and low * w[0] <= 100 * s
                    ]
                if positive:
                    window = [s, i, 0]
                    open_windows.append(window)
                    given = level  # an equal score with a smaller id came before
                else:
                    if len(level) < negatives:
                        level.append(i)
                    given = None
                for w in open_windows if given is None else [window]:
                    if not low * w[0] <= 100 * s <= high * w[0]:
                        continue
                    for negative in [i] if given is None else given:
                        if w[2] < negatives:
                            w[2] += 1
                            out.append((name, w[1], w[2], negative, w[0], s))
            columns = [c.split()[0] for c in _RESULT.split(", ")]
            # By way of Int64: a null among them would make doubles of 64-bit ids.
            yield pd.DataFrame(out, columns=columns, dtype=object).astype("Int64")

    return run
