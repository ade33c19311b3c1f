"""Packing documents into sequences by non-negative least squares.

Each document becomes its ids and an end id. Its full windows are sequences of their own;
what is left over, shorter than the window, is packed with others:

1. The left-over lengths of all documents are counted.
2. Combinations of two or three lengths that fill a window exactly are enumerated, and
   non-negative least squares finds how often to use each so that the lengths used match
   the histogram. The counts are rounded down, then raised where lengths are still over.
3. Every task realises its share of that plan from its own documents.
4. What the plan leaves is laid end to end, longest first, and cut at the window's edge; the
   open end is carried on to the task's next batch. Only a task's last sequence is short, and
   padded unless its length is a power of two.

Defined results: null texts are the empty text, one end id. Every id is in exactly one piece.
Documents without id keep a null id. An empty table gives no piece. Repeated rows are packed
as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import give_back, named, stored
from .encoding import encoder

WINDOW = 2_048
# Most frequent lengths of which triples are made; pairs are made of all lengths.
TRIPLE_LENGTHS = 48
SWEEPS = 60
# Rows that a worker turns into Python objects at once, of a batch of documents or pieces.
SLICE_ROWS = 1_000


def combinations(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Pairs, and triples of frequent lengths, that fill the window exactly."""
    found = {(a, window - a) for a in histogram if a <= window - a and window - a in histogram}
    frequent = sorted(histogram, key=lambda n: (-histogram[n], n))[:TRIPLE_LENGTHS]
    for i, a in enumerate(frequent):
        for b in frequent[i:]:
            c = window - a - b
            if c > 0 and c in histogram:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def repeat_counts(
    histogram: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = SWEEPS
) -> np.ndarray:
    """How often to use each combination: least squares over the lengths, none below zero.

    Coordinate descent: one combination after the other takes the value that is best with the
    others held, or zero.
    """
    left = {n: float(c) for n, c in histogram.items()}
    uses = [[(n, combo.count(n)) for n in sorted(set(combo))] for combo in combos]
    counts = np.zeros(len(combos))
    for _ in range(sweeps):
        moved = 0.0
        for j, parts in enumerate(uses):
            step = sum(k * left[n] for n, k in parts) / sum(k * k for _, k in parts)
            step = max(step, -counts[j])
            if step:
                counts[j] += step
                for n, k in parts:
                    left[n] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    whole = np.floor(counts + 1e-9).astype(np.int64)
    over = dict(histogram)
    for count, parts in zip(whole, uses):
        for n, k in parts:
            over[n] -= k * int(count)
    for j in sorted(range(len(uses)), key=lambda j: -counts[j]):
        spare = min(over[n] // k for n, k in uses[j])
        # Below zero where the solution overshot a length: fewer of this combination.
        spare = max(spare, -int(whole[j]))
        whole[j] += spare
        for n, k in uses[j]:
            over[n] -= k * spare
    return whole


class _Packer:
    """Packs the documents of one task, batch after batch."""

    def __init__(self, task: int, combos: list[tuple[int, ...]], shares: np.ndarray, window: int):
        self.base, self.used = task << 33, 0
        self.combos, self.shares, self.window = combos, shares, window
        self.open, self.filled = -1, 0

    def _sequence(self) -> int:
        self.used += 1
        return self.base + self.used - 1

    def pack(self, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of every piece of documents of the
        given numbers of ids."""
        window, pieces = self.window, []
        rest: dict[int, list[int]] = defaultdict(list)
        for doc, size in enumerate(sizes):
            for start in range(0, size - window + 1, window):
                pieces.append((doc, start, window, self._sequence(), 0))
            if size % window:
                rest[size % window].append(doc)
        for combo, share in zip(self.combos, self.shares):
            wanted = int(np.ceil(share * len(sizes)))
            for _ in range(min(wanted, *(len(rest[n]) // combo.count(n) for n in combo))):
                sequence, offset = self._sequence(), 0
                for n in combo:
                    doc = rest[n].pop()
                    pieces.append((doc, sizes[doc] - n, n, sequence, offset))
                    offset += n
        for n in sorted(rest, reverse=True):
            for doc in rest[n]:
                start, size = sizes[doc] - n, sizes[doc]
                while start < size:
                    if self.open < 0 or self.filled == window:
                        self.open, self.filled = self._sequence(), 0
                    length = min(size - start, window - self.filled)
                    pieces.append((doc, start, length, self.open, self.filled))
                    self.filled += length
                    start += length
        return pieces


def _encoded(tokenizer: str, end_id: int):
    """Ids of the texts of batches of ``doc_id``, ``known`` and ``text``, a slice at a time: a
    worker never holds the pieces of a whole batch as objects beside all of their ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        closing = np.array([end_id], dtype=ids.dtype).tobytes()
        for batch in batches:
            found = ids.library_ids_of(batch.column("text"))
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                encoded = [x + closing for x in islice(found, rows.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], pa.array(encoded, pa.binary())], ["doc_id", "known", "ids"]
                )
                del rows, encoded
            del batch, found
            give_back()

    return encode


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian, 4 bytes
    each), ``doc_tokens``, ``sequence_id`` and ``offset``."""

    width = encoder(tokenizer).dtype.itemsize
    ident = named(docs, key).cast("long")
    rows = docs.select(
        F.coalesce(ident, F.lit(0)).alias("doc_id"),
        ident.isNotNull().alias("known"),
        named(docs, text).alias("text"),
    )
    tokens = stored(
        rows.mapInArrow(_encoded(tokenizer, end_id), "doc_id long, known boolean, ids binary").withColumn(
            "size", (F.length("ids") / width).cast("long")
        ),
        "packing-tokens",
    )
    left = F.pmod("size", F.lit(window)).cast("int")
    counted = tokens.groupBy(left.alias("n")).count().collect()
    histogram = {r["n"]: r["count"] for r in counted if r["n"]}
    total = sum(r["count"] for r in counted)
    combos = combinations(histogram, window)
    counts = repeat_counts(histogram, combos)
    order = sorted((j for j in range(len(combos)) if counts[j]), key=lambda j: -counts[j])
    plan = [combos[j] for j in order], counts[order] / max(1, total)
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(TaskContext.get().partitionId(), *sent.value, window)
        for batch in batches:
            ids = [np.frombuffer(b, dtype=f"<u{width}") for b in batch["ids"]]
            found = packer.pack([len(x) for x in ids])
            found = np.array(found, dtype=np.int64).reshape(-1, 5)
            for at in range(0, len(found), SLICE_ROWS):
                doc, start, length, sequence, offset = found[at : at + SLICE_ROWS].T
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].to_numpy()[doc],
                        "known": batch["known"].to_numpy()[doc],
                        "start": start,
                        "length": length,
                        "ids": [
                            ids[d][s : s + n].astype("<u4").tobytes()
                            for d, s, n in zip(doc, start, length)
                        ],
                        "doc_tokens": batch["size"].to_numpy()[doc],
                        "sequence_id": sequence,
                        "offset": offset,
                    }
                )
            give_back()

    packed = tokens.mapInPandas(
        pieces,
        "doc_id long, known boolean, start long, length long, ids binary, doc_tokens long,"
        " sequence_id long, offset long",
    )
    return packed.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
