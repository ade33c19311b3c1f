"""Token-id files with Elias-Fano document boundaries.

A file set is a Parquet folder of segments in ascending document order. A segment holds the
ids of its documents one after the other, little-endian in 2 bytes (4 for vocabularies above
65536), and two Elias-Fano sequences: where each document starts, and the document ids. Such
a sequence of n numbers below u takes about ``n * (2 + log2(u / n))`` bits: the low bits as
they are, the high bits in unary, and the count of ones before each 512-bit block as 32-bit
numbers, by which ``select`` finds any entry without reading the others.

Defined results: a null text is the empty one, so its document holds the end id alone. Rows
without id come first. Rows with the same id follow each other in the order of their texts.
An empty table gives a folder without segments. Other columns are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import named, running_starts
from .encoding import encoder

# Ids of a segment, unless one document alone has more.
SEGMENT_IDS = 1 << 18
_BLOCK_BITS = 512


class EliasFano:
    """A non-decreasing sequence of numbers from 0 in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.count, self.low_bits = count, low_bits
        self.low, self.high, self.directory = low, high, directory

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return EliasFano(0, 0, b"", b"", b"")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        blocks = int(places[-1]) // _BLOCK_BITS + 1
        high = np.zeros(blocks * _BLOCK_BITS, dtype=np.uint8)
        high[places] = 1
        ones = high.reshape(blocks, -1).sum(axis=1)
        before = (np.cumsum(ones) - ones).astype("<u4")
        return EliasFano(
            n, low_bits, np.packbits(low.ravel()).tobytes(), np.packbits(high).tobytes(),
            before.tobytes(),
        )

    def select(self, wanted: np.ndarray) -> np.ndarray:
        """The entries with these numbers: a look into the directory and one block of the high
        bits for each."""
        wanted = np.asarray(wanted, dtype=np.int64)
        if len(wanted) and not 0 <= wanted.min() <= wanted.max() < self.count:
            raise IndexError(wanted)
        if not len(wanted):
            return np.zeros(0, dtype=np.uint64)
        before = np.frombuffer(self.directory, dtype="<u4").astype(np.int64)
        block = np.searchsorted(before, wanted, side="right") - 1
        blocks, at = np.unique(block, return_inverse=True)
        raw = np.frombuffer(self.high, dtype=np.uint8).reshape(len(before), -1)[blocks]
        # The ones of the chosen blocks, end to end, and where each block's begin.
        row, place = np.nonzero(np.unpackbits(raw, axis=1))
        first = np.searchsorted(row, np.arange(len(blocks)))
        one = first[at] + wanted - before[block]
        high = (block * _BLOCK_BITS + place[one] - wanted).astype(np.uint64)
        start = wanted[:, None] * self.low_bits + np.arange(self.low_bits)
        low = np.frombuffer(self.low, dtype=np.uint8)
        bits = low[start >> 3] >> (7 - (start & 7)).astype(np.uint8) & np.uint8(1)
        scale = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (high << np.uint64(self.low_bits)) + (bits * scale).sum(axis=1, dtype=np.uint64)

    def columns(self, name: str) -> dict[str, object]:
        return {
            f"{name}_count": self.count, f"{name}_low_bits": self.low_bits,
            f"{name}_low": self.low, f"{name}_high": self.high,
            f"{name}_directory": self.directory,
        }

    @staticmethod
    def from_columns(row: object, name: str) -> EliasFano:
        return EliasFano(
            *(getattr(row, f"{name}_{k}") for k in ("count", "low_bits", "low", "high", "directory"))
        )


def _sequence_schema(name: str) -> str:
    return (
        f"{name}_count int, {name}_low_bits int, {name}_low binary, {name}_high binary,"
        f" {name}_directory binary"
    )


SCHEMA = (
    "part int, segment int, start_in_part long, n_ids long, width int, ids binary,"
    f" unnamed int, first_id long, {_sequence_schema('bounds')}, {_sequence_schema('names')}"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in map(str.split, SCHEMA.split(","))])


def _segments(path: str, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = encode.dtype.itemsize
        closing = np.array([end_id], dtype=encode.dtype).tobytes()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        known: list[bool] = []
        ids: list[int] = []
        encoded: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            sizes = np.array([len(e) // width for e in encoded], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            names = np.array([i for i, k in zip(ids, known) if k], dtype=np.int64)
            first = int(names[0]) if len(names) else 0
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part, "segment": number, "start_in_part": start,
                        "n_ids": int(bounds[-1]), "width": width, "ids": b"".join(encoded),
                        "unnamed": len(ids) - len(names), "first_id": first,
                        **EliasFano.of(bounds).columns("bounds"),
                        **EliasFano.of(names.view(np.uint64) - np.uint64(first & _ALL)).columns(
                            "names"
                        ),
                    }
                ],
                _ARROW_SCHEMA,
            )

        for batch in batches:
            names_of = zip(batch["doc_id"].to_pylist(), batch["known"].to_pylist())
            for (doc_id, is_known), found in zip(names_of, encode.library_ids_of(batch["text"])):
                piece = found + closing
                ids.append(doc_id)
                known.append(is_known)
                encoded.append(piece)
                held += len(piece) // width
                if held >= SEGMENT_IDS:
                    yield segment()
                    number, start, held = number + 1, start + held, 0
                    ids, known, encoded = [], [], []
        if ids:
            yield segment()

    return cut


_ALL = (1 << 64) - 1


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id"
) -> None:
    """Encodes every document, appends ``end_id`` and writes the file set in id order."""
    ident = named(docs, key).cast("long")
    rows = docs.select(
        F.coalesce(ident, F.lit(-(1 << 63))).alias("doc_id"),
        ident.isNotNull().alias("known"),
        F.coalesce(named(docs, text), F.lit("")).alias("text"),
    )
    order = ["known", "doc_id", "text"]
    ordered = rows.repartitionByRange("known", "doc_id").sortWithinPartitions(*order)
    segments = ordered.mapInArrow(_segments(tokenizer, end_id), SCHEMA)
    # Small row groups: a reader holds one of them at a time.
    segments.write.option("parquet.block.size", 8 << 20).parquet(folder)


def _documents_of(row, chosen: np.ndarray | None) -> pd.DataFrame:
    """Documents of a segment, all or those with the chosen ids, read through ``select``."""
    bounds = EliasFano.from_columns(row, "bounds")
    names = EliasFano.from_columns(row, "names")
    ids = np.zeros(bounds.count - 1, dtype=np.int64)
    # Ids ascend, documents without one come first.
    named_ids = names.select(np.arange(names.count)) + np.uint64(row.first_id & _ALL)
    ids[row.unnamed :] = named_ids.view(np.int64)
    places = np.arange(len(ids))
    if chosen is not None:
        places = places[(places >= row.unnamed) & np.isin(ids, chosen)]
    starts, ends = bounds.select(places).astype(np.int64), bounds.select(places + 1).astype(np.int64)
    kept = np.frombuffer(row.ids, dtype=f"<u{row.width}")
    return pd.DataFrame({
        "doc_id": ids[places],
        "known": places >= row.unnamed,
        "start": row.start + starts,
        "n_tokens": ends - starts,
        "ids": [kept[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)],
    })


def read_token_files(
    spark: SparkSession, folder: str, doc_ids: list[int] | None = None
) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``,
    little-endian in 4 bytes, of each document, or of those with the given ids."""
    chosen = None if doc_ids is None else np.array(doc_ids, dtype=np.int64)
    segments = spark.read.schema(SCHEMA).parquet(folder)
    totals = segments.groupBy(F.col("part").alias("__part")).agg(F.sum("n_ids").alias("__ids"))
    starts = running_starts(totals, "__ids")
    placed = (
        segments.join(starts, segments["part"] == starts["__part"])
        .withColumn("start", F.col("__start") + F.col("start_in_part"))
        .drop("__part", "__start")
    )

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _documents_of(row, chosen)

    read = placed.mapInPandas(
        documents, "doc_id long, known boolean, start long, n_tokens long, ids binary"
    )
    return read.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
