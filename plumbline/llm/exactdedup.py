"""Exact deduplication by exchanging compressed fingerprints.

1. Every task hashes its texts, takes the first ``b`` bits of each SHA-256 as fingerprint,
   sorts the distinct ones and sends each owner (a range of fingerprints) its part as a
   Golomb-Rice code of the gaps, with one bit per fingerprint that the sender holds twice.
2. An owner decodes what it received, and answers each sender with a bitmap: which of its
   fingerprints occur anywhere else, or twice with the sender.
3. Rows with a set bit are suspects. Only their texts are shuffled, and grouped by their
   bytes: groups of more than one row are the duplicates. Suspects that merely share a
   fingerprint turn out single.

``b`` leaves about 2^8 fingerprints per row, so few suspects are false, and a code takes
some 10 bits per row where a digest takes 256. A text held by a third of all rows costs an
owner one entry per sender, and its group is pre-aggregated before the shuffle.

Defined results: null counts as the empty text. Of equal texts the row with the largest
``doc_id`` stays, a null id ranking lowest, and of repeated rows exactly one. An empty table
gives an empty one. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import named, stored, with_ids, without_dropped

# Rows of one message set, and fingerprints that one owner task holds.
BLOCK_ROWS = 1 << 16
OWNER_ROWS = 1 << 20
_SPARE_BITS = 8


def rice_encode(values: np.ndarray, low_bits: int) -> bytes:
    """Golomb-Rice code of sorted distinct numbers: gaps as unary quotient and low bits."""
    gaps = np.diff(values, prepend=np.int64(0))
    quotients = gaps >> low_bits
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(low_bits, dtype=np.int64)
    low = ((gaps[:, None] >> shifts) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, low])).tobytes()


def rice_decode(code: bytes, count: int, low_bits: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ones = np.flatnonzero(bits[: len(bits) - count * low_bits])[:count]
    if count == 0:
        return np.zeros(0, dtype=np.int64)
    quotients = np.diff(ones, prepend=-1) - 1
    start = int(ones[-1]) + 1
    low = bits[start : start + count * low_bits].reshape(count, low_bits).astype(np.int64)
    remainders = low @ (np.int64(1) << np.arange(low_bits, dtype=np.int64))
    return np.cumsum((quotients.astype(np.int64) << low_bits) + remainders)


def low_bits_for(space: int, count: int) -> int:
    """The Rice parameter for ``count`` sorted numbers below ``space``."""
    return max(0, math.floor(math.log2(max(1, space / max(1, count)) * 0.69)))


def _prefixes(digests: bytes, bits: int) -> np.ndarray:
    """The first ``bits`` bits of each 32-byte digest."""
    heads = np.frombuffer(digests, dtype=">u8").reshape(-1, 4)[:, 0]
    return (heads >> np.uint64(64 - bits)).astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values starts and ends."""
    starts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(values)]))


class Exchange:
    """How fingerprints are cut and dealt out; made from the number of rows."""

    def __init__(self, rows: int, tasks: int):
        self.bits = min(60, max(16, math.ceil(math.log2(rows + 1)) + _SPARE_BITS))
        wanted = max(tasks, rows // OWNER_ROWS + 1)
        self.owner_bits = min(self.bits - 8, max(0, math.ceil(math.log2(wanted))))
        self.inner_bits = self.bits - self.owner_bits

    def blocks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per block of rows of this task: its ids, digests and messages."""
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= BLOCK_ROWS:
                yield self._block(pd.concat(waiting))
                waiting = []
        if sum(map(len, waiting)):
            yield self._block(pd.concat(waiting))

    def _block(self, rows: pd.DataFrame) -> pd.DataFrame:
        prints, counts = np.unique(
            _prefixes(b"".join(rows["digest"]), self.bits), return_counts=True
        )
        owners, inner = prints >> self.inner_bits, prints & ((1 << self.inner_bits) - 1)
        messages = []
        for a, b in _runs(owners):
            low = low_bits_for(1 << self.inner_bits, b - a)
            messages.append(
                {
                    "owner": int(owners[a]),
                    "entries": b - a,
                    "low_bits": low,
                    "code": rice_encode(inner[a:b], low),
                    "twice": np.packbits(counts[a:b] > 1).tobytes(),
                }
            )
        return pd.DataFrame(
            {
                "block": [int(rows["uid"].iloc[0])],
                "ids": [rows["id"].to_numpy()],
                "known": [rows["known"].to_numpy()],
                "digests": [b"".join(rows["digest"])],
                "messages": [messages],
            }
        )

    def answers(self, received: pd.DataFrame) -> pd.DataFrame:
        """For each message of this owner, the bitmap of its fingerprints found elsewhere."""
        received = received.sort_values("block")
        lists = [
            rice_decode(r.code, r.entries, r.low_bits) for r in received.itertuples(index=False)
        ]
        twice = [
            np.unpackbits(np.frombuffer(r.twice, dtype=np.uint8), count=r.entries)
            for r in received.itertuples(index=False)
        ]
        _, place, counts = np.unique(
            np.concatenate(lists), return_inverse=True, return_counts=True
        )
        found = (counts[place] > 1) | (np.concatenate(twice) == 1)
        ends = np.cumsum([len(x) for x in lists])[:-1]
        return pd.DataFrame(
            {
                "block": received["block"].to_numpy(),
                "owner": received["owner"].to_numpy(),
                "bitmap": [np.packbits(x).tobytes() for x in np.split(found, ends)],
            }
        )

    def marked(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of each block, suspects marked by the bitmaps that came back."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                distinct, place = np.unique(
                    _prefixes(row.digests, self.bits), return_inverse=True
                )
                owners = distinct >> self.inner_bits
                bits = {a["owner"]: a["bitmap"] for a in row.answers}
                found = [
                    np.unpackbits(np.frombuffer(bits[int(owners[a])], np.uint8), count=b - a)
                    for a, b in _runs(owners)
                ]
                count = len(row.ids)
                yield pd.DataFrame(
                    {
                        "id": row.ids,
                        "known": row.known,
                        "digest": [row.digests[32 * i : 32 * i + 32] for i in range(count)],
                        "uid": row.block + np.arange(count),
                        "suspect": np.concatenate(found)[place] == 1,
                    }
                )


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` of the row."""
    spark = docs.sparkSession
    rows = docs.select(
        named(docs, key).cast("long").alias("id"),
        F.coalesce(named(docs, text), F.lit("")).alias("text"),
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    exchange = Exchange(rows.count(), tasks)
    hashed = rows.select(
        F.coalesce("id", F.lit(0)).alias("id"),
        F.col("id").isNotNull().alias("known"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    )
    blocks = stored(
        hashed.mapInPandas(
            lambda batches: exchange.blocks(batches),
            "block long, ids array<long>, known array<boolean>, digests binary, messages array<struct<"
            "owner long, entries int, low_bits int, code binary, twice binary>>",
        ),
        "dedup-blocks",
    )
    received = blocks.select("block", F.explode("messages").alias("m")).select("block", "m.*")
    answers = received.groupBy("owner").applyInPandas(
        lambda rows: exchange.answers(rows), "block long, owner long, bitmap binary"
    )
    per_block = answers.groupBy("block").agg(
        F.collect_list(F.struct("owner", "bitmap")).alias("answers")
    )
    marked = stored(
        blocks.select("block", "ids", "known", "digests")
        .join(per_block, "block")
        .mapInPandas(
            lambda batches: exchange.marked(batches),
            "id long, known boolean, digest binary, uid long, suspect boolean"
        )
        .select(F.when(F.col("known"), F.col("id")).alias("id"), "digest", "uid", "suspect"),
        "dedup-rows",
    )
    suspects = marked.filter("suspect")
    texts = with_ids(rows, stored(suspects.select("id").distinct(), "dedup-ids"), "id")
    verified = (
        texts.groupBy("text")
        .agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
        .filter("group_size > 1")
        .select(
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            "group_size",
            "keep_id",
        )
    )
    # Repeated rows share their id: the number of the row within the table settles which stays.
    stays = suspects.groupBy("digest").agg(
        F.max(F.struct("id", (-F.col("uid")).alias("turn"))).alias("stay")
    )
    groups = stored(
        verified.join(stays, "digest").select(
            "digest", "group_size", "keep_id", (-F.col("stay.turn")).alias("keep_uid")
        ),
        "dedup-groups",
    )
    grouped = suspects.join(groups, "digest", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias(
            "keep_id"
        ),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    single = marked.filter(~F.col("suspect")).select(
        F.col("id").alias("doc_id"),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return grouped.unionByName(single)


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text another row of larger id has.

    Rows repeated with both id and text cannot be told apart; one of them stays.
    """
    found = exact_duplicates(docs, text, key).withColumnRenamed("text_sha256", "digest")
    digest = F.sha2(F.coalesce(named(docs, text), F.lit("")).cast("binary"), 256)
    return without_dropped(docs, found, key, digest)
