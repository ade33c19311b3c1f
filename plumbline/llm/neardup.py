"""Near-duplicate classes by BagMinHash banding and exact multiset overlap.

Two documents are linked where the multisets of their shingles of five words have a weighted
Jaccard similarity of at least ``THRESHOLD``; a class is everything that links connect.

1. Documents with the same words collapse to one node, pre-aggregated before the shuffle.
2. Nodes that agree in one of ``BANDS`` bands of their signature meet in a bucket. Every
   bucket has a hub, its node of most neighbours, and every other node is compared with the
   hub alone: a bucket of n nodes makes n - 1 pairs, not n squared.
3. Where a bucket is then still of several classes, its nodes meet again by their shingles,
   rare ones first: two multisets that overlap enough share one of the rarest fifth of each
   (prefix filter), so nothing is lost, and what makes unlike texts meet in a bucket, a
   passage that many hold, comes last in the order. Two nodes of different classes that share
   such a shingle are compared, unless their sizes or the places of the shingle in the order
   rule out enough overlap. The order is by counts in a table of fixed size: whatever falls
   together there, all nodes have the same order, which is all that the filter needs.
4. Pairs are verified on the whole shingle multisets; components are found by passing on the
   smallest label and jumping along it.

A pair at exactly 0.8 misses all bands with a probability of 5e-5, one of 0.85 with 1e-6.

Defined results: a document without words (null, empty or white space) is its own class.
Texts of fewer than five words have one shingle. The class carries the smallest ``doc_id``
of its members and keeps that document, of repeated rows one. A null id ranks last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import bagminhash as bag
from .common import give_back, named, stored, with_ids, without_dropped

THRESHOLD = 0.8
BANDS, ROWS = 25, 5
# Counters of the table that tells rare shingles from frequent ones: 8 MB.
_COUNTERS = 1 << 20
# Shingles whose signatures are made at once.
_BATCH = 100_000


def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        content: list[bytes | None] = []
        lengths: list[int] = []
        bands: list[np.ndarray | None] = []
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def sign() -> None:
            if not waiting:
                return
            sizes = [len(e) for _, e, _ in waiting]
            first = bag.signatures(
                np.concatenate([e for _, e, _ in waiting]),
                np.concatenate([c for _, _, c in waiting]),
                np.repeat(np.arange(len(waiting)), sizes),
                len(waiting),
                BANDS * ROWS,
            )
            for (row, _, _), keys in zip(waiting, bag.band_keys(first, BANDS)):
                bands[row] = keys
            waiting.clear()

        pending = 0
        for row, text in enumerate(texts):
            words = bag.words_of(text)
            content.append(bag.content_key(words) if words else None)
            lengths.append(0)
            bands.append(None)
            if words:
                elements, counts = bag.counted(bag.shingles(words))
                lengths[row] = int(counts.sum())
                waiting.append((row, elements, counts))
                pending += len(elements)
            if pending >= _BATCH:
                sign()
                pending = 0
        sign()
        yield pd.DataFrame({"content": content, "length": lengths, "bands": bands})
        give_back()


def _shingled(texts: pd.Series) -> pd.Series:
    give_back()
    return pd.Series([bag.tagged(bag.shingles(bag.words_of(t))).view(np.int64) for t in texts])


class _Rows:
    """The stored signatures of a table, and the texts they were made from."""

    def __init__(self, docs: DataFrame, text: str, key: str):
        self.texts = docs.select(
            named(docs, key).cast("long").alias("doc_id"), named(docs, text).alias("text")
        ).withColumn("print", F.xxhash64("text"))
        sign = F.pandas_udf(_signed, "content binary, length int, bands array<long>")
        self.signed = stored(
            self.texts.withColumn("uid", F.monotonically_increasing_id())
            .withColumn("signed", sign("text"))
            .select("uid", "doc_id", "print", "signed.*"),
            "near-signed",
        )
        best = F.min_by(F.struct("print", "length", "bands"), "uid")
        self.nodes = stored(
            self.signed.filter("content is not null")
            .groupBy("content")
            .agg(F.min("uid").alias("node"), best.alias("best"))
            .select("content", "node", "best.*"),
            "near-nodes",
        )


def _spokes(nodes: DataFrame) -> DataFrame:
    """Every node of every bucket with more than one, next to the bucket's hub."""
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stored(placed.join(sizes, "bucket"), "near-buckets")
    central = shared.groupBy("node").agg(F.sum("members").alias("central"))
    hubs = (
        shared.join(central, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("central", (-F.col("node")).alias("turn"))).alias("top"))
        .select("bucket", (-F.col("top.turn")).alias("hub"))
    )
    return stored(shared.drop("members").join(hubs, "bucket"), "near-spokes")


def _compared(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """``pairs`` of nodes ``a`` and ``b``, and what else they hold, with their similarity."""
    left = shingled.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = shingled.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    either = F.size("left") + F.size("right") - common
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(*pairs.columns, (common / either).alias("similarity"))
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, of undirected edges
    ``a``, ``b``."""
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(),
        "near-edges",
    )
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("label")
        ),
        "near-labels",
    )
    while True:
        met = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("met"))
        )
        nearer = labels.join(met, labels["node"] == met["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "met").alias("via")
        )
        target = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stored(
            nearer.join(target, "via", "left").select(
                "node", "old", F.least("via", F.coalesce("far", "via")).alias("label")
            ),
            "near-labels",
        )
        labels = step.select("node", "label")
        if step.filter("label != old").isEmpty():
            return labels


def _still_apart(spokes: DataFrame, labels: DataFrame) -> DataFrame:
    """``node`` and ``label`` of what lies in a bucket with nodes of another label."""
    known = spokes.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.filter("low != high").select("bucket")
    return known.join(mixed, "bucket", "left_semi").select("node", "label").distinct()


def _rarest_first(counts: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The shingles of which two linked nodes share one, with their places in the order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                shingles = np.asarray(row.shingles, dtype=np.int64)
                order = np.lexsort((shingles, counts[shingles & (_COUNTERS - 1)]))
                size = len(shingles)
                chosen = shingles[order[: size - math.ceil(THRESHOLD * size - 1e-9) + 1]]
                out.append(
                    pd.DataFrame({
                        "shingle": chosen, "place": np.arange(len(chosen), dtype=np.int32),
                        "node": row.node, "label": row.label, "size": np.int32(size),
                    })
                )
            if out:
                yield pd.concat(out)

    return run


def _late_links(apart: DataFrame, shingled: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the classes that meet in a bucket."""
    apart = stored(apart, "near-apart")
    rows = shingled.join(apart, "node")
    counter = F.col("shingle").bitwiseAND(F.lit(_COUNTERS - 1)).cast("int").alias("counter")
    table = rows.select(F.explode("shingles").alias("shingle")).groupBy(counter).count()
    found = table.toArrow()  # at most one row per counter
    counts = np.zeros(_COUNTERS, dtype=np.int64)
    counts[found["counter"].to_numpy()] = found["count"].to_numpy()
    first = stored(
        rows.mapInPandas(
            _rarest_first(counts), "shingle long, place int, node long, label long, size int"
        ),
        "near-rarest",
    )
    mixed = first.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.filter("low != high").select("shingle")
    first = stored(first.join(mixed, "shingle", "left_semi"), "near-shared")
    x, y = first.alias("x"), first.alias("y")
    # Of two linked nodes, this many shingles are shared; none before the first shared one is.
    enough = (
        f"{THRESHOLD / (1 + THRESHOLD)} * (x.size + y.size) - 1e-6"
        " <= least(x.size - x.place, y.size - y.place)"
    )
    pairs = x.join(
        y,
        F.expr(
            "x.shingle = y.shingle and x.label < y.label"
            f" and least(x.size, y.size) >= {THRESHOLD - 1e-9} * greatest(x.size, y.size)"
            f" and {enough}"
        ),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = stored(pairs.distinct(), "near-pairs")
    found = _compared(pairs, shingled).filter(F.col("similarity") >= THRESHOLD)
    return stored(found.select("a", "b"), "near-late")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id``, ``class_size``, ``kept`` and
    ``digest``, a hash of its text."""
    rows = _Rows(docs, text, key)
    spokes = _spokes(rows.nodes)
    met = stored(
        rows.nodes.select("node", "print").join(spokes.select("node").distinct(), "node"),
        "near-met",
    )
    found = with_ids(rows.texts, stored(met.select("print").distinct(), "near-prints"), "print")
    shingle = F.pandas_udf(_shingled, "array<long>")
    shingled = stored(
        found.select("print", "text")
        .dropDuplicates(["print"])
        .select("print", shingle("text").alias("shingles"))
        .join(met, "print")
        .select("node", "shingles"),
        "near-shingles",
    )
    pairs = spokes.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    compared = stored(_compared(pairs.distinct(), shingled), "near-compared")
    links = compared.filter(F.col("similarity") >= THRESHOLD)
    labels = components(links)
    late = _late_links(_still_apart(spokes, labels), shingled)
    if not late.isEmpty():
        labels = components(links.select("a", "b").union(late))
    return _classes(rows, labels)


def _classes(rows: _Rows, labels: DataFrame) -> DataFrame:
    members = stored(
        rows.signed.select("uid", "doc_id", "print", "content")
        .join(rows.nodes.select("content", "node"), "content", "left")
        .join(labels, "node", "left")
        .select("uid", "doc_id", "print", F.coalesce("label", "node", "uid").alias("label")),
        "near-members",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))
    classes = (
        members.groupBy("label")
        .agg(F.count("*").alias("class_size"), first.alias("first"))
        .filter("class_size > 1")
    )
    return members.join(classes, "label", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id"))
        .otherwise(F.col("first.doc_id"))
        .alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("uid") == F.col("first.uid"), F.lit(True)).alias("kept"),
        F.col("print").alias("digest"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id."""
    found = near_duplicates(docs, text, key)
    return without_dropped(docs, found, key, F.xxhash64(named(docs, text)))
