"""The trie of the prefixes that sequences share, from vertical bitmaps.

A sequence is the turns of one conversation in order; a node of depth d is a distinct run of
first d turns, from the root without turns. Every conversation that starts with a node's
turns is one of its members.

1. Sequences are cut into shards: neighbouring ids of at most ``SHARD_TURNS`` turns in all.
   A longer sequence is cut at every ``SLICE``-th position as well; each slice begins at the
   known keys of the prefixes before it, so that no task holds a whole long conversation.
2. Within a shard, (position, turn) is indexed to a bitset of the sequences that have this
   turn there. From the root down, depth first, a node's children are the intersections of
   its bitset with the postings of the next position: the lowest sequence that is left names
   a turn, its posting gives the child, and the child's members are taken off. The number of
   set bits counts the members, those that end there are the list of ends.
3. A node has the same 128-bit key in every shard (an exclusive or over its positions and
   turns), so shards are put together by sums over keys, combined before the shuffle. Ends
   come in runs of ascending ids, which one pass over the sorted runs turns into a digest.
4. Sums over subtrees need no walk: a node belongs to its smallest member. What the nodes of
   sequence c are worth together is W(c). The subtree of node v holds all nodes of its
   members, but for those that its own smallest member has above v. So the sum over the
   subtree is the sum of W over the members, less a running sum along one sequence.

Defined results: a null key belongs to no conversation, such rows are left out. Turns with
equal numbers are in the order of their digests; a null turn number comes first. Null role
or text is an empty one. Equal rows are turns of their own. An empty table has no nodes.
Columns besides the four that are named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bagminhash import mixed
from .common import named, running_starts, stored, with_positions

SHARD_TURNS = 8192
SLICE = 1024
# Nodes over which one task makes a running sum.
_RUNNING = 1 << 18
# Ids in one run of a list of ends.
_RUN = 1024

_LOCAL = (
    "high long, low long, parent_high long, parent_low long, depth long, conv_id long, "
    "n_convs long, n_bytes long, members array<long>, ends array<long>"
)


def turns_in_order(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, ``position`` from 1, ``digest`` (128 bits of role and text) and
    ``n_bytes`` of the text: all that the trie needs, without the texts themselves."""
    who = F.coalesce(named(turns, role).cast("string"), F.lit(""))
    said = F.coalesce(named(turns, text).cast("string"), F.lit(""))
    rows = turns.select(
        named(turns, conversation).cast("long").alias("conv_id"),
        named(turns, turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said))).alias(
            "digest"
        ),
        F.octet_length(said).cast("long").alias("n_bytes"),
    ).filter("conv_id is not null")
    # Spark's ascending order puts nulls first.
    placed = with_positions(rows, ["conv_id", "turn", "digest"], "trie-turns")
    starts = placed.groupBy("conv_id").agg(F.min("position").alias("first"))
    return placed.join(starts, "conv_id").select(
        "conv_id", (F.col("position") - F.col("first") + 1).alias("position"), "digest", "n_bytes"
    )


def with_shared_starts(turns: DataFrame, start_of: Column, length: Column) -> DataFrame:
    """Conversations rebuilt: the first ``length`` turns of conversation ``start_of`` (all if
    fewer, none if it is absent), then the own turns after the first ``length``.

    ``turns`` are ``turns_in_order``; both columns are expressions over ``conv_id``. The
    result has one more row for each conversation, at position 0: that of the root.
    """
    turns = stored(turns, "trie-ordered")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    convs = stored(
        sizes.withColumn("start_of", start_of).withColumn("length", length), "trie-conversations"
    )
    starts = convs.select(F.col("conv_id").alias("start_of"), F.col("turns").alias("there"))
    convs = convs.join(starts, "start_of", "left").withColumn(
        "taken", F.least("length", F.coalesce("there", F.lit(0)))
    )
    borrowed = turns.withColumnRenamed("conv_id", "start_of").join(
        convs.select("conv_id", "start_of", "taken"), "start_of"
    )
    borrowed = borrowed.filter(F.col("position") <= F.col("taken"))
    own = turns.join(convs.select("conv_id", "length", "taken"), "conv_id")
    own = own.filter(F.col("position") > F.col("length")).withColumn(
        "position", F.col("position") - F.col("length") + F.col("taken")
    )
    columns = ["conv_id", "position", "digest", "n_bytes"]
    roots = convs.select(
        "conv_id",
        F.lit(0).cast("long").alias("position"),
        F.lit(b"").alias("digest"),
        F.lit(0).cast("long").alias("n_bytes"),
    )
    return borrowed.select(*columns).union(own.select(*columns)).union(roots)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``sequences``: ``conv_id``, ``position``, ``digest``, ``n_bytes``; position 0 of every
    conversation is its root, the others are numbered without gaps.
    """
    local = stored(_shard_nodes(sequences), "trie-local")
    nodes = stored(
        local.groupBy("high", "low", "parent_high", "parent_low", "depth").agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.max("n_bytes").alias("n_bytes"),
        ),
        "trie-nodes",
    )
    children = nodes.groupBy("parent_high", "parent_low").agg(F.count("*").alias("n_children"))
    children = children.filter("parent_high is not null").toDF("high", "low", "n_children")
    known = nodes.join(children, ["high", "low"], "left").fillna(0, ["n_children"])
    known = known.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("n_bytes")
    )
    worth, known = _along_owners(known)
    members = (
        local.select("high", "low", F.explode("members").alias("owner"))
        .join(worth, "owner")
        .groupBy("high", "low")
        .agg(F.sum("all_leaves").alias("in_leaves"), F.sum("all_saved").alias("in_saved"))
    )
    parents = nodes.select(
        F.col("high").alias("parent_high"),
        F.col("low").alias("parent_low"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return (
        known.join(members, ["high", "low"])
        .join(parents, ["parent_high", "parent_low"], "left")
        .join(_end_digests(local), ["high", "low"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("in_leaves") - F.col("above_leaves")).alias("n_leaves"),
            (F.col("in_saved") - F.col("above_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def _shard_nodes(sequences: DataFrame) -> DataFrame:
    """The nodes of every shard and slice, with their members there."""
    sequences = sequences.withColumnRenamed("position", "depth")
    placed = with_positions(sequences, ["conv_id", "depth"], "trie-sequences")
    placed = stored(
        placed.withColumn("hashes", _turn_hashes("depth", "digest")).select(
            "conv_id", F.col("position").alias("global"), "n_bytes", "hashes.*"
        ),
        "trie-placed",
    )
    first = placed.groupBy("conv_id").agg(
        F.min("global").alias("first"), F.max("global").alias("last")
    )
    placed = placed.join(first, "conv_id").select(
        F.floor(F.col("first") / SHARD_TURNS).alias("shard"),
        F.floor((F.col("global") - F.col("first")) / SLICE).alias("slice"),
        "conv_id",
        (F.col("global") - F.col("first")).alias("depth"),
        (F.col("global") == F.col("last")).alias("ends"),
        "n_bytes",
        "high",
        "low",
    )
    placed = stored(placed, "trie-sharded")
    # What the slices before a conversation's slice make of its key: none for most.
    whole = placed.groupBy("conv_id", "slice").agg(
        F.bit_xor("high").alias("slice_high"), F.bit_xor("low").alias("slice_low")
    )
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begun = whole.filter("slice > 0").select("conv_id").distinct()
    starts = (
        whole.join(begun, "conv_id", "left_semi")
        .withColumn("start_high", F.bit_xor("slice_high").over(before))
        .withColumn("start_low", F.bit_xor("slice_low").over(before))
        .select("conv_id", "slice", "start_high", "start_low")
    )
    rows = placed.join(starts, ["conv_id", "slice"], "left").fillna(0, ["start_high", "start_low"])
    run = _RUN
    return rows.groupBy("shard", "slice").applyInPandas(lambda f: _nodes_of(f, run), _LOCAL)


def _turn_hashes(depth: str, digest: str) -> Column:
    """128 bits of a turn at its position; zero for the root."""

    def hashes(positions: pd.Series, digests: pd.Series) -> pd.DataFrame:
        at = positions.to_numpy().astype(np.uint64)
        rooted = np.array([len(d) == 0 for d in digests], dtype=bool)
        raw = np.frombuffer(
            b"".join(bytes(d) if len(d) else bytes(16) for d in digests), dtype=np.uint64
        ).reshape(-1, 2)
        high = mixed(mixed(raw[:, 0] ^ mixed(at)) ^ raw[:, 1])
        low = mixed(mixed(raw[:, 1] ^ mixed(~at)) + raw[:, 0])
        return pd.DataFrame({
            "high": np.where(rooted, 0, high.view(np.int64)),
            "low": np.where(rooted, 0, low.view(np.int64)),
        })

    return F.pandas_udf(hashes, "high long, low long")(depth, digest)


def _nodes_of(frame: pd.DataFrame, run: int) -> pd.DataFrame:
    """Depth-first intersection of bitsets over one shard's slice; ends in lists of ``run``."""
    frame = frame.sort_values(["conv_id", "depth"], kind="stable")
    convs, owner = np.unique(frame["conv_id"].to_numpy(), return_inverse=True)
    depths = frame["depth"].tolist()
    turns = list(zip(frame["high"].tolist(), frame["low"].tolist()))
    n_bytes = frame["n_bytes"].tolist()
    ends_here = frame["ends"].tolist()
    owners = owner.tolist()
    shared = len(convs) > 1
    # Postings: which sequences have this turn at this position.
    postings: dict[tuple, int] = {}
    row_of: dict[tuple[int, int], int] = {}
    first_row: list[int] = []
    for row, (who, depth) in enumerate(zip(owners, depths)):
        if who == len(first_row):
            first_row.append(row)
        row_of[who, depth] = row
        if shared:
            at = (depth, turns[row])
            postings[at] = postings.get(at, 0) | 1 << who
    has_turn: dict[int, int] = {}
    for (depth, _), bits in postings.items():
        has_turn[depth] = has_turn.get(depth, 0) | bits
    after_row = first_row[1:] + [len(depths)]
    ending: dict[int, int] = {}
    for who, end in enumerate(after_row):
        if ends_here[end - 1]:
            ending[depths[end - 1]] = ending.get(depths[end - 1], 0) | 1 << who

    out: list[tuple] = []
    ids = convs.tolist()

    def give(key, parent, depth: int, members: list[int], ended: list[int], row: int) -> None:
        out.append((*key, *parent, depth, members[0], len(members), n_bytes[row], members,
                    ended[:run]))
        for more in range(run, len(ended), run):
            out.append((*key, *parent, depth, members[0], 0, n_bytes[row], [],
                        ended[more : more + run]))

    def alone(who: int, row: int, parent) -> None:
        """The rest of a sequence that no other shares: a path."""
        one = [ids[who]]
        for at in range(row, after_row[who]):
            key = (parent[0] ^ turns[at][0], parent[1] ^ turns[at][1])
            above = parent if depths[at] else (None, None)
            give(key, above, depths[at], one, one if ends_here[at] else [], at)
            parent = key

    # What begins here: the prefixes that the slice's first rows continue.
    begins: dict[tuple[int, int], int] = {}
    start_high, start_low = frame["start_high"].tolist(), frame["start_low"].tolist()
    for who, row in enumerate(first_row):
        start = (start_high[row], start_low[row])
        begins[start] = begins.get(start, 0) | 1 << who
    start_depth = depths[0] if depths else 0
    waiting = [(start, start_depth - 1, bits) for start, bits in begins.items()]
    while waiting:
        parent, depth, bits = waiting.pop()
        depth += 1
        left = bits & has_turn.get(depth, 0) if shared else bits
        while left:
            who = (left & -left).bit_length() - 1
            row = row_of[who, depth]
            child = bits & postings[depth, turns[row]] if shared else bits
            left &= ~child
            if child.bit_count() == 1:
                alone(who, row, parent)
                continue
            key = (parent[0] ^ turns[row][0], parent[1] ^ turns[row][1])
            above = parent if depth else (None, None)
            ended = _chosen(ids, child & ending.get(depth, 0))
            give(key, above, depth, _chosen(ids, child), ended, row)
            waiting.append((key, depth, child))
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    found = pd.DataFrame(dict(zip(names, zip(*out))) if out else [], columns=names, dtype=object)
    # By way of Int64: a null among them would make doubles of 64-bit keys.
    return found.astype({c: "Int64" for c in names if c not in ("members", "ends")})


def _chosen(ids: list[int], bits: int) -> list[int]:
    """The ids whose bits are set, in order."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return [ids[k] for k in np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()]


def _along_owners(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``owner`` with the sums over all nodes of that smallest member, and the nodes with the
    sums over those of the same owner that lie above (``above_leaves``, ``above_saved``).

    Running sums over the sorted table: within each of its partitions, plus what earlier
    partitions hold; an owner's nodes may lie in several.
    """
    placed = with_positions(nodes, ["conv_id", "depth"], "trie-owned")
    pieces = placed.withColumn("__part", F.floor(F.col("position") / _RUNNING).cast("int"))
    running = Window.partitionBy("__part").orderBy("position")
    pieces = stored(
        pieces.withColumn("run_leaves", F.sum("leaves").over(running)).withColumn(
            "run_saved", F.sum("saved").over(running)
        ),
        "trie-running",
    )
    sums = pieces.groupBy("__part").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    for amount in ("leaves", "saved"):
        starts = running_starts(sums.select("__part", amount), amount)
        pieces = pieces.join(starts.withColumnRenamed("__start", f"start_{amount}"), "__part")
        pieces = pieces.withColumn(
            f"before_{amount}", F.col(f"start_{amount}") + F.col(f"run_{amount}") - F.col(amount)
        )
    owners = stored(
        pieces.groupBy(F.col("conv_id").alias("owner")).agg(
            F.sum("leaves").alias("all_leaves"),
            F.sum("saved").alias("all_saved"),
            F.min("before_leaves").alias("first_leaves"),
            F.min("before_saved").alias("first_saved"),
        ),
        "trie-owners",
    )
    known = pieces.join(owners, pieces["conv_id"] == owners["owner"]).select(
        "high", "low", "parent_high", "parent_low", "conv_id", "depth", "n_convs", "n_children",
        (F.col("before_leaves") - F.col("first_leaves")).alias("above_leaves"),
        (F.col("before_saved") - F.col("first_saved")).alias("above_saved"),
    )
    return owners.select("owner", "all_leaves", "all_saved"), known


def _end_digests(local: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes where conversations end: runs in ascending order, hashed
    as they pass."""
    runs = local.filter(F.size("ends") > 0).select(
        "high", "low", F.col("ends")[0].alias("first"), F.array_join("ends", ",").alias("run")
    )
    ordered = runs.repartition("high", "low").sortWithinPartitions("high", "low", "first")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in batches:
            out = []
            for high, low, run in zip(frame["high"], frame["low"], frame["run"]):
                if (high, low) != node:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (high, low), hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
            yield pd.DataFrame(out, columns=["high", "low", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["high", "low", "ends_sha256"])

    return ordered.drop("first").mapInPandas(digests, "high long, low long, ends_sha256 string")
