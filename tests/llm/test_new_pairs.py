"""Hard negatives, repeated byte strings and prefix tries on odd rows, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, negatives, prefixtrie, suffixdedup


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    common.ship(spark)
    yield
    common.release(spark)


# -- hard negatives ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, uid string, score string"


def _score(a, b):
    exact = sum(math.floor(x * 256) * math.floor(y * 256) for x, y in zip(a, b))
    return max(-(1 << 63), min((1 << 63) - 1, exact))


def _mined(rows, anchor, positives=5, negatives=5, low=80, high=100):
    taking_part = [
        (n, i, v, g) for n, (i, v, g) in enumerate(rows)
        if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for n, i, v, g in taking_part:
        if i is None or not anchor(i):
            continue
        others = [
            (-_score(v, w), j is None, j or 0, j, h)
            for m, j, w, h in taking_part if m != n and len(w) == len(v)
        ]
        others.sort(key=lambda o: o[:3])
        for s, _, _, j, h in [o for o in others if o[4] == g][:positives]:
            window = [
                o for o in others if o[4] != g and low * -s <= 100 * -o[0] <= high * -s
            ][:negatives]
            for rank, (t, _, _, k, _) in enumerate(window, 1):
                out[i, j, rank, k, -s, -t] += 1
    return out


def _vectors(seed, count, dims=6, labels=3):
    rng = random.Random(seed)
    return [
        (i, [round(rng.uniform(-0.2, 1.0), 2) for _ in range(dims)], rng.randrange(labels))
        for i in range(count)
    ]


def _mine(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    found = negatives.mine(frame, F.pmod("id", F.lit(4)) == 0, **more)
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("chunk", [24 << 20, 2000])
def test_hard_negatives_as_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK_BYTES", chunk)
    rows = _vectors(1, 120)
    rows += [(4, rows[8][1], 2), (4, rows[8][1], 2), (None, rows[8][1], 0), (9_007_199_254_740_993, rows[8][1], 1)]
    rows += [(200, None, 1), (204, [0.5] * 6, None), (208, [0.1, None, 0.3, 0.0, 0.0, 0.0], 1)]
    rows += [(212, [float("nan")] * 6, 1), (216, [float("inf")] * 6, 1), (220, [0.5, 0.5], 1), (221, [0.5, 0.5], 2)]
    rows += [(224, [0.5, 0.6], 1), (228, [], 1), (229, [], 1), (230, [], 2), (231, rows[8][1], 0)]
    assert _mine(spark, rows) == _mined(rows, lambda i: i % 4 == 0)


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(60)] + [(100 + i, [0.4, 0.25], i % 2) for i in range(20)]
    found = _mine(spark, rows)
    assert found == _mined(rows, lambda i: i % 4 == 0)
    assert {k[3] for k in found if k[0] == 0} == {1, 3, 5, 7, 9}


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(1e4, 3e6) for _ in range(3)], i % 3) for i in range(40)]
    rows += [(50, [1e300, 1.0, 1.0], 0), (51, [9e299, 1.0, 1.0], 1), (52, [-1e300, 0.0, 2.0], 0)]
    assert _mine(spark, rows) == _mined(rows, lambda i: i % 4 == 0)


def test_windows_and_counts_are_parameters(spark):
    rows = _vectors(3, 80)
    more = {"positives": 2, "negatives": 9, "low": 60, "high": 95}
    assert _mine(spark, rows, **more) == _mined(rows, lambda i: i % 4 == 0, **more)
    with pytest.raises(ValueError):
        _mine(spark, rows, high=120)


def test_no_vectors(spark):
    assert not _mine(spark, [])
    assert not _mine(spark, [(1, [0.5], 1), (3, [0.5], 2)])


# -- repeated byte strings --------------------------------------------------------------

TEXTS = "doc_id long, text string, block string, spans int"


def _removal(rows):
    size = suffixdedup.MATCH
    data = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    earliest = {}
    for i, b in data:
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            earliest[s] = min(i, earliest.get(s, math.inf))
    out = Counter()
    for (i, _), (rank, b) in zip(rows, data):
        covered = np.zeros(len(b) + 2, dtype=bool)
        for p in range(len(b) - size + 1):
            if earliest[b[p : p + size]] < rank:
                covered[p + 1 : p + size + 1] = True
        kept = bytes(x for x, c in zip(b, covered[1:]) if not c)
        edges = np.flatnonzero(np.diff(covered.astype(int)))
        spans = tuple((int(a), int(z - a)) for a, z in zip(edges[::2], edges[1::2]))
        out[i, len(b), spans, kept] += 1
    return out


def _removed(spark, rows, parts=3, **more):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS).repartition(parts)
    found = suffixdedup.without_repeats(frame, **more).collect()
    return Counter(
        (r["doc_id"], r["n_bytes"], tuple((s["start"], s["length"]) for s in r["spans"]), bytes(r["kept"]))
        for r in found
    )


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, base = prose(14), prose(160)
    rows = [(10 + i, prose(rng.randint(1, 60)) + line + prose(20)) for i in range(25)]
    for i in range(12):
        at = rng.randint(0, len(base) - 1)
        rows.append((50 + i, base[:at] + "#" + base[at + 1 :]))
    rows += [(80, base), (80, base), (3, base), (None, base), (None, line), (90, None), (91, "")]
    rows += [(92, base[:49]), (93, base[:25]), (94, "a" * 700), (95, "a" * 400), (96, "ab" * 90)]
    rows += [(97, base[100:150] + base[300:350] + base[100:160]), (98, "日本語😀" * 30), (99, "x日本語😀" * 30)]
    rows += [(100, "\0" * 60), (101, "\0" * 55), (102, line + "|" + line)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_as_brute_force(spark, seed):
    rows = _texts(seed)
    assert _removed(spark, rows) == _removal(rows)


def test_repeats_in_segments_shards_and_hot_anchors(spark):
    limits = suffixdedup.Limits(
        segment_bytes=150, block_bytes=500, hashed_bytes=130, owner_anchors=20, shard_text=900, sorted_bytes=700,
        hot_pieces=6, longest_run=7, broadcast_bytes=0,
    )
    rows = _texts(3)
    assert _removed(spark, rows, limits=limits) == _removal(rows)


def test_no_texts(spark):
    assert not _removed(spark, [])
    assert _removed(spark, [(1, None), (1, "short")]) == _removal([(1, None), (1, "short")])


@pytest.mark.parametrize("length", [3, 7])
def test_rows_part_where_prefixes_differ(length):
    rng = np.random.default_rng(length)
    text = np.append(rng.integers(97, 100, 400), 255).astype(np.uint8)
    text = np.concatenate([text, text[50:120], [255]]).astype(np.uint8)
    order = suffixdedup.suffix_order(text)
    raw = text.tobytes()
    parted = suffixdedup.equal_prefixes(text, order, length)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:length], raw[order[k] :][:length]
        if 255 not in a and 255 not in b and len(a) == len(b) == length:
            assert parted[k] == (a != b)


def test_packed_numbers_come_back():
    for values in ([], [5], [-3, 1 << 62, 0], list(range(1000))):
        assert suffixdedup.unpack(suffixdedup.pack(np.array(values, dtype=np.int64))).tolist() == values


# -- prefix tries -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, position int, depth string"


def _trie(sequences):
    """``sequences``: conversation to list of (role, text)."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(k[:-1] for k in members if k)
    out = Counter()
    for node, convs in members.items():
        below = [k for k in members if k[: len(node)] == node]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[
            min(convs), len(node), parent, len(convs), children[node],
            sum(not children[k] for k in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


def _ordered(rows):
    def key(r):
        role, text = r[2] or "", r[3] or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        return (r[1] is not None, r[1] or 0, digest)

    found = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def _rebuilt(original, group, length):
    out = {}
    for c, turns in original.items():
        out[c] = original.get(group(c), [])[: length(c)] + turns[length(c) :]
    return out


def _conversations():
    rng = random.Random(4)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice("ua"), rng.choice(["hi", "yes", "no", "größe", ""])))
    rows += [(50 + i, t, "u", "same") for i in range(20) for t in range(4)]
    rows += [(c, t, "u", "same" if t < 30 + c % 3 else f"{t}") for c in (80, 81, 85) for t in range(45)]
    rows += [(90, None, None, None), (90, 1, "u", None), (90, 1, "u", None), (90, 1, "a", "tie")]
    rows += [(None, 1, "u", "lost"), (-7, 0, "u", "hi"), (-5, 0, "u", "hi"), (97, 3, "u", "alone")]
    return rows


@pytest.mark.parametrize("shard, piece, run", [(8192, 1024, 1024), (30, 1024, 3), (25, 10, 2)])
def test_trie_as_brute_force(spark, monkeypatch, shard, piece, run):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefixtrie, "SLICE", piece)
    monkeypatch.setattr(prefixtrie, "_RUN", run)
    monkeypatch.setattr(prefixtrie, "_RUNNING", 7)
    rows = _conversations()
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], TURNS).repartition(3)
    turns = prefixtrie.turns_in_order(frame)
    length = F.pmod("conv_id", F.lit(4))
    shared = prefixtrie.with_shared_starts(turns, F.col("conv_id") - F.col("conv_id") % 5, length)
    found = Counter(tuple(r) for r in prefixtrie.prefix_trie(shared).collect())
    group = lambda c: c - int(math.fmod(c, 5))
    assert found == _trie(_rebuilt(_ordered(rows), group, lambda c: c % 4))


def test_no_conversations(spark):
    turns = prefixtrie.turns_in_order(spark.createDataFrame([], TURNS))
    shared = prefixtrie.with_shared_starts(turns, F.col("conv_id"), F.lit(2))
    assert prefixtrie.prefix_trie(shared).collect() == []


def test_conversation_without_turns_ends_at_the_root(spark):
    rows = [(3, 0, "u", "gone", 1, "x"), (4, 0, "u", "a", 1, "x"), (4, 1, "u", "b", 1, "x")]
    turns = prefixtrie.turns_in_order(spark.createDataFrame(rows, TURNS))
    shared = prefixtrie.with_shared_starts(turns, F.lit(-1).cast("long"), F.lit(1))
    found = Counter(tuple(r) for r in prefixtrie.prefix_trie(shared).collect())
    assert found == _trie({3: [], 4: [("u", "b")]})
