"""Near duplicates where unlike families share buckets."""

from __future__ import annotations

import random

import pytest

from plumbline.llm import bagminhash as bag, common, neardup


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    common.ship(spark)
    yield
    common.release(spark)


def _classes(texts):
    """All pairs compared, and what links connect."""
    sets = [set(bag.tagged(bag.shingles(bag.words_of(t))).tolist()) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common_part = len(a & sets[j])
            if common_part >= neardup.THRESHOLD * (len(a) + len(sets[j]) - common_part):
                low, high = sorted((root(i), root(j)))
                top[high] = low
    return [root(i) for i in range(len(texts))]


def test_family_beside_outsiders_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 30_000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(40)]
    texts = []
    for _ in range(250):  # near copies of one text that holds the passage
        copy = passage + base
        copy[rng.randrange(60, 100)] = word()
        texts.append(" ".join(copy))
    for _ in range(250):  # texts of their own around the same passage
        texts.append(" ".join(passage + [word() for _ in range(40)]))
    tables = {}
    keep = neardup.stored

    def watched(df, label, *more):
        tables[label] = keep(df, label, *more)
        return tables[label]

    monkeypatch.setattr(neardup, "stored", watched)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame).collect()}
    assert tables["near-apart"].count() > 300
    assert tables["near-pairs"].count() <= 2 * len(texts)
    assert [found[i] for i in range(len(texts))] == _classes(texts)


def test_chains_are_linked_through_late_pairs(spark):
    rng = random.Random(8)
    text, texts = [f"c{rng.randint(0, 9000)}" for _ in range(160)], []
    for step in range(60):
        text = text[:]
        text[rng.randrange(160)] = f"c{rng.randint(0, 9000)}"
        texts.append(" ".join(text))
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame).collect()}
    assert [found[i] for i in range(len(texts))] == _classes(texts)
