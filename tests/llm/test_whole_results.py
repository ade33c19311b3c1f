"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, langid, mixing, neardup, packing, tokenfile
from plumbline.llm.pagetext import main_text
from plumbline.llm.queries import tokenizer_path


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    common.ship(spark)
    yield
    common.release(spark)


def test_near_link_beside_the_hub_with_few_shared_registers(spark):
    # The texts are chosen so that the linked pair meets only in buckets of the third text,
    # which is linked to neither, and agrees in 87 of 125 registers.
    rng = random.Random(292)
    one = [f"w{rng.randint(0, 10**6)}" for _ in range(280)]
    spots = rng.sample(range(5, 275, 5), 20)
    other, between = list(one), list(one)
    for i in spots[:6]:
        other[i] = f"y{i}"
    rng = random.Random(68)
    for i in rng.sample(spots[:6], 3):
        between[i] = other[i]
    for i in rng.sample(spots[6:], 6):
        between[i] = "h68"
    rows = [(1, " ".join(between)), (2, " ".join(one)), (3, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 2}


def test_mixing_of_more_sources_than_one_bucket_holds(spark, monkeypatch):
    levels = []

    def stored(df, label, partition_rows=None):
        levels.append(label)
        assert len(levels) <= 8, "no level settles anything any more"
        return common.stored(df, label, partition_rows)

    monkeypatch.setattr(mixing, "stored", stored)
    monkeypatch.setattr(mixing, "FOLD", 0)
    monkeypatch.setattr(mixing, "HELD", 0)
    items = spark.range(80_000).select(
        F.concat(F.lit("s"), F.col("id") % 40_000).alias("source"), F.xxhash64("id").alias("turn"),
        F.col("id").alias("uid"), F.lit(0.5).alias("p"), F.lit(4.0).alias("size"),
    )
    # Two documents of one half each: one of them is taken, of every source.
    extra = mixing.extra_copies(items).groupBy((F.col("uid") % 40_000).alias("source"))
    found = extra.agg(F.count("*").alias("rows"), F.sum("extra").alias("taken"))
    seen = found.groupBy("rows", "taken").agg(F.count("*").alias("sources")).collect()
    assert [tuple(r) for r in seen] == [(2, 1, 40_000)]


def test_mixing_deals_a_large_class_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_BUCKET", 100)
    monkeypatch.setattr(mixing, "FOLD", 0)
    monkeypatch.setattr(mixing, "HELD", 0)
    items = spark.range(3_000).select(
        F.when(F.col("id") % 3 > 0, "s").alias("source"), F.xxhash64("id").alias("turn"),
        F.col("id").alias("uid"), F.lit(0.5).alias("p"), F.lit(4.0).alias("size"),
    )
    found = mixing.extra_copies(items).groupBy(F.col("uid") % 3 > 0)
    got = found.agg(F.count("*").alias("rows"), F.sum("extra").alias("taken")).select("rows", "taken")
    assert sorted(map(tuple, got.collect())) == [(1_000, 500), (2_000, 1_000)]


def test_language_sample_counts_texts_and_not_copies(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 20)
    copies = spark.range(20_000).select(F.lit("kopia").alias("text"), F.lit("sv").alias("lang"))
    texts = spark.range(15).select(F.concat(F.lit("text "), "id").alias("text"), F.lit("sv").alias("lang"))
    more = spark.range(500).select(F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang"))
    sample, seen = langid._sampled, []

    def sampled(known, counts):
        seen.append(sample(known, counts))
        return seen[-1]

    monkeypatch.setattr(langid, "_sampled", sampled)
    langid.train(copies.union(texts).union(more), "text", "lang")
    drawn = {r["lang"]: r["count"] for r in seen[0].groupBy("lang").count().collect()}
    assert drawn == {"sv": 16, "en": 20}


def test_added_tokens_are_those_of_the_library(spark, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "\n", "end.", "Next", "é", "  "]
    rng = random.Random(8)
    texts = ["end. <|endoftext|>Next", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [437, 13, 220, 50256, 10019]
    tokenfile.write_token_files(docs, f"{tmp_path}/f", path, 2)
    for r in tokenfile.read_token_files(spark, f"{tmp_path}/f").collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == [*expected[r["doc_id"]], 2]
    for r in packing.pack(docs, path, 1, window=64).collect():
        ids = np.array([*expected[r["doc_id"]], 1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == ids.tobytes()


@pytest.mark.parametrize("quote", ["'", '"'])
def test_attribute_values_of_any_length(quote):
    value = "<p>Leak, leak.</p>> </div> " * 40_000
    page = f"<div data-x={quote}{value}{quote} id=a><p>The text, whole.</p><p>And more.</p></div>"
    assert main_text(page) == "The text, whole.\n\nAnd more."


def test_stray_quotes_end_with_their_tag():
    page = """<div><p title="a">b" c">The "text", it's whole.</p><p class="x"">More, more.</p>"""
    assert main_text(page) == """b" c">The "text", it's whole.\n\nMore, more."""
    assert main_text('<p title="never closed>The text.</p>') == "The text."
