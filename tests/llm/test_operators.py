"""The corpus operators on small tables with odd rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    ann, common, exactdedup, langid, mixing, neardup, packing, pagetext, quality, queries,
    tokenfile, wordpiece,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    common.ship(spark)
    yield
    common.release(spark)


def _words(seed, count, stem="w"):
    rng = random.Random(seed)
    return [f"{stem}{rng.randint(0, 5000)}" for _ in range(count)]


@pytest.fixture(scope="module")
def documents(spark):
    base = _words(1, 400)
    rows = [(i, " ".join(_words(100 + i, 30 + i)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(40 + i, "same text here", "fr", "s1", 1) for i in range(7)]
    rows += [(60 + i, " ".join(base[: 10 * i] + ["x"] + base[10 * i + 1 :]), "de", None, 1) for i in range(1, 6)]
    rows += [(70, None, None, None, None), (71, "", "en", "s0", 0), (72, " \n", "en", "s0", 2)]
    rows += [(None, "no id", "en", "s2", 5), (74, "twice", "en", "s2", 5), (74, "twice", "en", "s2", 5)]
    rows += [(75, " ".join(_words(9, 20_000)), "en", "s0", 1), (76, "日本 😀 «»", None, "s1", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumn("label", F.lit(1)).withColumn("group_size", F.lit("other"))


@pytest.fixture(scope="module")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_duplicates(documents, no_documents):
    found = _rows(exactdedup.exact_duplicates(documents))
    rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text].append(i)
    expected = Counter()
    for i, text in rows:
        ids = [x for x in groups[text] if x is not None]
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected[(i, max(ids) if ids else None, len(groups[text]), digest)] += 1
    assert Counter((a, b, c, e) for a, b, c, _, e in found) == expected
    assert Counter(e for *_, kept, e in found if kept) == Counter({e: 1 for *_, e in found})
    assert _rows(exactdedup.exact_duplicates(no_documents)) == []


def test_dropping_exact_duplicates_keeps_columns(documents):
    kept = exactdedup.drop_exact_duplicates(documents)
    assert kept.columns == documents.columns
    texts = Counter(r["text"] or "" for r in kept.collect())
    assert texts == Counter({t: 1 for t in {r["text"] or "" for r in documents.collect()}})


def test_false_suspects_turn_out_single(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "_SPARE_BITS", -8)
    rows = [(i, f"text {i % 900}") for i in range(1_000)]
    found = exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = Counter(r["group_size"] for r in found.collect())
    assert sizes == {1: 800, 2: 200}


def _similarity(a, b):
    def bag(text):
        w = text.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_near_duplicates(spark, documents, no_documents):
    base = _words(3, 300)
    more = []
    for i in range(40):  # copies of one text with a few words changed
        rng, words = random.Random(i), list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"new{i}"
        more.append((1000 + i, " ".join(words)))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = neardup.near_duplicates(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a.split() and b.split() and _similarity(a, b) >= 0.8:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[root(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    expected = Counter(
        (doc_id, least[root(i)], len(members[root(i)])) for i, (doc_id, _) in enumerate(rows)
    )
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(members)
    assert neardup.drop_near_duplicates(docs).count() == len(members)
    assert _rows(neardup.near_duplicates(no_documents)) == []


def test_language(spark, documents, no_documents):
    stems = {"en": "ing", "fr": "eaux", "de": "ung"}
    rows = [(i, " ".join(_words(i, 40, s)), k) for i, (k, s) in enumerate([*stems.items()] * 40)]
    rows += [(900, None, "en"), (901, "123 !", "en"), (902, "ingo ingu", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {
        r["doc_id"]: (r["lang"], *r["found"])
        for r in langid.identify(docs, F.col("doc_id") % 4 != 0, "text", "lang", "found").collect()
    }
    assert all(got[i][0] == got[i][1] for i, _, _ in rows[:120])
    assert got[900][1:] == got[901][1:] == ("und", 0.0)
    assert all(0 <= x[2] <= 1 for x in got.values())
    untrained = langid.train(no_documents, "text", "lang")
    assert {r["p"]["lang"] for r in untrained.predict(documents, "text", "p").collect()} == {"und"}


def test_quality(spark, documents, no_documents):
    rows = [(i, " ".join(_words(i, 60)).capitalize() + ".", 1) for i in range(200)]
    rows += [(500 + i, " ".join(w + "!!" for w in _words(i, 60)).upper(), 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.filter("doc_id % 3 = 0").select("doc_id", "quality")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["s"] for r in model.predict(docs, "text", "s").collect()}
    assert all((scores[i] >= quality.THRESHOLD) == bool(q) for i, _, q in rows)
    odd = model.predict(documents, "text", "s").collect()
    assert {r["s"] for r in odd if not (r["text"] or "").strip()} == {0.0}
    # Label 0 is not looked at, and the prior is the share of good texts all the same.
    only_good = quality.train(docs, labels.filter("quality = 1"))
    assert only_good.prior == model.prior == pytest.approx(200 / 260, abs=0.06)
    unknown = quality.train(no_documents, labels.limit(0))
    assert {r["s"] for r in unknown.predict(docs, "text", "s").collect()} == {0.5}


def test_rare_kinds_count_among_the_unlabelled(spark):
    """All unlabelled rows make centre, scale, risk and curvature, however they are dealt."""
    rows = [(i, " ".join(_words(i, 40)).capitalize() + ".") for i in range(150)]
    rows += [(500 + i, "|| 77 || 88 || " * 20) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.filter("doc_id < 60").select("doc_id", F.lit(1).alias("quality"))
    models = [quality.train(d, labels) for d in (docs.repartition(1), docs.repartition(7))]
    assert np.allclose(models[0].weights, models[1].weights)
    features = np.array([quality.text_features(t) for _, t in rows])
    assert np.allclose(models[0].centre, features.mean(axis=0))
    assert np.allclose(models[0].scale, features.std(axis=0), atol=1e-5)
    positives = features[:60]
    x, p = (
        quality._expanded(np.clip((f - models[0].centre) / models[0].scale, -8, 8))
        for f in (features, positives)
    )
    prior = min(max(quality.estimated_prior(p, quality.means_of(x)), 0.01), 0.99)
    assert models[0].prior == pytest.approx(prior, rel=1e-6)
    # No small step from the weights found has a smaller risk.
    def risk(w):
        z = p @ w
        return (
            np.logaddexp(0, x @ w).mean() - prior * z.mean() + quality.DECAY / 2 * w @ w
        )

    found, rng = models[0].weights, np.random.default_rng(1)
    negative = np.logaddexp(0, x @ found).mean() - prior * np.logaddexp(0, p @ found).mean()
    assert negative >= 0
    if negative > 1e-3:
        assert all(
            risk(found) <= risk(found + rng.normal(size=len(found)) * 1e-3) + 1e-9 for _ in range(40)
        )


def test_rows_without_an_id_are_in_no_fold(spark, tmp_path):
    """They are learned from, and their results say that they were not held out."""
    rows = [(None if i == 3 else i, " ".join(_words(i, 30)) + ".", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    for query in (queries.op1_language_id, queries.op2_quality):
        found = query(spark, str(tmp_path)).collect()
        assert len(found) == 60 and {type(r["held_out"]) for r in found} == {bool}
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]


def test_page_text_keeps_rows(spark):
    rows = [(1, "<p>a</p>"), (1, "<p>a</p>"), (2, None)]
    got = pagetext.extract(spark.createDataFrame(rows, "page_id long, html string"))
    assert sorted(_rows(got.select("page_id", "text"))) == [(1, "a"), (1, "a"), (2, "")]


def test_token_counts(documents):
    path = queries.tokenizer_path("word_bpe_49k.json")
    got = wordpiece.token_counts(documents, path).select("text", "counts.*").collect()
    assert len(got) == documents.count()
    assert all(r["n_tokens"] == r["n_words"] == 0 for r in got if not (r["text"] or "").strip())
    assert all(r["n_tokens"] >= r["n_words"] > 0 for r in got if (r["text"] or "").strip())


def _ids(end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    return lambda text: library.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("segment", [1, 50, tokenfile.SEGMENT_IDS])
def test_token_files(spark, documents, no_documents, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", segment)
    path, encode = queries.tokenizer_path("byte_bpe_50k.json"), _ids(2)
    tokenfile.write_token_files(documents, f"{tmp_path}/f", path, 2)
    got = tokenfile.read_token_files(spark, f"{tmp_path}/f").collect()
    rows = sorted(
        ((r["doc_id"], r["text"] or "") for r in documents.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    )
    start = 0
    for (doc_id, text), r in zip(rows, sorted(got, key=lambda r: r["start"]), strict=True):
        ids = encode(text)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    # Single documents, at their places in the segments.
    some = tokenfile.read_token_files(spark, f"{tmp_path}/f", [74, 5, 999]).collect()
    key = lambda r: (r["doc_id"], r["start"])
    assert sorted(some, key=key) == sorted((r for r in got if r["doc_id"] in (5, 74)), key=key)
    tokenfile.write_token_files(no_documents, f"{tmp_path}/e", path, 2)
    assert tokenfile.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_packing(documents, no_documents):
    path, encode = queries.tokenizer_path("byte_bpe_50k.json"), _ids(1)
    got = packing.pack(documents, path, 1, window=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in {(r["doc_id"], r["text"]) for r in documents.collect()}:
        ids = np.array(encode(text), "<u4")
        copies = 2 if doc_id == 74 else 1
        assert sum(r["length"] for r in pieces[doc_id]) == copies * len(ids)
        for r in pieces[doc_id]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert bytes(r["ids"]) == part.tobytes() and r["doc_tokens"] == len(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    full = sum(sum(n for _, n in p) == 64 for p in sequences.values())
    assert full >= len(sequences) - documents.rdd.getNumPartitions()
    assert packing.pack(no_documents, path, 1).count() == 0


def _shares(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        goal = {s: 3 * sizes[s] if s in stopped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in stopped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        stopped |= over


def test_mixing(spark, documents, no_documents):
    rows = [(i, " ".join(["w"] * (i % 50)), f"t{i % 4}" if i % 7 else None) for i in range(2_000)]
    rows += [(5000 + i, "one two", "tiny") for i in range(3)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string"), documents):
        got = mixing.mix(docs).collect()
        assert len(got) == docs.count()
        again = mixing.mix(docs.repartition(3)).collect()
        key = lambda r: (r["doc_id"], r["digest"], r["copies"])
        assert Counter(map(key, got)) == Counter(map(key, again))
        sizes, taken, most = Counter(), Counter(), Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["copies"] * r["size"]
            most[r["source"]] = max(most[r["source"]], r["size"])
        goals = _shares(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
            assert r["target"] == pytest.approx(goals[r["source"]])
        for s in goals:
            assert abs(taken[s] - goals[s]) <= (most[s] if docs is documents else 2)
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(no_documents).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 8))
    vectors[100:200] = vectors[7]  # one vector that a quarter of all rows share
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (None, [1.0] * 8)]
    odd += [(904, [None] * 8), (20, rows[20][1])]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.Index(docs, "vec_id", "embedding", k=5).search(F.col("id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        true = sorted((i for i in range(400) if i != q), key=lambda i: (-round(scores[i], 9), i))[:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in found} & set(true))
        assert all(s == pytest.approx(scores[v]) for _, v, s in found)
    assert hits >= 0.9 * 100
    none = ann.Index(docs.limit(0), "vec_id", "embedding", k=5).search(F.col("id") % 20 == 0)
    assert none.count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, " ".join(_words(i, 40 + i)).capitalize() + ".", "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200 + i, rows[5][1], "en", "s0", 1) for i in range(4)]
    rows += [(300 + i, rows[9][1] + f" more{i}", "en", "s1", 1) for i in range(4)]
    rows += [(400 + i, " ".join(w + "!!" for w in _words(i, 50)).upper(), "en", "s2", 1) for i in range(40)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(r[0], int(r[0] < 400)) for r in rows if r[0] % 2 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert [f.name for f in docs.schema] == [x.split()[0] for x in SCHEMA.split(", ")]
    clean = {r[0] for r in rows if r[0] < 400}
    assert {r["doc_id"] for r in seen["quality"]} == clean
    assert {r["doc_id"] for r in seen["exact_dedup"]} == clean - {5, 200, 201, 202}
    assert {r["doc_id"] for r in seen["near_dedup"]} == clean - {5, 200, 201, 202, 300, 301, 302, 303}
    encode, text = _ids(1), {r[0]: r[1] for r in rows}
    per = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(per) <= {r["doc_id"] for r in seen["near_dedup"]} and max(per.values()) <= 3
    tokens = Counter()
    for r in seen["packing"]:
        tokens[r["doc_id"]] += r["length"]
        ids = np.array(encode(text[r["doc_id"]]), "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    assert tokens == Counter({i: n * len(encode(text[i])) for i, n in per.items()})


def test_texts_cut_at_marks_have_the_librarys_ids():
    """Prose is cut at commas, full stops and line feeds; what looks like our marks is text."""
    import public_tokenizers

    from plumbline.llm import encoding

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoding.encoder(path)
    calls = []
    odd = ["a", "Bc", "thé", "日本", "ß", "3", "14", "²", "Ⅷ", "_", " ", " ", ",", ". ", ".",
           "\n", ".\n", "'s", "?", "\t", "\x01", " \x01", "​", "😀", "...", "्", "क"]
    draw = random.Random(5)
    for _ in range(3_000):
        text = "".join(draw.choice(odd) for _ in range(draw.randint(1, 14)))
        ids = encode._tokenizer.encode(text, add_special_tokens=False).ids
        assert encode.library_ids(text) == np.array(ids, dtype=encode.dtype).tobytes(), text
    counted = encoding.Encoder(path)
    plain = counted._later._compound
    counted._later._compound = lambda piece: calls.append(piece) or plain(piece)
    counted.library_ids("One word, two.\nThree, four. Five, six.")
    assert not calls  # such pieces were put together each time they were met


def test_columns_of_texts_have_the_librarys_ids(monkeypatch):
    """Columns are cut at bytes, and each different piece of a slice is looked up once."""
    import public_tokenizers

    from plumbline.llm import encoding

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoding.Encoder(path)
    odd = ["a", "Bc", "thé", "日本", "ß", "3", "²", "Ⅷ", "_", " ", " ", ",", ". ", ".", "\n", "\n", "'s",
           "'", "?", "\t", "\x01", "\x1c", "\x85", "\xa0", "　", "\r\n", "×", "”", "…", "​", "😀",
           "ª", "́", "ж", "٣", "्", "क", "<|endoftext|>", "\x00"]
    draw = random.Random(6)
    texts = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 14))) for _ in range(3_000)]
    texts = [None, "", *texts, None]
    whole = [encode._tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole = [np.array(ids, dtype=encode.dtype).tobytes() for ids in whole]
    for size in (1, 100, encoding.SLICE_BYTES):
        monkeypatch.setattr(encoding, "SLICE_BYTES", size)
        for skipped in (0, 7):
            column = pa.array(texts, pa.string()).slice(skipped)
            assert list(encode.library_ids_of(column)) == whole[skipped:]
    assert list(encode.library_ids_of(pa.array([], pa.string()))) == []
    # Words that occur in many places are looked up once.
    looked_up, plain = [], encode._look_up
    monkeypatch.setattr(encode, "_look_up", lambda x: looked_up.extend(x) or plain(x))
    list(encode.library_ids_of(pa.array(["One word, two words.\nOne word, two."] * 50)))
    assert sorted(looked_up) == sorted(["One", " word", ",", " two", " words", ".", "\n"])


def test_memory_of_pieces_of_columns_is_bounded(monkeypatch):
    import public_tokenizers

    from plumbline.llm import encoding

    monkeypatch.setattr(encoding, "_REMEMBERED", 10)
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoding.Encoder(path)
    texts = [f"word {chr(97 + i % 26) * (1 + i // 26)} {'x' * 65} word" for i in range(200)]
    for at in range(0, 200, 20):
        got = list(encode.library_ids_of(pa.array(texts[at : at + 20])))
        assert got == [encode.library_ids(t) for t in texts[at : at + 20]]
        assert len(encode._known) <= 10 and len(encode._old) <= 10
        assert max(map(len, [*encode._known, *encode._old])) <= 64
