"""The parts of the corpus operators that need no Spark, against brute force."""

from __future__ import annotations

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bagminhash as bag, packing, quality
from plumbline.llm.encoding import Encoder
from plumbline.llm.exactdedup import low_bits_for, rice_decode, rice_encode
from plumbline.llm.hilbert import hilbert_keys
from plumbline.llm.langid import gram_counts
from plumbline.llm.pagetext import main_text
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.tokenfile import EliasFano
from plumbline.llm.wordpiece import Automaton, WordPieces


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_stepwise(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("count", [0, 1, 2, 700])
def test_rice_round_trip(count):
    rng = np.random.default_rng(count)
    values = np.unique(rng.integers(0, 1 << 30, count)).astype(np.int64)
    low = low_bits_for(1 << 30, len(values))
    assert (rice_decode(rice_encode(values, low), len(values), low) == values).all()


@pytest.mark.parametrize("count, top", [(0, 1), (1, 1), (5, 1), (2000, 10**12), (3000, 100)])
def test_elias_fano_round_trip_and_select(count, top):
    values = np.sort(np.random.default_rng(count).integers(0, top, count)).astype(np.uint64)
    coded = EliasFano.of(values)
    assert (coded.select(np.arange(count)) == values).all()
    some = np.random.default_rng(1).integers(0, max(count, 1), 50) if count else np.zeros(0, int)
    assert (coded.select(some) == values[some]).all()
    for wanted in ([count], [-1]):
        with pytest.raises(IndexError):
            coded.select(np.array(wanted))
    if count == 2000:
        assert len(coded.low) + len(coded.high) < count * 5


def test_long_words_are_not_remembered():
    encode, count = Encoder(tokenizer_path("byte_bpe_50k.json")), WordPieces(tokenizer_path("word_bpe_49k.json"))
    words = ["x" * n for n in (3, 64, 65, 5_000)]
    for word in words:
        for text in (word, f"a {word} b"):
            assert encode.ids(text) == encode.ids(text)
        assert count.count(word) == count.count(f" {word} ")
    assert max(map(len, [*encode._first, *encode._later, *count._known])) <= 64


def _longest_match(word, pieces, end):
    rest, count = word + "\0", 0
    while rest:
        for n in range(len(rest), 0, -1):
            piece = rest[:n].replace("\0", end)
            if piece in pieces and piece != end:
                rest, count = rest[n:], count + 1
                break
        else:
            return 1
    return count


def test_automaton_counts_as_longest_match():
    pieces = "a b ab abc bc c</w> a</w> b</w> abcd d</w> cd bcd</w> d c ddd</w> bx xa</w>".split()
    automaton = Automaton(pieces)
    for n in range(1, 7):
        for word in map("".join, itertools.product("abcdx", repeat=n)):
            assert automaton.count(word) == _longest_match(word, set(pieces), "</w>"), word


def test_ids_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    whole, own = tokenizers.Tokenizer.from_file(path), Encoder(path)
    whole.encode_special_tokens = True
    parts = ["a", "word", " ", "  ", "\n", "\t", "'s", "'", "1", "42", ".", "!!", "é", "ß", " ",
             "\x1c", "<|endoftext|>", "日本", "\r\n", "😀", "\x85", "　", "Ünd,"]
    rng = random.Random(5)
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = np.frombuffer(own.ids(text), own.dtype).tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = rng.integers(0, 9, 60)
    b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 9, 60))
    similarity = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    one = bag.signatures(
        np.concatenate([elements[a > 0], elements[b > 0]]),
        np.concatenate([a[a > 0], b[b > 0]]),
        np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]),
        2,
        10_000,
    )
    assert abs((one[0] == one[1]).mean() - similarity) < 0.015
    left, right = (set(bag.tagged(np.sort(np.repeat(elements, n))).tolist()) for n in (a, b))
    assert len(left) == a.sum() and len(right) == b.sum()
    assert len(left & right) / len(left | right) == pytest.approx(similarity)


def test_short_and_empty_texts_have_shingles():
    assert len(bag.shingles([])) == 0
    assert len(bag.shingles(["one", "two"])) == 1
    assert len(bag.shingles("a b c d e f".split())) == 2
    assert len(bag.tagged(bag.shingles([]))) == 0


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "Größe und Maß. " * 40
    whole = gram_counts(text)
    monkeypatch.setattr("plumbline.llm.langid._SLICE", 7)
    again = gram_counts(text)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    assert len(gram_counts("")[0]) == 0


def test_quality_statistics_of_odd_texts():
    assert quality.text_features("") == [0.0] * len(quality.FEATURES)
    assert quality.text_features(" \n\t") == [0.0] * len(quality.FEATURES)
    for text in ("!!!", "日本 日本", "x" * 100_000, "a b " * 50_000):
        assert np.isfinite(quality.text_features(text)).all()


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (800, 2)), rng.normal(-1.5, 1, (800, 2))
    one = np.ones((400, 1))
    positives = np.hstack([good[:400], one])
    unlabelled = np.hstack([np.vstack([good[400:], bad]), np.ones((1200, 1))])
    weights = quality.minimise(positives, quality.means_of(unlabelled), 1 / 3)
    assert (np.hstack([good[:400], one]) @ weights > 0).mean() > 0.9
    assert (np.hstack([bad[:400], one]) @ weights < 0).mean() > 0.9


def test_least_squares_uses_no_length_twice():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(2047, 600, False) + 1, rng.integers(1, 90, 600))}
    combos = packing.combinations(histogram)
    counts = packing.repeat_counts(histogram, combos)
    assert all(sum(c) == packing.WINDOW for c in combos) and (counts >= 0).all()
    used = dict.fromkeys(histogram, 0)
    for combo, count in zip(combos, counts):
        for n in combo:
            used[n] += int(count)
    assert all(used[n] <= histogram[n] for n in used)
    assert packing.combinations({}) == [] and len(packing.repeat_counts({}, [])) == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x">
<header><h1>Site</h1></header><nav><a href=a>Home</a> <a href=b>News</a></nav>
<div class="cookie-notice">We use cookies, and more, here.</div>
<div id="main"><div class="sidebar">Side, side.</div><h1>Title &amp; more</h1>
<p>One, two,&nbsp;three: a <b>longer</b>
 paragraph<br>goes here.<p>Second paragraph, unclosed.
<ul><li>first<li>second</ul><script>var a = "<p>no</p>";</script><!-- <p>no --></div>
<section class="comments"><p>Great, great, great, really, good, work, thanks.</p></section>
<form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    expected = [
        "Title & more",
        "One, two, three: a longer paragraph goes here.",
        "Second paragraph, unclosed.",
        "first",
        "second",
    ]
    assert main_text(PAGE) == "\n\n".join(expected)
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("plain < text &lt;") == "plain < text <"
    assert main_text("<div>" * 5_000 + "deep" + "</div>" * 10) == "deep"
    assert len(main_text("<p>" + "word, " * 200_000)) == 200_000 * 6 - 1


_PROSE = "A sentence of prose, with commas, and words enough to be worth keeping in an article. "


def test_sections_that_wrap_their_paragraphs_all_stay():
    sections = [f"<section><div><p>{_PROSE * 3}{i}</p></div></section>" for i in range(3)]
    page = f"<body><div>{''.join(sections)}</div><div><a href=a>one two</a> <a href=b>three</a></div>"
    assert main_text(page) == "\n\n".join(_PROSE * 3 + str(i) for i in range(3))


def test_names_do_not_overrule_prose():
    page = f"""<main><p>Intro, to it.</p><div class="search-results"><p>{_PROSE * 3}</p></div>
    <div class="meta-analysis"><p>{_PROSE * 2}</p></div>
    <div class="related-posts"><p>Read: <a href=x>this long title</a></p></div>
    <div class="comment-list"><p>{_PROSE * 3}</p></div><div class="meta">{_PROSE * 3}</div></main>"""
    assert main_text(page) == "\n\n".join(["Intro, to it.", (_PROSE * 3).strip(), (_PROSE * 2).strip()])


def test_an_article_without_its_element():
    page = f"""<body><div class=top>Menu: <a href=a>a</a> <a href=b>b</a></div><div id=c><h1>Title</h1>
    <p>{_PROSE}</p><blockquote><p>Quoted, at length, here.</p></blockquote><p>{_PROSE * 2}</p>
    <ul><li>item, one</li></ul></div><div class=side><p>Short.</p></div></body>"""
    assert main_text(page).split("\n\n") == [
        "Title", _PROSE.strip(), "Quoted, at length, here.", (_PROSE * 2).strip(), "item, one",
    ]


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + "deep, text",
        "<b>" * 20_000 + "<p>x" * 20_000 + "</i>" * 20_000,
        "<div>some, text " * 60_000,
        "<ul><li>" * 40_000 + "</b>" * 40_000,
        "<table><tr><td>" * 30_000 + "</i></p>" * 30_000,
    ],
)
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


def test_encoding_holds_a_slice_of_a_batch_at_a_time():
    texts = [None, "", *(f"text {i}, of some words" for i in range(2 * packing.SLICE_ROWS))]
    rows = {"doc_id": range(len(texts)), "known": [True] * len(texts), "text": texts}
    encode = Encoder(tokenizer_path("byte_bpe_50k.json"))
    run = packing._encoded(tokenizer_path("byte_bpe_50k.json"), 1)
    parts = list(run(iter([pa.RecordBatch.from_pydict({k: list(v) for k, v in rows.items()})])))
    assert [p.num_rows for p in parts] == [packing.SLICE_ROWS] * 2 + [2]
    whole = pa.Table.from_batches(parts).to_pydict()
    assert whole["doc_id"] == list(range(len(texts)))
    end = np.array([1], dtype=encode.dtype).tobytes()
    assert whole["ids"] == [encode.library_ids(t or "") + end for t in texts]


def test_encoding_a_column_takes_memory_by_the_slice():
    texts = pa.array([f"Some words, {i} of them {i * i}.\nAnd more words." for i in range(200_000)])
    encode = Encoder(tokenizer_path("byte_bpe_50k.json"))
    pool, usual = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        assert sum(1 for _ in encode.library_ids_of(texts)) == len(texts)
        taken = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    assert taken < 9 * texts.nbytes
