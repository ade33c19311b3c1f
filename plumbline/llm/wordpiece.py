"""Greedy word-piece counts in linear time.

The vocabulary becomes a trie. A failure link leads from the node of a partial match to the
node of what is left of it once the longest pieces at its front are taken off, and each link
knows how many pieces that are. Counting a word follows one edge or link per character and
adds up the popped counts; no piece is ever built, and nothing is read twice.

Words are contractions, runs of letters, single digits and runs of marks, after composing
characters (NFC) and lower-casing; they end in the mark that the vocabulary puts on final
pieces, and are spelt in its alphabet of bytes. Where no piece fits, the whole word is one unknown
token, as in greedy longest-match tokenizers.

Defined results: null and empty texts have 0 tokens and 0 words. Rows are independent, so
repeated rows and ties do not matter, and other columns are passed through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import named
from .encoding import byte_symbols

END = "</w>"
# Words remembered per worker, and the characters of the longest of them.
_REMEMBERED = 500_000
_LONGEST_REMEMBERED = 64


class Automaton:
    """Longest-match counts for words over a set of pieces.

    A word is read as its characters and then ``end`` as one symbol. ``pieces`` hold plain
    strings; those that close a word end in ``end``.
    """

    def __init__(self, pieces: list[str], end: str = END):
        self.edges: list[dict[str, int]] = [{}]
        self.is_piece = [False]
        parents: list[tuple[int, str]] = [(-1, "")]
        for piece in pieces:
            closing = piece.endswith(end) and piece != end
            symbols = [*piece[: -len(end)], end] if closing else list(piece)
            node = 0
            for symbol in symbols:
                step = self.edges[node].get(symbol)
                if step is None:
                    step = self.edges[node][symbol] = len(self.edges)
                    self.edges.append({})
                    self.is_piece.append(False)
                    parents.append((node, symbol))
                node = step
            self.is_piece[node] = True
        self.end = end
        self._link(parents)

    def _link(self, parents: list[tuple[int, str]]) -> None:
        """Failure links and popped counts, from the root outwards; -1: no link."""
        count = len(self.edges)
        self.fail, self.popped = [-1] * count, [0] * count
        level = list(self.edges[0].values())
        while level:
            following = []
            for node in level:
                following.extend(self.edges[node].values())
                if self.is_piece[node]:
                    # All of the match is one piece; what is left is nothing.
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                parent, symbol = parents[node]
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and symbol not in self.edges[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0 and parent != 0:
                    self.fail[node], self.popped[node] = self.edges[at][symbol], popped
            level = following

    def count(self, word: str) -> int:
        """The number of greedy longest-match pieces of a word; 1 if it cannot be cut."""
        node = tokens = 0
        edges, fail, popped = self.edges, self.fail, self.popped
        for symbol in (*word, self.end):
            step = edges[node].get(symbol)
            while step is None:
                tokens += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                step = edges[node].get(symbol)
                if step is None and node == 0:
                    return 1
            node = step
        # What is matched at the end has to fall apart into whole pieces.
        while node:
            tokens += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return tokens


class WordPieces:
    """Token counts of texts with the vocabulary of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.end = spec["model"].get("end_of_word_suffix") or END
        self.automaton = Automaton(list(spec["model"]["vocab"]), self.end)
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._known: dict[str, tuple[int, int]] = {}

    def words(self, chunk: str) -> list[str]:
        """The words of a text without white space, in the vocabulary's alphabet."""
        return [self.mapped(w) for w in self._words.findall(chunk)]

    def mapped(self, word: str) -> str:
        """One symbol per byte, as byte-level vocabularies write them."""
        return byte_symbols(word)

    def _chunk(self, chunk: str) -> tuple[int, int]:
        words = self.words(chunk)
        found = sum(map(self.automaton.count, words)), len(words)
        if len(chunk) > _LONGEST_REMEMBERED:
            return found
        if len(self._known) >= _REMEMBERED:
            self._known.clear()
        self._known[chunk] = found
        return found

    def count(self, text: str | None) -> tuple[int, int]:
        """Tokens and words of a whole text."""
        tokens = words = 0
        if text:
            known = self._known
            for chunk in unicodedata.normalize("NFC", text).lower().split():
                found = known.get(chunk) or self._chunk(chunk)
                tokens += found[0]
                words += found[1]
        return tokens, words


_counters: dict[str, WordPieces] = {}


def counter(path: str) -> WordPieces:
    if path not in _counters:
        _counters[path] = WordPieces(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", into: str = "counts") -> DataFrame:
    """Adds ``into``, a struct of ``n_tokens`` and ``n_words`` of each whole text."""

    @F.pandas_udf("n_tokens long, n_words long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = counter(path)
        for texts in batches:
            yield pd.DataFrame([pieces.count(t) for t in texts], columns=["n_tokens", "n_words"])

    return docs.withColumn(into, count(named(docs, text)))
