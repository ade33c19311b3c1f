"""Token ids of whole texts with a byte-level tokenizer file, as little-endian bytes.

The library's pre-tokenizer never joins what a space separates from a following word, so a
text is cut before each such space and the ids of its pieces are looked up; pieces not met
lately go through the library's own pre-tokenizer and model. The ids are those of encoding
the whole text at once (the tests compare them). A text that holds an added token of the file
is handed to the library whole; only ``Encoder.ids`` takes such strings for ordinary text.

Columns of texts are cut as one run of bytes, ``SLICE_BYTES`` at a time, and each different
piece of a slice is looked up once.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces remembered in each of two generations: some 200 bytes apiece, as no longer ones are.
_REMEMBERED = 200_000
_LONGEST_REMEMBERED = 64
_ODD_SPACES = re.compile(r" (?:\s|\Z)")
_CUTS = re.compile(r"(?= \S)")
# Where commas, full stops and line feeds all lie as in plain prose, texts are cut at them as
# well: a mark behind a letter or digit, or a line feed between others, starts a new word of
# the pre-tokenizer. A marked piece follows no space.
_MARK = "\x01"
_ODD_MARKS = re.compile(r"[,.](?<![^\W_][,.])")


def _symbol_table() -> dict[int, str]:
    """Printable Latin-1 characters stand for themselves, the other bytes for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = _symbol_table()
_SYMBOL_OF_BYTE = "".join(_SYMBOLS[b] for b in range(256))

# Bytes of texts that are looked up together, unless one text alone has more: the work on a
# slice takes some 15 times its bytes.
SLICE_BYTES = 2 << 20
# What a byte is for the pre-tokenizer, and behind which bytes a text is cut before it: a cut
# is where both have a bit in common, or a character beyond ASCII is to be looked at. Other
# control characters and white space are nothing that a text is cut at.
_BLANK, _SIGN, _LOOK = 1, 2, 128
_KIND, _BEHIND = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_KIND[list(b" \t\r\n")] = _BLANK | _LOOK
_KIND[list(string.punctuation.encode())] = _SIGN | _LOOK
_BEHIND[list(string.punctuation.encode())] = _BLANK
_BEHIND[list((string.ascii_letters + string.digits).encode())] = _BLANK | _SIGN
_BEHIND[128:] = _LOOK
_KIND, _BEHIND = _KIND.tobytes(), _BEHIND.tobytes()
# Bytes that begin no white space.
_NO_BLANK = np.zeros(256, bool)
_NO_BLANK[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
# Letters and digits beyond ASCII that every version of Unicode in use knows as such.
_WIDE_WORDS = np.array([c >= 128 and unicodedata.category(chr(c))[0] in "LN" for c in range(0x482)])
_WIDE_BLANKS = np.array([
    int.from_bytes(chr(c).encode()) for c in
    (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
])


def cuts(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Where the texts that lie end to end in ``data``, in UTF-8, begin and end, and places in
    them at which the pre-tokenizer starts a new word whatever follows, and goes on as at a
    text's beginning: white space behind other characters, signs behind letters and digits,
    and what follows a line feed between others."""
    codes = np.frombuffer(data, np.uint8)
    behind = np.frombuffer(data.translate(_BEHIND), np.uint8)[:-1]
    met = behind & np.frombuffer(data.translate(_KIND), np.uint8)[1:]
    places = np.flatnonzero(met != 0)
    wide = np.flatnonzero(met[places] == _LOOK)
    at = places[wide]
    last, lead = codes[at].astype(np.int64), codes[at - 1].astype(np.int64)
    two, three = lead << 8 | last, codes[at - 2].astype(np.int64) << 16 | lead << 8 | last
    point = np.where((lead >= 0xC2) & (lead < 0xE0), (lead & 31) << 6 | last & 63, 0)
    word = _WIDE_WORDS[np.where(point < len(_WIDE_WORDS), point, 0)]
    blank = np.isin(two, _WIDE_BLANKS) | np.isin(three, _WIDE_BLANKS)
    kept = np.ones(len(places), bool)
    kept[wide] = np.where(np.isin(codes[at + 1], list(b" \t\r\n")), ~blank, word)
    places = places[kept] + 1
    fed = places[codes[places] == ord("\n")] + 1
    fed = fed[fed < len(codes)]
    new = np.zeros(len(codes) + 1, bool)
    new[places] = True
    new[fed[_NO_BLANK[codes[fed]]]] = True
    new[bounds] = True
    return np.flatnonzero(new)


def byte_symbols(text: str) -> str:
    """One symbol per byte, as byte-level vocabularies write them."""
    if text.isascii() and text.isalnum():
        return text
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SYMBOLS)


class _Pieces(dict):
    """Ids by piece; what was not looked up in the last generation is forgotten.

    Where a word is followed by marks, or by a line feed and another word, the
    pre-tokenizer cuts too: such pieces are put together from remembered ones.
    """

    def __init__(self, encode, encode_word, bare: _Pieces | None = None):
        super().__init__()
        self.encode, self.encode_word, self.old = encode, encode_word, {}
        # The same for pieces that follow no space.
        self.bare = self if bare is None else bare

    def __missing__(self, piece: str) -> bytes:
        if piece[:1] == _MARK and self is not self.bare:
            rest = piece[1:]
            encode = self.bare.encode_word if rest.isalpha() else self.bare.encode
            if len(piece) > _LONGEST_REMEMBERED:
                return encode(rest)
            return self._remember(piece, self.old.get(piece) or encode(rest))
        if len(piece) > _LONGEST_REMEMBERED:
            return self.encode(piece)
        # The pre-tokenizer leaves a word of letters, with the space before it, as it is.
        if piece.isalpha():
            found = self.old.get(piece) or self.encode_word(piece)
        else:
            made = self._compound(piece)
            if made is not None:
                return made
            found = self.old.get(piece) or self.encode(piece)
        return self._remember(piece, found)

    def _remember(self, piece: str, found: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def _line_feed(self) -> bytes:
        found = self.get("\n")
        if found is None:
            found = self["\n"] = self.encode("\n")
        return found

    def _compound(self, piece: str) -> bytes | None:
        if "\n" in piece:
            lines = piece.split("\n")
            if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
                return None
            feed = self.bare._line_feed()
            return self[lines[0]] + b"".join(feed + self.bare[x] for x in lines[1:])
        if piece[-1].isalnum():
            return None
        word = piece.rstrip(string.punctuation)
        if len(word) == len(piece) or not word.isalpha():
            return None
        return self[word] + self.bare[piece[len(word) :]]


def _is_prose(text: str) -> bool:
    """No white space but single spaces and line feeds inside, no mark of ours (it cannot be
    printed), and commas and full stops only behind letters and digits."""
    return (
        text[0] not in " \n"
        and text[-1] not in " \n"
        and "  " not in text
        and "\n\n" not in text
        and " \n" not in text
        and "\n " not in text
        and text.replace("\n", "").isprintable()
        and not _ODD_MARKS.search(text)
    )


class Encoder:
    """Encodes with one tokenizer file; made once per worker by ``encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [token.content for token in added]
        # Added tokens that are looked for in normalized text can be there in another form.
        self._hidden = self._tokenizer.normalizer is not None and any(t.normalized for t in added)
        self._model, self._before = self._tokenizer.model, self._tokenizer.pre_tokenizer
        self._code = "HI"[self.dtype.itemsize > 2]
        self._first = _Pieces(self._encode, self._encode_word)
        self._later = _Pieces(self._encode_later, self._encode_later_word, self._first)
        # Pieces of columns by ``cuts``, in two generations as well.
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        words = self._before.pre_tokenize_str(piece)
        ids = [token.id for word, _ in words for token in self._model.tokenize(word)]
        return array(self._code, ids).tobytes()

    def _encode_later(self, piece: str) -> bytes:
        return self._encode(" " + piece)

    def _encode_symbols(self, symbols: str) -> bytes:
        return array(self._code, [token.id for token in self._model.tokenize(symbols)]).tobytes()

    def _encode_word(self, word: str) -> bytes:
        return self._encode_symbols(byte_symbols(word))

    def _encode_later_word(self, word: str) -> bytes:
        return self._encode_symbols(_SYMBOLS[32] + byte_symbols(word))

    def library_ids(self, text: str) -> bytes:
        """What the library's ``encode`` gives for a text, without special tokens around it."""
        if not self._hidden and not any(token in text for token in self._added):
            return self.ids(text)
        return self._library(text)

    def _library(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def library_ids_of(self, texts: pa.Array) -> Iterator[bytes]:
        """``library_ids`` of each text of a column, in their order; null is the empty text. No
        more than a slice of ``SLICE_BYTES``, or one longer text, is copied and worked on at a
        time."""
        if not len(texts):
            return
        if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = texts.cast(pa.large_string())
        if texts.null_count:  # the bytes below a null are anything
            texts = pc.fill_null(texts, "")
        if self._hidden:
            yield from (self._library(text.as_py()) for text in texts)
            return
        number = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], number)[texts.offset :][: len(texts) + 1]
        bounds = bounds.astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            end = int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1
            end = max(first + 1, end)
            part = data[bounds[first] : bounds[end]].tobytes()
            special = [token for token in self._added if token.encode() in part]
            for place, ids in enumerate(self._slice(part, bounds[first : end + 1] - bounds[first])):
                text = texts[first + place].as_py() if special else ""
                yield self._library(text) if any(token in text for token in special) else ids
            first = end

    def _slice(self, data: bytes, bounds: np.ndarray) -> Iterator[bytes]:
        """Ids of the texts that lie end to end in ``data``."""
        places = cuts(data, bounds)
        pieces = pa.Array.from_buffers(
            pa.large_string(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]
        ).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._look_up(different), pa.large_binary()).take(pieces.indices)
        sizes = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][: len(places)]
        ends = sizes[np.searchsorted(places, bounds)].tolist()
        all_ids = memoryview(ids.buffers()[2] or b"")
        del places, pieces, different, sizes
        for start, end in zip(ends, ends[1:]):
            yield all_ids[start:end].tobytes()

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces; one not met lately is encoded, and remembered if short."""
        found = list(map(self._known.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i in missing:
            found[i] = self._old.get(pieces[i])
        words = [i for i in missing if found[i] is None and pieces[i].removeprefix(" ").isalpha()]
        # The pre-tokenizer leaves a word of letters, with the space before it, as it is.
        symbols = [
            codecs.charmap_decode(pieces[i].encode(), "strict", _SYMBOL_OF_BYTE)[0] for i in words
        ]
        for i, ids in zip(words, map(self._encode_symbols, symbols)):
            found[i] = ids
        for i in missing:
            if found[i] is None:
                found[i] = self._encode(pieces[i])
            if len(pieces[i]) <= _LONGEST_REMEMBERED:
                if len(self._known) >= _REMEMBERED:
                    self._old, self._known = self._known, {}
                self._known[pieces[i]] = found[i]
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text in ``dtype``, one after the other; added tokens are plain text."""
        if not text:
            return b""
        if _is_prose(text):
            cut = text.replace("\n", f" {_MARK}\n {_MARK}")
            cut = cut.replace(",", f" {_MARK},").replace(".", f" {_MARK}.")
            head, *rest = cut.split(" ")
        elif _MARK in text:
            return self._encode(text)
        elif _ODD_SPACES.search(text):
            head, *rest = _CUTS.split(text)
            if text[0] == " " and not head and rest:
                head, rest = rest[0], rest[1:]
            rest = [piece[1:] for piece in rest]
        else:
            head, *rest = text.split(" ")
            if not head and rest:
                head, rest = " " + rest[0], rest[1:]
        return self._first[head] + b"".join(map(self._later.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file: its memory outlives the task."""
    known = _encoders.get(path)
    if known is None:
        known = _encoders[path] = Encoder(path)
    return known


_encoders: dict[str, Encoder] = {}
