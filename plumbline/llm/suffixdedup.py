"""Removal of byte strings that an earlier document holds, by expanding suffix intervals.

Every byte covered by a string of ``MATCH`` bytes that also starts in a document with a
smaller ``doc_id`` is removed; strings are judged on the input.

1. Texts are laid out in blocks; a document longer than ``segment_bytes`` is cut into
   segments that overlap by a window less one byte, so that every window lies in one of them.
2. A window's anchor is the least hash of its ``ANCHOR``-byte strings. Equal windows have
   equal anchors, neighbouring windows mostly the same: a *piece* is a run of windows with
   one anchor. Blocks send the owners of the anchors sorted, packed hashes and learn which of
   them another block has too; windows whose anchor is in one document alone are done with.
3. The pieces that are left, equal ones of a block once, go to the shard of their anchor. A
   shard lays its distinct pieces, all that share an anchor, end to end, sorts the suffixes and takes the Burrows-Wheeler
   transform. Common prefixes of neighbouring rows come by increasing length: rows that start
   with byte c are, in order, the backward extensions by c of the rows that c precedes, so two
   neighbours part at length l + 1 where the rows they extend were parted at length l. Only
   neighbours not parted yet are looked at, and the search stops at ``MATCH``:
   what still hangs together are the equal strings of ``MATCH`` bytes.
4. The smallest document of each group goes back to the blocks, which remove what is covered.

An anchor in very many pieces (a line of a third of all documents, each time with other
neighbours) is dealt out window by window, by the hash of the whole window.

Defined results: null text is the empty one. A null ``doc_id`` counts as the largest number of
64 bits. Rows of equal ``doc_id`` are documents of which neither is smaller. A text shorter
than ``MATCH`` bytes stays whole. An empty table gives no rows. Columns besides the two that
are named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .bagminhash import mixed
from .common import named, stored

MATCH = 50
ANCHOR = 20


@dataclass(frozen=True)
class Limits:
    """How much one task holds; results do not depend on it."""

    segment_bytes: int = 1 << 19
    block_bytes: int = 16 << 20
    # Bytes of a block whose windows are hashed at once.
    hashed_bytes: int = 1 << 20
    # Anchors that one owner compares, and text whose pieces one shard takes.
    owner_anchors: int = 1 << 20
    shard_text: int = 4 << 20
    # Bytes of distinct pieces whose suffixes are sorted at once.
    sorted_bytes: int = 1 << 18
    # Pieces of one anchor beyond which its windows are dealt out one by one.
    hot_pieces: int = 1 << 14
    # Windows of one piece.
    longest_run: int = 512
    # What may be sent to every task, by measured size.
    broadcast_bytes: int = 48 << 20


_BITS = 48
_LAST = np.iinfo(np.int64).max
_NONE = 0xFF  # occurs in no UTF-8 text


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in few bytes: differences, in planes of equal significance, compressed."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(code: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(code), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` bytes, in a few passes over the data."""
    base, size = 0x9E3779B97F4A7C15, 1
    doubled = data.astype(np.uint64) + np.uint64(1)
    found, covered = None, 0
    while True:
        if width & size:
            if found is None:
                found, covered = doubled, size
            else:
                tail = doubled[covered:]
                found = found[: len(tail)] * np.uint64(pow(base, size, 1 << 64)) + tail
                covered += size
        if size * 2 > width:
            return mixed(found[: max(0, len(data) - width + 1)])
        doubled = doubled[:-size] * np.uint64(pow(base, size, 1 << 64)) + doubled[size:]
        size *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors_of(data: np.ndarray) -> np.ndarray:
    """The anchor of the window at every place: 48 bits, spread evenly again, as the least of
    many hashes are all small."""
    if len(data) < MATCH:
        return np.zeros(0, dtype=np.int64)
    least = sliding_least(string_hashes(data, ANCHOR), MATCH - ANCHOR + 1)
    return (mixed(least) >> np.uint64(64 - _BITS)).view(np.int64)


def dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by its leading bits."""
    return (keys >> 16) * parts >> 32


class _Block:
    """The texts of one block, and the pieces of their windows."""

    def __init__(self, row):
        self.number = row.block
        self.uids, self.offsets = unpack(row.uids), unpack(row.offsets)
        self.docs, self.totals = unpack(row.docs), unpack(row.totals)
        self.sizes = unpack(row.sizes)
        self.known = np.frombuffer(row.known, dtype=bool)
        self.data = np.frombuffer(zstandard.decompress(row.text), dtype=np.uint8)
        self.ends = np.cumsum(self.sizes)

    def segment_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def find_pieces(self, limits: Limits) -> None:
        """``at``, ``runs`` (windows) and ``keys`` of the pieces, in order of place."""
        at, runs, keys = [], [], []
        for begin in range(0, len(self.data), limits.hashed_bytes):
            stop = begin + limits.hashed_bytes
            least = anchors_of(self.data[begin : stop + MATCH - 1])
            if not len(least):
                continue
            places = np.arange(begin, begin + len(least))
            segment = self.segment_of(places[[0, -1]])
            own = np.arange(segment[0], segment[1] + 1)
            # Where each segment's windows and its last bytes without a window start.
            bounds = np.concatenate([self.ends[own] - self.sizes[own], self.ends[own] - MATCH + 1])
            cuts = np.zeros(len(least), dtype=bool)
            inside = (bounds > begin) & (bounds < begin + len(least))
            cuts[bounds[inside] - begin] = True
            cuts[0] = True
            cuts[1:] |= least[1:] != least[:-1]
            starts = np.flatnonzero(cuts)
            lengths = np.diff(np.append(starts, len(least)))
            whole = starts + begin + MATCH <= self.ends[self.segment_of(starts + begin)]
            starts, lengths = cut(starts[whole], lengths[whole], limits.longest_run)
            at.append(starts + begin)
            runs.append(lengths)
            keys.append(least[starts])
        none = [np.zeros(0, dtype=np.int64)]
        self.at, self.runs, self.keys = (np.concatenate(x + none) for x in (at, runs, keys))
        self.piece_docs = self.docs[self.segment_of(self.at)]

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, between how many different neighbours each has its pieces, and
        which occur in two documents. Equal pieces of a block count as one."""
        around = np.concatenate([[0], self.keys, [0]]).view(np.uint64)
        context = mixed(mixed(around[:-2] ^ self.runs.astype(np.uint64)) + around[2:]).view(np.int64)
        order = np.lexsort((context, self.keys))
        keys, docs, context = self.keys[order], self.piece_docs[order], context[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        fresh = first | np.concatenate([[True], context[1:] != context[:-1]])
        starts = np.flatnonzero(first)
        several = np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)
        return keys[starts], np.add.reduceat(fresh.astype(np.int64), starts), several


def cut(starts: np.ndarray, runs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into ones of at most ``most``."""
    parts = -(-runs // most)
    turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begun = np.repeat(starts, parts) + turn * most
    return begun, np.minimum(np.repeat(starts + runs, parts) - begun, most)


_BLOCK = (
    "block string, cut boolean, uids binary, offsets binary, docs binary, known binary, "
    "totals binary, sizes binary, text binary"
)


def _blocks(limits: Limits):
    """Lays texts out in blocks; segments of long documents have blocks of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        held = 0

        def block(cut_up: bool) -> pd.DataFrame:
            uids, docs, known, offsets, totals, texts = zip(*waiting)
            waiting.clear()
            return pd.DataFrame({
                "block": [f"{uids[0]}:{offsets[0]}"],
                "cut": [cut_up],
                "uids": [pack(np.array(uids))],
                "offsets": [pack(np.array(offsets))],
                "docs": [pack(np.array(docs))],
                "known": [np.array(known, dtype=bool).tobytes()],
                "totals": [pack(np.array(totals))],
                "sizes": [pack(np.array([len(t) for t in texts]))],
                "text": [zstandard.compress(b"".join(texts), 3)],
            })

        for frame in batches:
            for uid, doc, known, text in zip(frame["uid"], frame["doc"], frame["known"], frame["text"]):
                size = len(text)
                if size > limits.segment_bytes:
                    if waiting:
                        yield block(False)
                        held = 0
                    for offset in range(0, size, limits.segment_bytes):
                        part = text[offset : offset + limits.segment_bytes + MATCH - 1]
                        waiting.append((uid, doc, known, offset, size, part))
                        yield block(True)
                    continue
                waiting.append((uid, doc, known, 0, size, text))
                held += size + 64
                if held >= limits.block_bytes:
                    yield block(False)
                    held = 0
        if waiting:
            yield block(False)

    return run


_MESSAGE = "block string, owner long, keys binary, pieces binary"


def _messages(owners: int, limits: Limits):
    """The distinct anchors of each block, a message for every owner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                block = _Block(row)
                block.find_pieces(limits)
                if not len(block.keys):
                    continue
                keys, pieces, _ = block.distinct_keys()
                starts, ends, owner = _spans(dealt(keys, owners))
                yield pd.DataFrame({
                    "block": block.number,
                    "owner": owner,
                    "keys": [pack(keys[a:b]) for a, b in zip(starts, ends)],
                    "pieces": [pack(pieces[a:b]) for a, b in zip(starts, ends)],
                })

    return run


def _spans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value of every run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.append(starts[1:], len(values)), values[starts]


_ANSWER = "block string, owner long, elsewhere binary, hot binary"


def _answers(limits: Limits):
    """For each message, which of its anchors other blocks have, and which are hot."""

    def run(received: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack(x) for x in received["keys"]]
        pieces = np.concatenate([unpack(x) for x in received["pieces"]])
        ends = np.cumsum([len(x) for x in lists])[:-1]
        _, place, blocks = np.unique(
            np.concatenate(lists), return_inverse=True, return_counts=True
        )
        hot = np.bincount(place, weights=pieces) > limits.hot_pieces
        return pd.DataFrame({
            "block": received["block"].to_numpy(),
            "owner": received["owner"].to_numpy(),
            "elsewhere": [np.packbits(x).tobytes() for x in np.split(blocks[place] > 1, ends)],
            "hot": [pack(np.flatnonzero(x)) for x in np.split(hot[place], ends)],
        })

    return run


_PIECES = (
    "block string, shard long, runs binary, least binary, most binary, text binary, "
    "at binary, piece binary"
)


def _candidates(owners: int, shards: int, limits: Limits):
    """The pieces of each block that others may hold too, a message for every shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                found = _messages_of(row)
                if found is not None:
                    yield found

    def _messages_of(row) -> pd.DataFrame | None:
        block = _Block(row)
        block.find_pieces(limits)
        if not len(block.keys):
            return None
        keys, _, several = block.distinct_keys()
        starts, ends, owner = _spans(dealt(keys, owners))
        hot = np.zeros(len(keys), dtype=bool)
        answers = {a["owner"]: a for a in row.answers}
        for a, b, o in zip(starts.tolist(), ends.tolist(), owner.tolist()):
            bits = np.frombuffer(answers[o]["elsewhere"], dtype=np.uint8)
            several[a:b] |= np.unpackbits(bits, count=b - a).astype(bool)
            hot[a + unpack(answers[o]["hot"])] = True
        place = np.searchsorted(keys, block.keys)
        chosen, hot = several[place], (several & hot)[place]
        cold = chosen & ~hot
        at, runs, dealt_by = block.at[cold], block.runs[cold], block.keys[cold]
        if hot.any():
            single, ones = cut(block.at[hot], block.runs[hot], 1)
            windows = block.data[single[:, None] + np.arange(MATCH)].ravel()
            whole = string_hashes(windows, MATCH)[::MATCH] >> np.uint64(64 - _BITS)
            at, runs = np.concatenate([at, single]), np.concatenate([runs, ones])
            dealt_by = np.concatenate([dealt_by, whole.view(np.int64)])
        if not len(at):
            return None
        data = block.data.tobytes()
        numbers: dict[bytes, int] = {}
        piece = np.array(
            [numbers.setdefault(data[a : a + r + MATCH - 1], len(numbers))
             for a, r in zip(at.tolist(), runs.tolist())]
        )
        texts = list(numbers)
        first = np.zeros(len(texts), dtype=np.int64)
        first[piece[::-1]] = np.arange(len(piece))[::-1]
        docs = block.docs[block.segment_of(at)]
        least = np.full(len(texts), _LAST)
        most = np.full(len(texts), np.iinfo(np.int64).min)
        np.minimum.at(least, piece, docs)
        np.maximum.at(most, piece, docs)
        shard = dealt(dealt_by[first], shards)
        order = np.argsort(shard, kind="stable")
        number = np.empty(len(texts), dtype=np.int64)
        number[order] = np.arange(len(texts))
        starts, ends, names = _spans(shard[order])
        # Occurrences in the order of their pieces.
        by_piece = np.argsort(number[piece], kind="stable")
        occurs, occurs_at = number[piece][by_piece], at[by_piece]
        lists = np.searchsorted(occurs, np.append(starts, len(texts)))
        run_lengths = runs[first]
        out = []
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            mine = order[a:b]
            these = slice(lists[k], lists[k + 1])
            text = b"".join([texts[i] for i in mine.tolist()])
            out.append((
                block.number, int(names[k]), pack(run_lengths[mine]), pack(least[mine]),
                pack(most[mine]), zstandard.compress(text, 3), pack(occurs_at[these]),
                pack(occurs[these] - a),
            ))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places in the order of the 64 bytes that start there (equal ones in any order)."""
    n = len(text)
    packed = np.concatenate([text, np.full(72, _NONE, dtype=np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        packed = packed[:-width] << np.uint64(8 * width) | packed[width:]
    order = np.argsort(packed[:n])
    heads = np.concatenate([[True], packed[order[1:]] != packed[order[:-1]]])
    rank = np.full(n + 64, n, dtype=np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(heads, slots, 0))
    width = 8
    while width < 64:
        alone = heads & np.append(heads[1:], True)
        slots = np.flatnonzero(~alone)
        rows = order[slots]
        both = rank[rows] * (n + 1) + rank[rows + width]
        turn = np.argsort(both)
        rows, both = rows[turn], both[turn]
        order[slots] = rows
        begins = np.concatenate([[True], both[1:] != both[:-1]])[: len(slots)]
        heads[slots] = begins
        rank[rows] = np.maximum.accumulate(np.where(begins, slots, 0))
        width *= 2
    return order


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which rows of the sorted suffixes do not share their first ``length`` bytes with the
    row before, by breadth-first backward extension on the Burrows-Wheeler transform."""
    transform = text[order - 1]
    # The rows that byte c precedes, in order, give the rows that begin with c.
    extended = np.argsort(transform, kind="stable").astype(np.int32)
    first = text[order]
    parted = np.ones(len(text), dtype=bool)
    parted[1:] = first[1:] != first[:-1]
    waiting = np.flatnonzero(~parted).astype(np.int32)
    above, below = extended[waiting - 1], extended[waiting]
    for _ in range(1, length):
        interval = np.cumsum(parted, dtype=np.int32)
        now = interval[above] != interval[below]
        parted[waiting[now]] = True
        left = len(now) - np.count_nonzero(now)
        if 8 * left < 7 * len(now):  # rows parted before part again, which changes nothing
            waiting, above, below = waiting[~now], above[~now], below[~now]
    return parted


def _least_of_windows(texts: list[bytes], runs: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document of each window of each text: an array over all windows."""
    text = np.frombuffer(b"\xff".join([*texts, b""]), dtype=np.uint8)
    starts = np.cumsum(runs + MATCH) - (runs + MATCH)
    windows = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    by_place = np.full(len(text), _LAST)
    by_place[windows] = np.repeat(least, runs)
    order = suffix_order(text)
    heads = np.flatnonzero(equal_prefixes(text, order, MATCH))
    group_least = np.minimum.reduceat(by_place[order], heads)
    found = np.empty(len(text), dtype=np.int64)
    found[order] = np.repeat(group_least, np.diff(np.append(heads, len(text))))
    return found[windows]


_FOUND = (
    "block string, at binary, occurs binary, piece binary, start binary, stop binary, least binary"
)


def _expanded(limits: Limits):
    """For each message of a shard, the runs of windows that a smaller document holds."""

    def run(received: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        named_pieces, mosts, leasts, lengths = [], [], [], []
        for row in received.itertuples(index=False):
            text, runs = zstandard.decompress(row.text), unpack(row.runs)
            ends = np.cumsum(runs + MATCH - 1).tolist()
            begun = [0, *ends[:-1]]
            named_pieces.append(
                np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(begun, ends)])
            )
            leasts.append(unpack(row.least))
            mosts.append(unpack(row.most))
            lengths.append(runs)
        every = np.concatenate(named_pieces)
        runs = np.zeros(len(numbers), dtype=np.int64)
        runs[every] = np.concatenate(lengths)
        least = np.full(len(numbers), _LAST)
        np.minimum.at(least, every, np.concatenate(leasts))
        # Pieces of one anchor stay together when the shard is cut to bounded sorts. A piece
        # that shares its anchor with no other one can share no window: it is its own answer.
        texts = list(numbers)
        heads = np.frombuffer(b"".join([t[:MATCH] for t in texts]), dtype=np.uint8)
        anchor = anchors_of(heads)[::MATCH]
        order = np.argsort(anchor, kind="stable")
        begins = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
        alone = begins & np.append(begins[1:], True)
        single = order[alone]
        piece_of, start, stop, smallest = [single], [np.zeros_like(single)], [runs[single]], []
        smallest.append(least[single])
        order, begins = order[~alone], begins[~alone]
        batch = np.cumsum(runs[order] + MATCH) // limits.sorted_bytes
        # A batch starts with the first piece of an anchor.
        batch = batch[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        for a, b, _ in zip(*_spans(batch)) if len(order) else ():
            mine = order[a:b]
            found = _least_of_windows([texts[i] for i in mine.tolist()], runs[mine], least[mine])
            owner = np.repeat(np.arange(len(mine)), runs[mine])
            change = np.ones(len(found), dtype=bool)
            change[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
            begun = np.flatnonzero(change)
            first = np.cumsum(runs[mine]) - runs[mine]
            piece_of.append(mine[owner[begun]])
            start.append(begun - first[owner[begun]])
            stop.append(np.append(begun[1:], len(found)) - first[owner[begun]])
            smallest.append(found[begun])
        piece_of = np.concatenate(piece_of)
        by_piece = np.argsort(piece_of, kind="stable")
        piece_of = piece_of[by_piece]
        start, stop, smallest = (np.concatenate(x)[by_piece] for x in (start, stop, smallest))
        lists = np.searchsorted(piece_of, np.arange(len(numbers) + 1))
        out = []
        for row, pieces, most in zip(received.itertuples(index=False), named_pieces, mosts):
            counts = lists[pieces + 1] - lists[pieces]
            local = np.repeat(np.arange(len(pieces)), counts)
            runs_of = np.repeat(lists[pieces], counts) + (
                np.arange(len(local)) - np.repeat(np.cumsum(counts) - counts, counts)
            )
            smaller = smallest[runs_of] < most[local]
            if smaller.any():
                local, runs_of = local[smaller], runs_of[smaller]
                # The occurrences of the pieces concerned go back with them.
                at, occurs = unpack(row.at), unpack(row.piece)
                mine = np.isin(occurs, local)
                out.append((row.block, pack(at[mine]), pack(occurs[mine]), pack(local),
                            pack(start[runs_of]), pack(stop[runs_of]),
                            pack(smallest[runs_of])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _united(
    block: _Block, firsts: list[np.ndarray], lasts: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one; those of two texts stay apart."""
    if not firsts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts, ends = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    segment = block.segment_of(starts)
    apart = (starts[1:] > ends[:-1]) | (segment[1:] != segment[:-1])
    heads = np.flatnonzero(np.concatenate([[True], apart]))
    return starts[heads], np.append(ends[heads[1:] - 1], ends[-1])


_SEGMENT = (
    "uid long, doc long, known boolean, offset long, n_bytes long, starts array<long>, "
    "ends array<long>, text binary"
)


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments of each block with the bytes that are covered: start and end of each run,
    counted from the start of the document."""
    for frame in batches:
        for row in frame.itertuples(index=False):
            block = _Block(row)
            firsts, lasts = [], []
            for found in row.found if row.found is not None else ():
                at, piece = unpack(found["at"]), unpack(found["occurs"])
                local, start, stop, least = (
                    unpack(found[c]) for c in ("piece", "start", "stop", "least")
                )
                first = np.searchsorted(piece, local, side="left")
                counts = np.searchsorted(piece, local, side="right") - first
                run = np.repeat(np.arange(len(local)), counts)
                place = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(
                    len(run)
                )
                smaller = least[run] < block.docs[block.segment_of(at[place])]
                place, run = at[place[smaller]], run[smaller]
                firsts.append(place + start[run])
                lasts.append(place + stop[run] + MATCH - 1)
            starts, ends = _united(block, firsts, lasts)
            bounds = block.ends
            begun = bounds - block.sizes
            of = np.searchsorted(starts, begun), np.searchsorted(starts, bounds)
            data = block.data.tobytes()
            out = []
            for k, (a, b) in enumerate(zip(begun.tolist(), bounds.tolist())):
                mine = slice(of[0][k], of[1][k])
                shift = int(block.offsets[k]) - a
                out.append((
                    int(block.uids[k]), int(block.docs[k]), bool(block.known[k]),
                    int(block.offsets[k]), int(block.totals[k]), starts[mine] + shift,
                    ends[mine] + shift, data[a:b],
                ))
            for a in range(0, len(out), 2000):
                yield pd.DataFrame(
                    out[a : a + 2000], columns=[c.split()[0] for c in _SEGMENT.split(", ")]
                )


_RESULT = "doc long, known boolean, n_bytes long, spans array<struct<start long, length long>>, kept binary"


def _kept(segments: pd.DataFrame, segment_bytes: int) -> tuple:
    """One document from its segments: the spans that go and the bytes that stay."""
    segments = segments.sort_values("offset")
    starts = np.concatenate([np.asarray(x, dtype=np.int64) for x in segments["starts"]])
    ends = np.concatenate([np.asarray(x, dtype=np.int64) for x in segments["ends"]])
    text = b"".join(
        [t[:segment_bytes] for t in segments["text"].iloc[:-1]] + [segments["text"].iloc[-1]]
    )
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    if len(starts):
        new = np.concatenate([[True], starts[1:] > ends[:-1]])
        heads = np.flatnonzero(new)
        starts, ends = starts[heads], np.append(ends[heads[1:] - 1], ends[-1])
    parts, done = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        parts.append(text[done:a])
        done = b
    parts.append(text[done:])
    spans = [{"start": a, "length": b - a} for a, b in zip(starts.tolist(), ends.tolist())]
    head = segments.iloc[0]
    return int(head["doc"]), bool(head["known"]), int(head["n_bytes"]), spans, b"".join(parts)


def _one_document(limits: Limits):
    columns = ["doc", "known", "n_bytes", "spans", "kept"]
    return lambda rows: pd.DataFrame([_kept(rows, limits.segment_bytes)], columns=columns)


def _whole_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of one segment each."""
    for frame in _removed(batches):
        out = []
        for row in frame.itertuples(index=False):
            spans, parts, done = [], [], 0
            for a, b in zip(row.starts.tolist(), row.ends.tolist()):
                spans.append({"start": a, "length": b - a})
                parts.append(row.text[done:a])
                done = b
            parts.append(row.text[done:])
            out.append((row.doc, row.known, row.n_bytes, spans, b"".join(parts)))
        yield pd.DataFrame(out, columns=["doc", "known", "n_bytes", "spans", "kept"])


def _sent_if_small(table: DataFrame, size: Column, most: int) -> DataFrame:
    """A stored table, for broadcasting where its measured bytes are few."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= most else table


def without_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``spans`` (start and length in
    bytes of each maximal removed run) and ``kept``, the bytes that stay."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(named(docs, key).cast("long"), F.lit(_LAST)).alias("doc"),
        named(docs, key).isNotNull().alias("known"),
        F.coalesce(named(docs, text), F.lit("")).cast("binary").alias("text"),
        F.octet_length(F.coalesce(named(docs, text), F.lit(""))).alias("size"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = stored(rows.drop("size").mapInPandas(_blocks(limits), _BLOCK), "repeats-blocks")
    owners = total // (8 * limits.owner_anchors) + 1
    shards = total // limits.shard_text + 1

    messages = blocks.mapInPandas(_messages(owners, limits), _MESSAGE)
    answers = stored(
        messages.groupBy("owner")
        .applyInPandas(_answers(limits), _ANSWER)
        .groupBy("block")
        .agg(F.collect_list(F.struct("owner", "elsewhere", "hot")).alias("answers")),
        "repeats-answers",
    )
    weight = F.aggregate(
        "answers", F.lit(0), lambda n, a: n + F.octet_length(a["elsewhere"]) + 64
    )
    known = blocks.join(_sent_if_small(answers, weight, limits.broadcast_bytes), "block")
    pieces = known.mapInPandas(_candidates(owners, shards, limits), _PIECES)
    returned = stored(
        pieces.groupBy("shard")
        .applyInPandas(_expanded(limits), _FOUND)
        .groupBy("block")
        .agg(
            F.collect_list(F.struct("at", "occurs", "piece", "start", "stop", "least")).alias(
                "found"
            )
        ),
        "repeats-found",
    )
    weight = F.aggregate("found", F.lit(0), lambda n, f: n + F.octet_length(f["at"])
                         + F.octet_length(f["occurs"]) + 200)
    marked = blocks.join(_sent_if_small(returned, weight, limits.broadcast_bytes), "block", "left")
    whole = marked.filter(~F.col("cut")).mapInPandas(_whole_documents, _RESULT)
    long = (
        marked.filter("cut")
        .mapInPandas(_removed, _SEGMENT)
        .groupBy("uid")
        .applyInPandas(_one_document(limits), _RESULT)
    )
    return whole.union(long).select(
        F.when(F.col("known"), F.col("doc")).alias("doc_id"), "n_bytes", "spans", "kept"
    )
