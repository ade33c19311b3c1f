"""BagMinHash signatures of multisets.

Every element runs Poisson processes over its discretised weights: one of rate ``2 ** (j-1)``
on each octave ``[2 ** (j-1), 2 ** j)`` of weights and one of rate 1 on ``[0, 1)``. A point
has a time, a weight within the octave and a register; it counts where its weight is below
the element's. The octaves and the leading digits of a point's weight are the levels of the
hierarchy: whole octaves above a weight are never begun. A register keeps the time of its
first point, so two multisets agree in a register with a probability equal to their weighted
Jaccard similarity, sum of minima over sum of maxima.

Only points up to a time that fills all registers are made: some ``m log m`` of them, however
many elements there are, besides one first point per process.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

SHINGLE = 5

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_U30, _U27, _U31, _U11 = (np.uint64(x) for x in (30, 27, 31, 11))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each number."""
    x = x + _A
    x = (x ^ (x >> _U30)) * _B
    x = (x ^ (x >> _U27)) * _C
    return x ^ (x >> _U31)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> _U11).astype(np.float64) + 0.5) / float(1 << 53)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of characters other than white space."""
    return text.lower().split() if text else []


def content_key(words: list[str]) -> bytes:
    """Equal for two texts exactly when their words are (128 bits)."""
    return xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def shingles(words: list[str]) -> np.ndarray:
    """Sorted hashes of all runs of five words, repeats included; a shorter text has one
    shingle of all its words, a text without words has none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(
        (xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words),
        np.uint64,
        len(words),
    )
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    joined = np.full(count, np.uint64(width))
    for k in range(width):
        joined = mixed(joined ^ hashes[k : k + count])
    return np.sort(joined)


def counted(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[starts], np.diff(np.append(starts, len(sorted_values)))


def signatures(
    elements: np.ndarray, counts: np.ndarray, owners: np.ndarray, sets: int, registers: int
) -> np.ndarray:
    """The first points of many multisets at once: one row of registers each, as 64 bits.

    ``owners`` numbers the set of each element, from 0; every set has an element.
    """
    first = np.full((sets, registers), np.inf)
    weights = np.bincount(owners, weights=counts, minlength=sets)
    until = registers * (np.log(registers) + 3.0) / np.maximum(weights, 1.0)
    while True:
        _add_points(first, elements, counts, owners, until)
        unfilled = ~np.isfinite(first).all(axis=1)
        if not unfilled.any():
            return first.view(np.uint64)
        until = np.where(unfilled, until * 2.0, until)
        again = unfilled[owners]
        elements, counts, owners = elements[again], counts[again], owners[again]


def _add_points(
    first: np.ndarray,
    elements: np.ndarray,
    counts: np.ndarray,
    owners: np.ndarray,
    until: np.ndarray,
) -> None:
    registers = np.uint64(first.shape[1])
    flat = first.reshape(-1)
    top = int(counts.max())
    octave, lower, upper = 0, 0, 1
    while lower < top:
        chosen = counts > lower
        weights, sets = counts[chosen], owners[chosen]
        seeds = mixed(elements[chosen] ^ mixed(np.array([octave], dtype=np.uint64)))
        times, limits = np.zeros(len(seeds)), until[sets]
        rate = float(upper - lower)
        while len(seeds):
            times = times - np.log(unit(seeds)) / rate
            alive = np.flatnonzero(times <= limits)
            seeds, times, limits = seeds[alive], times[alive], limits[alive]
            weights, sets = weights[alive], sets[alive]
            marks = mixed(seeds)
            if upper - lower == 1:  # such an octave is counted whole
                below, of, at = marks, sets, times
            else:
                counting = lower + rate * unit(marks) < weights
                below, of, at = marks[counting], sets[counting], times[counting]
            where = of * int(registers) + (mixed(below) % registers).astype(np.int64)
            np.minimum.at(flat, where, at)
            seeds = mixed(marks ^ _B)
        octave, lower, upper = octave + 1, upper, upper * 2


def band_keys(first: np.ndarray, bands: int) -> np.ndarray:
    """For each row of registers one hash per band, unequal between bands, as signed longs."""
    grid = first.reshape(len(first), bands, -1)
    keys = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(first), 1))
    for k in range(grid.shape[2]):
        keys = mixed(keys ^ grid[:, :, k])
    return keys.view(np.int64)


def tagged(sorted_values: np.ndarray) -> np.ndarray:
    """Sorted values made distinct: the second, third, ... of equal ones get hashes of their
    own. Two multisets overlap as much as the sets of their tagged values."""
    if not len(sorted_values):
        return sorted_values
    values, counts = counted(sorted_values)
    turns = np.arange(len(sorted_values)) - np.repeat(np.cumsum(counts) - counts, counts)
    again = mixed(sorted_values ^ mixed(turns.astype(np.uint64)))
    return np.where(turns == 0, sorted_values, again)
