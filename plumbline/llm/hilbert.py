"""Positions on a Hilbert curve, for whole arrays of points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The curve index of each row of ``points`` (unsigned cell numbers below 2 ** bits).

    The coordinates are first turned, from the top bit down, into the frame of the cell that
    holds them, then Gray-coded; reading their bits plane by plane gives the index. It needs
    ``dimensions * bits <= 63``.
    """
    cells = np.array(points, dtype=np.int64, copy=True)
    rows, dims = cells.shape
    if dims * bits > 63:
        raise ValueError("A curve index has 63 bits at most")
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(dims):
            upper = (cells[:, d] >> level) & 1 == 1
            # In the upper half the first axis is mirrored, in the lower the two are exchanged.
            swap = np.where(upper, 0, (cells[:, 0] ^ cells[:, d]) & below)
            cells[:, 0] ^= np.where(upper, below, swap)
            cells[:, d] ^= swap
    for d in range(1, dims):
        cells[:, d] ^= cells[:, d - 1]
    flips = np.zeros(rows, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((cells[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    cells ^= flips[:, None]
    keys = np.zeros(rows, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            keys = (keys << 1) | ((cells[:, d] >> level) & 1)
    return keys
