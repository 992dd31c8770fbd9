"""Anchors of a byte string: places that equal windows choose alike.

Every ``width``-byte window chooses, among the ``gram``-byte strings inside it,
the one of least hash (the last of equal ones). The choice depends on nothing
but the window's bytes, so equal windows have equal anchors at equal offsets,
and windows need to be compared only with windows of an equal anchor. Windows
that follow each other mostly share their anchor, so there is about one anchor
for every half window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GRAM = 32
#: Windows handled at once; also keeps places below the 24 bits they have in a key.
SPAN = 1 << 22
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Anchors:
    """Parallel arrays: place of the anchor, first and last window that chose it, hash of its gram."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_UP, _DOWN = _powers(_PRIME, 1 << 12), _powers(_INVERSE, 1 << 12)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_PRIME, size), _powers(_INVERSE, size)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes: a polynomial modulo 2^64, mixed."""
    n = len(data)
    _grow(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` keys in a row, from running minima of blocks."""
    n = len(keys)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, width: int, gram: int = GRAM) -> Anchors:
    """Anchors of all windows of ``data`` (uint8); none if it is shorter than a window."""
    parts = []
    for lo in range(0, max(0, len(data) - width + 1), SPAN):
        piece = data[lo : lo + SPAN + width - 1]
        h = gram_hashes(piece, gram)
        place = np.arange(len(h), dtype=np.uint64)
        last_first = np.uint64((1 << 24) - 1) - place
        chosen = _least((h >> np.uint64(24) << np.uint64(24)) | last_first, width - gram + 1)
        at = ((1 << 24) - 1) - (chosen & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.concatenate([starts[1:], [len(at)]]) - 1
        parts.append((at[starts] + lo, starts + lo, ends + lo, h[at[starts]]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))
