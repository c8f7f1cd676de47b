"""Content-defined anchors: for every 100-byte string of a text the leftmost least 32-gram in it, chosen by the string's bytes alone."""

from __future__ import annotations

import numpy as np

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
GRAM = 32
_PLACE = 24  # bits of a key that hold its place


def words64(buffer: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each of the first ``n`` places as a number."""
    return np.ndarray((n,), "<u8", buffer, 0, (1,)).copy()


def gram_hashes(buffer: bytes) -> np.ndarray:
    n = len(buffer) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = words64(buffer, n + GRAM - 8)
    x ^= x >> np.uint64(31)
    x *= _M[0]
    h = x[:n] * _M[1]
    h ^= h >> np.uint64(29)
    for k in (8, 16, 24):
        h += x[k : k + n]
        h *= _M[2]
        h ^= h >> np.uint64(30)
    h *= _M[3]
    h ^= h >> np.uint64(32)
    return h


def find_anchors(buffer: bytes, ends: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its gram's hash, first and last start of the strings that it stands for) in a buffer of texts that end at ``ends``.

    The buffer must be shorter than 2^24 bytes. Strings don't cross the ends of texts.
    """
    h = gram_hashes(buffer)
    width = length - GRAM + 1
    n = len(h) - width + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, np.zeros(0, np.uint64), e, e
    key = (h >> np.uint64(_PLACE)) << np.uint64(_PLACE)
    key |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[: n], key[width - span : width - span + n])
    place = (key[:n] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends:
        inside[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(inside)
    place = place[starts]
    if not len(place):
        e = np.zeros(0, np.int64)
        return e, np.zeros(0, np.uint64), e, e
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    a = place[first]
    return a, h[a], starts[first], starts[last]
