"""Routing of equal byte windows to one shard: runs of windows with the same minimizer."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
#: Bytes that are hashed at a time; the arrays of a chunk stay in the cache.
CHUNK = 1 << 17
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers["up"] = np.cumprod(np.full(n, _B, np.uint64))
        _powers["down"] = np.cumprod(np.full(n, _B_INVERSE, np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] a hash of data[s:e], shifted by s (see ``span_hashes``)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * _power(len(prefix))[1][starts]


def gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-byte strings, which rank them."""
    return mixed((prefix[gram:] - prefix[:-gram]) * _power(len(prefix) - gram)[1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of ``length`` bytes whose minimizers are equal.

    The minimizer of a window is its ``gram``-byte string with the smallest hash,
    which depends on the window's bytes alone: equal windows, wherever they are,
    have equal minimizers. Returns (first, last, key, single): the first and last
    window start of each run, a 64-bit hash of the minimizer, and whether it
    occurs just once in the run's bytes (then no two windows of the run are equal).
    """
    n = len(data) - gram + 1
    h = gram_hashes(prefix_hashes(data), gram)
    place = np.arange(n, dtype=np.uint64)
    high = h & np.uint64(0xFFFFFFFF00000000)
    width = length - gram + 1
    left = (_sliding_min(high | place, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    right = np.uint64(0xFFFFFFFF) - (_sliding_min(high | (np.uint64(0xFFFFFFFF) - place), width) & np.uint64(0xFFFFFFFF))
    key = mixed(h[left])
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(key) - 1]])
    return first, last, key[first], left[first] == right[last].astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0] + 1, ... of spans, one span after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if total:
        ends = np.cumsum(lengths)
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
        np.cumsum(out, out=out)
    return out


def first_equal(key: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each span the row of the earliest span with the same bytes (itself, if none is earlier).

    Spans are grouped by hash and then compared byte by byte with the first of
    their group; one that differs from it stands for itself.
    """
    order = np.lexsort((start, doc, lengths, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (lengths[order[1:]] == lengths[order[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = np.empty(len(order), np.int64)
    first[order] = order[head]
    other = np.flatnonzero(first != np.arange(len(order)))
    if len(other):
        n = lengths[other]
        differs = data[ragged(offsets[other], n)] != data[ragged(offsets[first[other]], n)]
        wrong = np.add.reduceat(differs, np.concatenate([[0], np.cumsum(n)[:-1]])) > 0
        first[other[wrong]] = other[wrong]
    return first
