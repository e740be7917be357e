"""Suffix sorting by recursive induction with a disk-backed bucket queue that carries common prefixes."""

from __future__ import annotations

import os
import tempfile
import weakref
from collections import Counter, defaultdict

import numpy as np

#: Texts of names up to this length are sorted by prefix doubling, which ends the recursion.
BASE = 1 << 20
#: How often a process has sorted by induction, and how many bytes its queues have spilled.
done: Counter = Counter()


class Scratch:
    """Arrays in memory up to a budget of bytes, beyond it in files of a temporary folder. Both are let go with the array."""

    def __init__(self, budget: int):
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.budget, self.used, self.made = budget, 0, 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.folder.cleanup()

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.folder.name, str(self.made))

    def _free(self, size: int) -> None:
        self.used -= size

    def array(self, n: int, dtype=np.int64) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if n and self.used + size > self.budget:
            out = np.memmap(path := self.path(), dtype, "w+", shape=(n,))
            os.remove(path)  # the mapping keeps the bytes
            return out
        out = np.empty(n, dtype)
        self.used += size
        weakref.finalize(out, self._free, size)
        return out


class BucketQueue:
    """Priority queue of (key, position, common prefix) whose pops never fall back: buckets of keys, spilled to files.

    The common prefix is that with the tuple of the same key pushed before. Tuples
    of one bucket stay in the order of their pushes; ``pop`` empties a bucket.
    """

    def __init__(self, top: int, buckets: int, scratch: Scratch, budget: int):
        self.width = -(-(top + 1) // buckets)
        self.count = -(-(top + 1) // self.width)
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        self.files: dict[int, str] = {}
        self.scratch, self.budget, self.held = scratch, budget, 0

    def push(self, *tuples: np.ndarray) -> None:
        if not len(tuples[0]):
            return
        buckets = tuples[0] // self.width
        if len(buckets) > 1:
            order = np.argsort(buckets, kind="stable")
            buckets, tuples = buckets[order], tuple(c[order] for c in tuples)
        cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            self.parts[int(buckets[low])].append(tuple(c[low:high] for c in tuples))
        self.held += 24 * len(buckets)
        if self.held > self.budget:
            done["spilled"] += self.held
            for at, own in self.parts.items():
                with open(self.files.setdefault(at, self.scratch.path()), "ab") as f:
                    for part in own:
                        f.write(np.stack(part, 1).astype(np.int64).tobytes())
            self.parts.clear()
            self.held = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, ...]:
        own = self.parts.pop(bucket, [])
        self.held -= sum(24 * len(part[0]) for part in own)
        if bucket in self.files:
            rows = np.fromfile(name := self.files.pop(bucket), np.int64).reshape(-1, 3)
            own.insert(0, tuple(rows.T))
            os.remove(name)
        return tuple(np.concatenate(c) for c in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 3


class Minima:
    """Minima over ranges of values that are appended: row k holds the least of the 2 ** k values that end at each place."""

    def __init__(self, n: int, limit: int, scratch: Scratch):
        self.rows = scratch.array(n.bit_length() * n, np.uint8 if limit < 256 else np.int64).reshape(n.bit_length(), n)
        self.n = 0

    def append(self, values: np.ndarray) -> None:
        low, self.n = self.n, self.n + len(values)
        self.rows[0, low : self.n] = values
        for k in range(1, len(self.rows)):
            half = 1 << (k - 1)
            at = max(low, 2 * half - 1)
            if at >= self.n:
                break
            self.rows[k, at : self.n] = np.minimum(self.rows[k - 1, at : self.n], self.rows[k - 1, at - half : self.n - half])

    def least(self, after: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value behind place ``after`` up to place ``last``."""
        k = np.frexp((last - after).astype(np.float64))[1] - 1
        return np.minimum(self.rows[k, last], self.rows[k, after + (1 << k)]).astype(np.int64)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, cut at ``limit``."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for k in range(limit):
        left = left[np.maximum(a[left], b[left]) + k < len(text)]
        left = left[text[a[left] + k] == text[b[left] + k]]
        if not len(left):
            break
        out[left] = k + 1
    return out


def _seam(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of suffixes of unlike types with one first symbol: the shorter of their runs of it."""
    return np.minimum(*(_common(text, x, x + 1, limit - 1) + 1 for x in (a, b)))


def _induce(text: np.ndarray, made: np.ndarray, seeds: np.ndarray, prefix: np.ndarray | None, first: int | None, scratch: Scratch, limit: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sort the suffixes that ``made`` marks, given the others that induce them in order; also their common prefixes.

    A tuple is (symbol and kind, position, common prefix with the tuple before).
    Tuples leave the queue from small to large, and each lets in the tuple of the
    suffix one place before it. Its common prefix is one more than the least among
    the tuples that left since the last one that let in the same symbol. As many
    leave together as cannot be preceded by any that they let in. ``prefix`` has
    the common prefixes of neighbouring seeds; without it (seeds that are not
    sorted yet have none) none are carried.
    """
    done["inductions"] += 1
    none = np.iinfo(np.int64).max
    top = 2 * int(text.max()) + 1
    buckets = top + 1 if top < 1024 else min(top + 1, max(256, int(len(text) ** 0.5)))
    queue = BucketQueue(top, buckets, scratch, scratch.budget // 4)
    carry, n_made = prefix is not None, int(np.count_nonzero(made))
    minima = Minima(len(seeds) + n_made if carry else 0, limit, scratch)
    let_in = np.full(top // 2 + 1, -2)  # the place of the tuple that last let in each symbol; -1 is the text's end
    if first is not None:
        queue.push(np.array([2 * int(text[first])]), np.array([first]), np.array([0]))
        let_in[int(text[first])] = -1
    for k in range(0, len(seeds), 1 << 20):
        part = np.asarray(seeds[k : k + (1 << 20)])
        queue.push(2 * text[part].astype(np.int64) + 1, part, np.asarray(prefix[k : k + (1 << 20)]) if carry else np.zeros(len(part), np.int64))
    out, shared, found = scratch.array(n_made), scratch.array(n_made if carry else 0, np.uint8 if limit < 256 else np.int64), 0
    before_key, before_item, before_made = -1, 0, -1
    for bucket in range(queue.count):
        keys, items, common = queue.pop(bucket)
        last = (bucket + 1) * queue.width - 1
        while len(keys):
            if (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys, kind="stable")
                keys, items, common = keys[order], items[order], common[order]
            before = items - 1  # -1 reads the last symbol, and is masked
            lets = (items > 0) & made[before]
            new = np.where(lets, 2 * text[before].astype(np.int64), none)
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            safe = np.minimum.accumulate(new)[ends - 1] >= keys[ends - 1]
            n = int(ends[np.count_nonzero(safe) - 1])
            made_here = keys[:n] % 2 == 0
            if not carry:
                own = items[:n][made_here]
                out[found : found + len(own)] = own
                found += len(own)
                lets = np.flatnonzero(lets[:n])
                new, before = new[lets], before[lets]
                carried = np.zeros(len(lets), np.int64)
            else:
                # Where the key changes, the carried value says nothing: 0, or the seam of the two kinds of one symbol.
                own = common[:n].copy()
                change = ends[: np.searchsorted(ends, n)]
                own[change] = 0
                seam = change[(keys[change] % 2 == 1) & (keys[change - 1] == keys[change] - 1)]
                if len(seam):
                    own[seam] = _seam(text, items[seam - 1], items[seam], limit)
                if keys[0] != before_key:
                    own[0] = _seam(text, np.array([before_item]), items[:1], limit)[0] if keys[0] % 2 == 1 and before_key == keys[0] - 1 else 0
                before_key, before_item = int(keys[n - 1]), int(items[n - 1])
                start = minima.n
                minima.append(own)
                hit = np.flatnonzero(made_here)
                if len(hit):
                    places = start + hit
                    since = np.empty_like(places)
                    since[0], since[1:], before_made = before_made, places[:-1], int(places[-1])
                    out[found : found + len(hit)] = items[hit]
                    shared[found : found + len(hit)] = minima.least(since, places) if since[0] >= 0 else np.append(0, minima.least(since[1:], places[1:]))
                    found += len(hit)
                lets = np.flatnonzero(lets[:n])
                new, before = new[lets], before[lets]
                carried = np.empty(len(lets), np.int64)
                if len(lets):
                    order = np.argsort(new, kind="stable")
                    symbol, places = new[order] >> 1, start + lets[order]
                    begin = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
                    begin = np.concatenate([[0], begin])
                    since = np.empty_like(places)
                    since[1:] = places[:-1]
                    since[begin] = let_in[symbol[begin]]
                    let_in[symbol[begin]] = places[np.concatenate([begin[1:] - 1, [len(places) - 1]])]
                    carried[order] = np.where(since < 0, since + 2, np.minimum(limit, 1 + minima.least(np.maximum(since, -1), places)))
            here = new <= last
            queue.push(new[~here], before[~here], carried[~here])
            keys, items, common = (np.concatenate([old[n:], own[here]]) for old, own in ((keys, new), (items, before), (common, carried)))
    return out[:found], shared[:found] if carry else None


def _doubling(text: np.ndarray, need: int) -> np.ndarray:
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    n, k = len(rank), 1
    if n < 2 or need < 2:
        return np.argsort(rank, kind="stable")
    while True:
        both = rank * (n + 1)
        both[:-k] += rank[k:]
        order = np.argsort(both)
        both = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, both[1:] != both[:-1]))
        k *= 2
        if rank[order[-1]] == n or k >= min(n, need):
            return order


def _before(prefix: np.ndarray | None) -> np.ndarray | None:
    """Common prefixes with the one before in reverse order."""
    return None if prefix is None else np.append(prefix[:1] * 0, prefix[:0:-1])


def suffix_array(text: np.ndarray, scratch: Scratch, need: int | None = None, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes of a text of small non-negative integers, in order, and the common prefix of each with the one before.

    With ``need`` they are in order of their first ``need`` symbols at least, and
    common prefixes are cut there. A name stands for two symbols or more, so each
    level needs half as many.

    A suffix is of type S if it is smaller than the next one, else of type L. The
    leftmost S suffixes are sorted first: induction over unsorted ones sorts the
    strings between them, equal strings get equal names, and the text of the names
    is sorted in turn. Common prefixes of names come back from there; they tell how
    far leftmost S suffixes agree, up to their first unlike strings, which are
    compared. Two more inductions then sort all L and all S suffixes and carry the
    common prefixes on.
    """
    n, need = len(text), min(need or len(text), len(text))
    if n < 3 or level and n <= BASE:
        order = _doubling(text, need)
        return order, np.append([0] * min(n, 1), _common(text, order[:-1], order[1:], need)).astype(np.int64)
    step = np.sign(text[1:].astype(np.int64) - text[:-1]).astype(np.int8)
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = np.append(np.append(step, np.int8(-1))[where] > 0, False)
    large = ~small
    least = np.flatnonzero(small[1:] & large[:-1]) + 1
    turned = int(text.max()) - text
    del step, where

    def induced(seeds: np.ndarray, prefix: np.ndarray | None) -> tuple[np.ndarray | None, ...]:
        up, common = _induce(text, large, seeds, prefix, n - 1, scratch, need)
        down, below = _induce(turned, small, up[::-1], _before(common), None, scratch, need)
        return up, common, down[::-1], _before(below)

    order, prefix = least, np.zeros(len(least), np.int64)
    if len(least) > 1:
        mark = np.zeros(n, bool)
        mark[least] = True
        down = induced(least, None)[2]
        order = down[mark[down]]
        at = np.searchsorted(least, order)
        size = (np.append(least[1:], n - 1) - least + 1)[at]
        changed = size[1:] != size[:-1]
        changed |= (at[1:] == len(least) - 1) | (at[:-1] == len(least) - 1)  # the text's end makes the last string unique
        equal = np.flatnonzero(~changed)
        if len(equal):
            changed[equal] = _common(text, order[equal], order[equal + 1], int(size[equal].max())) < size[equal]
        names = np.append([0], np.cumsum(changed))
        agreed = np.zeros(len(order), np.int64)
        if names[-1] + 1 < len(least):
            reduced = np.empty(len(least), np.int64)
            reduced[at] = names
            at, agreed = suffix_array(reduced, scratch, need // 2 + 1, level + 1)
            order = least[at]
        # Where this many names agree, so do the symbols up to the next string.
        reach = np.minimum(need, np.append(least, n)[np.minimum(at + agreed, len(least))] - order)
        rest = np.flatnonzero(reach[1:] < need) + 1
        prefix = np.append(0, reach[1:])
        prefix[rest] += _common(text, order[rest] + reach[rest], order[rest - 1] + reach[rest], need)
        prefix = np.minimum(prefix, need)
    up, common, down, below = induced(order, prefix)
    both, shared = np.concatenate([up, down]), np.concatenate([common, below]).astype(np.int64)
    key = 2 * text[both].astype(np.int64) + small[both]
    order = np.argsort(key, kind="stable")
    both, shared, key = both[order], shared[order], key[order]
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    shared[change] = 0
    seam = change[key[change] // 2 == key[change - 1] // 2]
    shared[seam] = _seam(text, both[seam - 1], both[seam], need)
    if n:
        shared[0] = 0
    return both, shared
