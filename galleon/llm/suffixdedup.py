"""Removal of repeated byte strings: suffix sorting in shards that equal windows share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import payload, same, small_batches, stored
from galleon.llm.suffixes import Scratch, suffix_array
from galleon.llm.windows import CHUNK, first_equal, gram_hashes, mixed, prefix_hashes, ragged, span_hashes, window_runs

#: Bytes of the string whose smallest hash routes a window.
GRAM = 16
#: Bytes of texts that a map task looks at together.
BATCH = 8 << 20
#: Windows of crowded minimizers that a map task looks at together.
SPLIT = 1 << 18
#: Pieces of texts that are looked at for crowded minimizers, and one in how many at most is.
PIECE, EVERY = 8192, 64


class Runs:
    """Runs of windows: document, first window's start, bytes, routing key, and whether no two of its windows are equal."""

    def __init__(self, doc, start, size, key, single, data):
        self.doc, self.start, self.size, self.key, self.single, self.data = doc, start, size, key, single, data

    def pack(self) -> bytes:
        head = zstandard.ZstdCompressor(3).compress(b"".join([np.diff(self.doc, prepend=0).astype("<i8").tobytes(), self.start.astype("<i8").tobytes(), self.size.astype("<i4").tobytes(), self.single.astype(np.uint8).tobytes()]))
        body = zstandard.ZstdCompressor(3).compress(self.data.tobytes())
        return b"".join([np.array([len(self.doc), len(head)], "<i4").tobytes(), head, self.key.astype("<u4").tobytes(), body])

    @staticmethod
    def unpack(blob: bytes) -> Runs:
        n, size = np.frombuffer(blob, "<i4", 2).tolist()
        unpack = zstandard.ZstdDecompressor().decompress
        head = unpack(blob[8 : 8 + size])
        key = np.frombuffer(blob, "<u4", n, 8 + size)
        doc, start = np.frombuffer(head, "<i8", n), np.frombuffer(head, "<i8", n, 8 * n)
        return Runs(np.cumsum(doc), start, np.frombuffer(head, "<i4", n, 16 * n).astype(np.int64), key, np.frombuffer(head, np.uint8, n, 20 * n).astype(bool), np.frombuffer(unpack(blob[8 + size + 4 * n :]), np.uint8))

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("doc", "start", "size", "key", "single", "data")))


def _hashes(data: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans that lie in order and may overlap."""
    out = np.zeros(len(offset), np.uint64)
    low = 0
    while low < len(offset):
        high = max(low + 1, int(np.searchsorted(offset, offset[low] + CHUNK)))
        base, end = int(offset[low]), int((offset[low:high] + size[low:high]).max())
        out[low:high] = mixed(span_hashes(prefix_hashes(data[base:end]), offset[low:high] - base, offset[low:high] - base + size[low:high]))
        low = high
    return out


def _merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans that touch or overlap in one document; the ends may come in any order."""
    order = np.lexsort((high, low, doc))
    doc, low, high = doc[order], low[order], high[order]
    if not len(doc):
        return doc, low, high
    # Ends are made comparable over documents by ranking the documents.
    rank = np.cumsum(np.append([0], doc[1:] != doc[:-1])).astype(np.int64)
    span = int(high.max()) + 1
    reach = np.maximum.accumulate(rank * span + high)
    new = np.append([True], (rank[1:] * span + low[1:] > reach[:-1]) | (rank[1:] != rank[:-1]))
    at = np.flatnonzero(new)
    return doc[at], low[at], (reach - rank * span)[np.append(at[1:] - 1, len(doc) - 1)]


def _removals(doc: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the rows whose bytes occur earlier. A repeated row is no earlier place."""
    gone = (doc[first] != doc) | (start[first] != start)
    return _merged(doc[gone], start[gone], start[gone] + size[gone])


def _partnered(runs: Runs, rows: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Those of ``rows`` that can have a window which another one or themselves have again; ``offset`` are places of all runs.

    A window lies around its minimizer: of what it has besides, half at least is on
    one side. So equal windows agree in the minimizer with so many bytes before it,
    or with so many behind it, and runs whose strings of both kinds no other run has
    are left out. Where a minimizer stands twice in some run it has no such place,
    and all runs of that key stay.
    """
    keys, inverse, often = np.unique(runs.key[rows], return_inverse=True, return_counts=True)
    twice = np.zeros(len(keys), bool)
    twice[inverse[~runs.single[rows]]] = True
    side = (length - GRAM + 1) // 2
    stays = twice[inverse]
    at = np.flatnonzero((often[inverse] > 1) & ~stays)
    if not len(at):
        return rows[stays]
    size = runs.size[rows[at]]
    data = runs.data[ragged(offset[rows[at]], size)]
    begin = np.cumsum(size) - size
    sides: list[list[np.ndarray]] = [[], []]
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + CHUNK)))
        base, own = int(begin[low]), at[low:high]
        start, end = begin[low:high] - base, begin[low:high] - base + size[low:high]
        prefix = prefix_hashes(data[base : base + int(end[-1])])
        # All windows of a run have the places from its last window's start to its first window's last string in common.
        rank = gram_hashes(prefix, GRAM) & np.uint64(0xFFFFFFFF00000000) | np.arange(int(end[-1]) - GRAM + 1, dtype=np.uint64)
        least = np.minimum.reduceat(rank, np.stack([end - length, start + length - GRAM], 1).ravel())[::2]
        middle = (np.minimum(least, rank[start + length - GRAM]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for out, first, last in ((sides[0], middle - side, middle + GRAM), (sides[1], middle, middle + GRAM + side)):
            has = np.flatnonzero((first >= start) & (last <= end))
            out.append(np.stack([own[has].astype(np.uint64), mixed(span_hashes(prefix, first[has], last[has]))]))
        low = high
    for parts in sides:
        own, h = np.concatenate(parts, 1)
        _, inverse, often = np.unique(h, return_inverse=True, return_counts=True)
        stays[own[often[inverse] > 1].astype(np.int64)] = True
    return rows[stays]


def repeated_in_shard(runs: Runs, length: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, low, high) of the windows of a shard that also start earlier in it.

    Runs with equal bytes are settled first: all but the earliest go. Of the rest
    only some can have equal windows (see ``_partnered``), as most runs share no
    more than their minimizer. All bytes of those are written one run after another
    and their suffixes are sorted; windows whose common prefix with their
    neighbour, as the sort carries it, reaches ``length`` are equal.
    """
    offset = np.cumsum(runs.size) - runs.size
    first = first_equal(_hashes(runs.data, offset, runs.size), runs.size, offset, runs.doc, runs.start, runs.data)
    spans = [_removals(runs.doc, runs.start, runs.size, first)]
    left = np.flatnonzero(first == np.arange(len(first)))
    left = _partnered(runs, left, offset, length)
    if len(left):
        size = runs.size[left]
        text = np.zeros(int(size.sum()) + len(size), np.int16)
        shift = np.arange(len(size)) + np.cumsum(size) - size  # a zero follows each run
        text[ragged(shift, size)] = runs.data[ragged(offset[left], size)].astype(np.int16) + 1
        with Scratch(budget) as scratch:
            found, prefix = suffix_array(text, scratch, length)
        owner = np.repeat(np.arange(len(size)), size + 1)
        # Suffixes that start no window fall away; what is left agrees as far as all between them did.
        kept = np.flatnonzero(found <= (shift + size - length)[owner[found]])
        found, prefix = found[kept], np.minimum.reduceat(prefix[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
        equal = prefix[1:] >= length
        group = np.cumsum(np.append(0, ~equal))
        several = np.append(False, equal) | np.append(equal, False)
        found, group = found[several], group[several]
        run = left[owner[found]]
        doc, start = runs.doc[run], runs.start[run] + found - shift[owner[found]]
        order = np.lexsort((start, doc, group))
        earliest = np.empty(len(order), np.int64)
        earliest[order] = order[np.searchsorted(group[order], group[order])]
        spans.append(_removals(doc, start, np.full(len(doc), length), earliest))
    return _merged(*(np.concatenate(c) for c in zip(*spans, strict=True)))


def crowded(docs: DataFrame, length: int, bound: int, total: int) -> tuple[np.ndarray, int]:
    """Keys of minimizers with more than about ``bound`` bytes of runs, and the number of their windows.

    Estimated from a sample of pieces of the texts. Equal runs count once for each
    batch of a map task at most, as they travel. Which keys are named affects the
    load of shards only, not the result.
    """
    every = max(1, min(EVERY, bound // 20_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                at = np.arange(0, len(data) - length + 1, PIECE)
                if len(data) > PIECE:
                    at = at[mixed(at.astype(np.uint64) + np.uint64(doc % (1 << 64))) % np.uint64(every) == 0]
                for k in at.tolist():
                    part = data[k : k + PIECE + length - 1] if len(data) > PIECE else data
                    first, last, key, _ = window_runs(part, length, GRAM)
                    h = mixed(span_hashes(prefix_hashes(part), first, last + length))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(last - first + 1)], ["key", "run", "windows"])

    chosen = docs.where((F.octet_length("bytes") > PIECE) | (F.pmod(F.xxhash64("doc"), F.lit(every)) == 0))
    runs = chosen.mapInArrow(count, "key long, run long, windows long").groupBy("key", "run").agg(F.count("*").alias("n"), F.max("windows").alias("windows"))
    n = F.least(F.col("n") * every, F.lit(max(1, -(-total // BATCH))))
    keys = runs.groupBy("key").agg(F.sum(n * (F.col("windows") + length - 1)).alias("load"), F.sum(n * F.col("windows")).alias("windows")).where(F.col("load") > bound).collect()
    return np.sort(np.array([r.key for r in keys], np.int64).view(np.uint64)), sum(r.windows for r in keys)


def _routed(docs: DataFrame, length: int, shards: int, split: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """(shard, runs, doc, low, high): packed runs for each shard, and the spans that a task could settle by itself.

    Runs whose key is in ``split`` (sorted) are taken apart: each of their windows
    goes by its own bytes. Equal windows have equal minimizers, so they still meet.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def packed(cols: list[list[np.ndarray]], data: np.ndarray) -> pa.RecordBatch:
            doc, start, size, key, single, h, offset = map(np.concatenate, cols)
            first = first_equal(h, size, offset, doc, start, data)
            gone = (doc[first] != doc) | (start[first] != start)
            spans = _merged(doc[gone], start[gone], start[gone] + size[gone])
            shard = (mixed(key) % np.uint64(shards)).astype(np.int64)
            kept = np.flatnonzero(~gone)
            kept = kept[np.argsort(shard[kept], kind="stable")]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[kept])) + 1, [len(kept)]])
            blobs, names = [], []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                own = kept[low:high]
                blobs.append(Runs(doc[own], start[own], size[own], key[own] & np.uint64(0xFFFFFFFF), single[own], data[ragged(offset[own], size[own])]).pack())
                names.append(shard[own[0]])
            n, m = len(blobs), len(spans[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([*names, *(spans[0] % shards)], pa.int32()), pa.array([*blobs, *([None] * m)], pa.binary()), *(pa.array([*([None] * n), *c.tolist()], pa.int64()) for c in spans)],
                ["shard", "runs", "doc", "low", "high"],
            )

        def flush() -> Iterator[pa.RecordBatch]:
            data = np.concatenate([np.frombuffer(t, np.uint8) for t in texts])
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            base = apart = 0
            for doc, text in zip(ids, texts, strict=True):
                for k in range(0, len(text) - length + 1, CHUNK):
                    part = data[base + k : base + min(len(text), k + CHUNK + length - 1)]
                    first, last, key, single = window_runs(part, length, GRAM)
                    prefix = prefix_hashes(part)
                    h = mixed(span_hashes(prefix, first, last + length))
                    if len(split):
                        hit = split[np.minimum(np.searchsorted(split, key), len(split) - 1)] == key
                        if hit.any():
                            alone = ragged(first[hit], last[hit] - first[hit] + 1)
                            own = mixed(span_hashes(prefix, alone, alone + length))
                            first, last = np.append(first[~hit], alone), np.append(last[~hit], alone)
                            key, h = np.append(key[~hit], mixed(own)), np.append(h[~hit], own)
                            single = np.append(single[~hit], np.ones(len(alone), bool))
                            apart += len(alone)
                    size = last - first + length
                    for c, x in zip(cols, (np.full(len(first), doc), first + k, size, key, single, h, first + (base + k)), strict=True):
                        c.append(x)
                    if apart >= SPLIT:
                        yield packed(cols, data)
                        cols, apart = [[] for _ in range(7)], 0
                base += len(text)
            if cols[0]:
                yield packed(cols, data)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc), texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BATCH:
                    yield from flush()
                    ids, texts, held = [], [], 0
        if texts:
            yield from flush()

    return docs.mapInArrow(route, "shard int, runs binary, doc long, low long, high long")


def repeated_spans(docs: DataFrame, length: int, shard_bytes: int = 16 << 20, budget: int = 96 << 20) -> DataFrame:
    """Spans (doc, low, high) of (doc, bytes) covered by ``length``-byte strings that also start earlier.

    Each window goes, with its run, to the shard of its minimizer; there are as
    many shards as the input needs for about ``shard_bytes`` of runs in each.
    Minimizers with more than a quarter of that are spread over all shards.
    """
    long_enough = docs.where(F.octet_length("bytes") >= length)
    total = long_enough.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    split, apart = crowded(long_enough, length, shard_bytes // 4, total)
    shards = max(8, -(-(total * 7 // 2 + apart * length) // shard_bytes))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(spans) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in spans], ["doc", "low", "high"])

        def settled(parts: list[Runs]) -> pa.RecordBatch:
            return out(repeated_in_shard(Runs.join(parts), length, budget))

        now, parts = None, []
        for batch in batches:
            spans = batch.filter(pc.is_null(batch.column(1)))
            if spans.num_rows:
                yield spans.select([2, 3, 4])
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blob.is_valid:
                    if shard != now and parts:
                        yield settled(parts)
                        parts = []
                    now = shard
                    parts.append(Runs.unpack(blob.as_py()))
        if parts:
            yield settled(parts)

    routed = _routed(long_enough, length, shards, split)
    return routed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(settle, "doc long, low long, high long")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier.

    Earlier is a smaller id, or the same document and a smaller start; strings
    are judged on the input and never cross documents. Returns (id, n_bytes,
    n_removed, n_spans, spans, kept), where kept are the remaining bytes.

    A null text is empty. A row with a null id is neither searched nor cut. Rows
    that repeat an id and its text are one document and all return its result.
    Of rows that repeat an id with different texts, the windows of all count as
    that document's, and each row is cut at the places found in any of them. Texts
    below ``length`` bytes stay whole; texts of any length are taken in
    pieces. An empty table gives no row. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), payload(text_col).alias("bytes"))
    found = repeated_spans(rows.where(F.col("id").isNotNull()).select(F.col("id").alias("doc"), "bytes"), length)
    found = stored(found, "spans", release=True).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(found, same(F.col("id"), F.col("doc")), "left").select("id", "bytes", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, low, high in zip(*batch.columns[1:], strict=True):
                text = text.as_py()
                low, high = (np.array(x.as_py() or [], np.int64) for x in (low, high))
                _, low, high = _merged(np.zeros(len(low), np.int64), low, np.minimum(high, len(text)))
                kept, at = [], 0
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append((len(text), int((high - low).sum()), len(low), [{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)], b"".join(kept)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(cut, f"{id_col} long, n_bytes long, n_removed long, n_spans long, spans array<struct<low: long, high: long>>, kept binary")

