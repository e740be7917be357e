"""Packing of token pieces into fixed-length sequences: bounded-space online best-fit."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import small_batches, stored, text_or_empty, worker_store

#: Words whose ids a worker keeps, about 200 bytes each; the store is emptied when full.
WORD_STORE = 1_000_000
_tokenizers: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _encoded(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word, which holds no ASCII white space.

    One call for all is cheaper than one a word. Bars stand between them, as the bar
    alone is one id that a word without a bar never gives; words with one are encoded
    by themselves, as are all where a vocabulary parts words otherwise.
    """
    tokenizer = _tokenizer(path)
    plain = [w for w in words if b"|" not in w]
    together = tokenizer.encode_batch_fast(["|", b" | ".join(plain).decode()], add_special_tokens=False)
    ids = np.array(together[1].ids, "<u4")
    ends = np.flatnonzero(ids == together[0].ids[0])
    known = {}
    if len(together[0].ids) == 1 and len(ends) == len(plain) - 1:
        data, starts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
        known = {w: data[a:b] for w, a, b in zip(plain, starts, [*(4 * ends).tolist(), len(data)], strict=True)}
    rest = [w for w in words if w not in known]
    for w, e in zip(rest, tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
        known[w] = np.array(e.ids, "<u4").tobytes()
    return [known[w] for w in words]


def token_bytes(text: bytes, path: str) -> bytes:
    """Ids of a UTF-8 text as little-endian unsigned 32-bit words.

    The vocabulary has no upper case, drops white space and never joins what it
    parts, so each lower-cased word between ASCII white space is encoded once
    and looked up afterwards. Full stops and commas after a letter are words of
    their own. A text that may hold a special token's name is encoded as it is.
    """
    if b"<|" in text:
        return np.array(_tokenizer(path).encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    known = worker_store(f"tokens-{path}")
    words = text.lower().split()
    new = set(words).difference(known)
    if new:
        if len(known) + 2 * len(new) > WORD_STORE:
            known.clear()
            new = set(words)
        parts = {}
        for w in new:
            stem = w.rstrip(b".,")
            if len(stem) < len(w) and stem[-1:].isalpha():
                parts[w] = stem, w[len(stem) :]
        stems = list((new - parts.keys()).union(p for pair in parts.values() for p in pair).difference(known))
        known.update(zip(stems, _encoded(stems, path), strict=True))
        for w, (stem, tail) in parts.items():
            known[w] = known[stem] + known[tail]
    return b"".join([known[w] for w in words])


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids, with ``end_id`` after them, into pieces of ``length`` ids.

    Returns (id, piece, start, length, ids_crc32). A null or empty text gives one
    piece with the end id alone; null ids and repeated rows are rows like others.
    """
    small_batches(docs.sparkSession)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, lengths, crcs = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = token_bytes(text.as_py(), tokenizer) + end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append(row), numbers.append(k), starts.append(at // 4), lengths.append(len(part) // 4), crcs.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, F.encode(text_or_empty(text_col), "UTF-8").alias("text")).mapInArrow(cut, schema)


class OpenBins:
    """At most ``limit`` open bins, found through a bitset keyed by free space.

    A piece goes into the open bin with the least space that holds it. When a
    bin too many is open, the fullest closes first.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, need: int) -> tuple[int, int]:
        """The bin that takes a piece of ``need`` units, and the offset there."""
        found = self.bits >> need
        if found:
            space = need + (found & -found).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            bin_id, space, self.made = self.made, self.size, self.made + 1
        left = space - need
        if left:
            self.free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.size - space

    def _take(self, space: int) -> int:
        own = self.free[space]
        bin_id = own.pop()
        if not own:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_id


def _waves(batches: Iterator[pa.RecordBatch], wave: int) -> Iterator[pa.RecordBatch]:
    """Rows as they arrive, ``wave`` at a time, from long to short; equal lengths stay as they came."""

    def fallen(held: pa.Table) -> pa.RecordBatch:
        return held.take(pa.array(np.argsort(-held.column("length").to_numpy(), kind="stable"))).combine_chunks().to_batches()[0]

    held = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
        while held.num_rows >= wave:
            yield fallen(held.slice(0, wave))
            held = held.slice(wave)
    if held is not None and held.num_rows:
        yield fallen(held)


def pack(pieces: DataFrame, length: int = 2048, open_bins: int = 1024, wave: int = 4096, pieces_per_task: int = 125_000, id_col: str = "doc_id", closings: Accumulator | None = None) -> DataFrame:
    """Add (sequence_id, offset) to pieces, none longer than ``length``.

    The pieces are dealt by hash over tasks of about ``pieces_per_task``, in a fixed
    pseudo-random order, so a task that runs again gives the same sequences. More
    pieces make more tasks, never larger ones. A task packs them as they arrive, in
    waves: it looks ``wave`` pieces ahead and places these from long to short. Bins
    stay open from wave to wave, at most ``open_bins`` of them: the fullest closes
    when one more is needed, so a task holds that many bins and pieces, however
    long its input. A wave needs as many open bins as it has pieces above half a
    sequence that do not fill one, less what the short ones of earlier waves left;
    with fewer, bins close before the short pieces come that would fill them.
    ``closings`` counts the bins that close.
    """
    spark = pieces.sparkSession
    kept = stored(pieces, "pieces")
    tasks = max(1, -(-kept.count() // pieces_per_task))
    names = kept.columns
    order = F.xxhash64(*[F.col(c) for c in names])
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes) + ", sequence_id long, offset long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in _waves(batches, wave):
            spots = [bins.put(n) for n in batch.column(names.index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([base + b for b, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64())],
                [*names, "sequence_id", "offset"],
            )
        if closings is not None:
            closings.add(bins.closed)

    dealt = kept.withColumn("order", order).repartition(tasks, "order") if tasks > 1 else kept.withColumn("order", order).coalesce(1)
    return dealt.sortWithinPartitions("order", *names).drop("order").mapInArrow(fill, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack documents; one row per piece.

    A null text is empty and gives one piece with the end id alone. Null ids and
    repeated rows are packed as rows of their own; an empty table gives no row.
    Documents of any length pass one at a time. Other columns are ignored.
    """
    return pack(pieces(docs, tokenizer or default_tokenizer(), length, 0, id_col, text_col), length, open_bins, id_col=id_col)
