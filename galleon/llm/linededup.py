"""Line dedup by pairwise alignment: patience diff of overlapping documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import payload, small_batches, stored, text_or_empty, worker_store
from galleon.llm.windows import mixed, prefix_hashes, span_hashes

#: Documents are first paired by the runs of lines that at most so many rows have.
RARE = 64


def _anchors(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest run of lines, unique in both ranges, that stand in the same order in both."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
    pairs = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at]
    tops: list[int] = []
    top_index: list[int] = []
    before = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tops, i)
        before[k] = top_index[p - 1] if p else -1
        tops[p : p + 1], top_index[p : p + 1] = [i], [k]
    run, k = [], top_index[-1] if top_index else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def patience_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, lines) of two lists of lines, in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        run = _anchors(a, b, a0, a1, b0, b1)
        for i, j in run:
            todo.append((a0, i, b0, j))
            a0, b0 = i, j  # the anchor opens the next range, where it matches at once
        if run:
            todo.append((a0, a1, b0, b1))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and (i, j) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def common_runs(a: Sequence, b: Sequence, sizes: Sequence[int], least: int) -> list[int]:
    """Lines of ``b`` in runs of at least ``least`` characters that ``a`` has as well, anywhere."""
    b, sizes, wanted = np.array(b), np.array(sizes, np.int64), set(b)
    chars, lines = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    edges = np.zeros(len(b) + 1, np.int64)
    for x in a:  # what ends at a line of a and a line of b goes on from what ended one line before in both
        same = b == x if x in wanted else np.zeros(len(b), bool)
        chars[1:], lines[1:] = np.where(same, chars[:-1] + sizes, 0), np.where(same, lines[:-1] + 1, 0)
        ends = np.flatnonzero((chars[1:] >= least) & same)
        if len(ends):
            np.add.at(edges, ends + 1 - lines[ends + 1], 1)
            np.add.at(edges, ends + 1, -1)
    return np.flatnonzero(np.cumsum(edges[:-1]) > 0).tolist()


def unsettled(b: Sequence, gone: list[bool], known: set, sizes: Sequence[int], low: int, high: int, least: int) -> list[tuple[int, int]]:
    """Spans of ``b`` in [low, high) that can hold another common run: lines still there, and ``least`` characters around them."""
    spans, k = [], low
    while k < high:
        if b[k] not in known:
            k += 1
            continue
        start = k
        while k < high and b[k] in known:
            k += 1
        if sum(sizes[start:k]) < least:
            continue
        i = start
        while i < k:
            if gone[i]:
                i += 1
                continue
            first = i
            while i < k and not gone[i]:
                i += 1
            left, right, n = first, i, 0
            while left > start and n < least:
                left, n = left - 1, n + sizes[left - 1]
            n = 0
            while right < k and n < least:
                right, n = right + 1, n + sizes[right]
            if sum(sizes[left:right]) >= least:
                spans.append((left, right))
    return spans


def repeated_lines(a: Sequence[int], b: Sequence[int], sizes: Sequence[int], least: int) -> list[int]:
    """Lines of ``b`` in runs of at least ``least`` characters that stand in ``a``, found by alignment.

    The aligned blocks of a patience diff go first. What is left, with the lines
    around it, is aligned with all of ``a`` again, as blocks may have moved. Where
    a diff brings nothing new, as its lines are repeated and none can be an anchor,
    all common runs of the span are looked up.
    """
    gone, known, todo = [False] * len(b), set(a), [(0, len(b))]
    while todo:
        low, high = todo.pop()
        new = False
        for _, j, n in patience_blocks(a, b[low:high]):
            j += low
            if sum(sizes[j : j + n]) >= least and not all(gone[j : j + n]):
                gone[j : j + n], new = [True] * n, True
        if new:
            todo += unsettled(b, gone, known, sizes, low, high, least)
        else:
            for k in common_runs(a, b[low:high], sizes[low:high], least):
                gone[low + k] = True
    return [k for k, x in enumerate(gone) if x]


def minimal_runs(starts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (low, high) of the shortest runs of lines with ``least`` characters, from each first line and to each last one.

    ``starts`` are the first lines of the documents and the end of the last one.
    Every line of a common block of ``least`` characters is in a run that lies in the block.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    end = np.repeat(starts[1:], np.diff(starts))
    begin = np.repeat(starts[:-1], np.diff(starts))
    line = np.arange(len(sizes))
    high = np.searchsorted(total, total[:-1] + least, "left")
    low = np.searchsorted(total, total[1:] - least, "right") - 1
    down, up = high <= end, low >= begin
    spans = np.unique(np.stack([np.append(line[down], low[up]), np.append(high[down], line[up] + 1)], 1), axis=0)
    return spans[:, 0], spans[:, 1]


def runs_of(own: DataFrame, least: int) -> DataFrame:
    """(row, id, run, check, low, high): the minimal runs of each row's lines, with 96 bits of hashes of their lines."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("lines")  # lets go of what an earlier stage has left in the worker
        for batch in batches:
            h, size = batch.column(2), batch.column(3)
            starts = np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            low, high = minimal_runs(starts, size.flatten().to_numpy(zero_copy_only=False).astype(np.int64), least)
            lines = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            run, check = (mixed(span_hashes(prefix_hashes(x), low, high)) for x in (lines, mixed(~lines)))
            doc = np.searchsorted(starts, low, "right") - 1
            at, cols = pa.array(doc), (run.view(np.int64), check.astype(np.uint32).view(np.int32), (low - starts[doc]).astype(np.int32), (high - starts[doc]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, cols)], ["row", "id", "run", "check", "low", "high"])

    return own.select("row", "id", "h", "size").mapInArrow(spread, "row long, id long, run long, check int, low int, high int")


def aligned(pairs: DataFrame, own: DataFrame, least: int) -> DataFrame:
    """(row, line): the lines that the later rows of ``pairs`` (row, first) lose, each once."""
    both = pairs.join(own.select("row", "h", "size"), "row").join(own.select(F.col("row").alias("first"), F.col("h").alias("earlier")), "first")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repeated_lines(a, b, s, least) for a, b, s in zip(*(batch.column(k).to_pylist() for k in (3, 1, 2)), strict=True)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([k for x in found for k in x], pa.int32())], ["row", "line"])

    return both.select("row", "h", "size", "earlier").mapInArrow(align, "row long, line int").distinct()


def repeated_in_earlier(own: DataFrame, least: int) -> DataFrame:
    """(row, drop): the lines of each row in runs of ``least`` characters or more that stand in a row with a smaller id.

    ``own`` has (row, id, content, h, size), each content of an id once. A copy of
    an earlier document loses all its lines. The others are aligned with the
    earliest holder of each of their minimal runs: first of those that are rare,
    then of the frequent ones that this has left. A pair settles every run that
    its two rows share, so a run needs one holder, and there are no more pairs
    than runs.
    """
    least = max(1, least)
    originals = stored(own.groupBy("content").agg(F.min("id").alias("id")), "originals")
    marked = own.join(originals.withColumnRenamed("id", "original"), "content")
    total = F.aggregate("size", F.lit(0).cast("long"), lambda n, x: n + x)
    copies = marked.where((F.col("id") > F.col("original")) & (total >= least)).select("row", F.sequence(F.lit(0), F.size("h") - 1).alias("drop"))
    first_rows = stored(marked.where(F.col("id") == F.col("original")).select("row", "id", "h", "size"), "firsts")
    runs = stored(runs_of(first_rows, least), "runs")
    held = runs.groupBy("run", "check").agg(F.min(F.struct("id", "row")).alias("least"), F.max("id").alias("last"), F.count("*").alias("n")).where("least.id < last")
    held = stored(held.select("run", "check", F.col("least.id").alias("first_id"), F.col("least.row").alias("first"), (F.col("n") <= RARE).alias("rare")), "held")
    shared = stored(runs.join(held, ["run", "check"]).where("first_id < id").select("row", "first", "low", "high", "rare"), "shared")
    lines = stored(aligned(stored(shared.where("rare").select("row", "first").distinct(), "pairs"), first_rows, least), "aligned")
    rest = shared.where("NOT rare").select("row", "first", "low", "high")
    if not rest.isEmpty():
        done = lines.groupBy("row").agg(F.collect_set("line").alias("drop")).withColumnRenamed("row", "done")
        open_lines = F.array_except(F.sequence("low", F.col("high") - 1), F.coalesce("drop", F.array().cast("array<int>")))
        left = rest.join(done, F.col("row") == F.col("done"), "left").where(F.size(open_lines) > 0).select("row", "first").distinct()
        lines = lines.union(stored(aligned(stored(left, "pairs"), first_rows, least), "aligned"))
    return copies.union(lines.groupBy("row").agg(F.collect_set("line").alias("drop")))


def line_dedup(docs: DataFrame, least: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete from each document the lines of runs that it shares with an earlier one.

    Documents (smaller id: earlier) are paired by shared runs of lines and aligned
    by patience diff, and the later one loses every run of consecutive lines with at
    least ``least`` characters (outer blanks not counted) that stands in an earlier
    document. Each deleted line still stands in one, as the earliest holder of a
    run is cut in it by none. Runs are found by 96 bits of hashes, and the lines of
    a pair are compared by 64 bits.

    Returns the input's columns with the kept text in ``text_col``, and n_lines,
    n_removed. Other columns, n_lines and n_removed excepted, stay as they are. A
    null text stays null with no lines; an empty text has one empty line. Rows
    with a null id are returned as they are. Rows that repeat an id are judged each
    by its own text, against smaller ids and not against each other; those that
    repeat the text as well are cut alike. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    content = F.md5(payload(text_col))
    split = F.split(text_or_empty(text_col), "\n")
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), content.alias("content"), split.alias("x"))
    lines = known.select("id", "content", F.transform("x", lambda x: F.xxhash64(x)).alias("h"), F.transform("x", lambda x: F.length(F.trim(x))).alias("size"))
    own = stored(lines.dropDuplicates(["id", "content"]).withColumn("row", F.monotonically_increasing_id()), "own")
    found = stored(repeated_in_earlier(own, least), "found")
    # Names that no input column has.
    taken = {n.lower() for n in names}
    key, of, gone = (next(n for n in (base + "_" * k for k in range(len(names) + 1)) if n not in taken) for base in ("dropped_id", "dropped_content", "drop"))
    drops = found.join(own.select("row", "id", "content"), "row").select("id", "content", "drop")
    drops = stored(drops, "drops").toDF(key, of, gone)
    # One plan for all sizes: a short list of drops could be broadcast, a long one could not.
    joined = docs.select(*names).join(drops.hint("merge"), (docs[id_col] == drops[key]) & (content == drops[of]), "left")
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_removed", "long")
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, drop in zip(batch.column(at), batch.column(len(names)), strict=True):
                text, gone = text.as_py(), set(drop.as_py() or ())
                own = [] if text is None else text.split("\n")
                left = [x for k, x in enumerate(own) if k not in gone] if gone else own
                texts.append(text if not gone else "\n".join(left)), counts.append(len(own)), removed.append(len(own) - len(left))
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    return joined.select(*names, gone).mapInArrow(cut, schema)
