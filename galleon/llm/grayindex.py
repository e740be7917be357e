"""SimHash fingerprints and near-duplicate search by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import payload, shuffle_partitions, small_batches, stored, worker_store
from galleon.llm.components import connected_components

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 14
#: Children of a node inside a block, and of a node above the blocks.
FAN, WIDE = 16, 64
#: Queries that descend a block's tree at a time.
QUERIES = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: bit b is set if it is set in over half of the hashes of its word shingles.

    A-Z are lower-cased, words are parted by ASCII white space, repeated shingles
    count as often as they occur. A text with fewer words than ``width`` has its
    whole sequence as one shingle; one without words has fingerprint zero.
    """
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    spans = list(map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    often = np.zeros(64, np.int64)
    for low in range(0, len(spans), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(joined[s], 42) for s in spans[low : low + CHUNK]], np.uint64)
        often += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * often > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text, as a signed long."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("simhash")  # lets go of what an earlier stage has left in the worker
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), payload(text_col).alias("text")).mapInArrow(describe, f"id {dict(docs.dtypes)[id_col]}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, as a long that sorts like the unsigned place."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def shared_pattern(patterns: np.ndarray, masks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, mask) of the bits that all members of each run of nodes have in common; runs begin at ``starts``."""
    both = np.bitwise_and.reduceat(masks, starts)
    ones, zeros = np.bitwise_and.reduceat(patterns, starts), np.bitwise_and.reduceat(~patterns, starts)
    mask = both & (ones | zeros)
    return ones & mask, mask


def blocks_in_order(distinct: DataFrame, size: int, partitions: int) -> DataFrame:
    """Fingerprints in Gray order, cut into blocks of up to ``size``: (node, pattern, mask, fps), numbered in that order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, number = np.zeros(0, np.int64), 0
        names = ["part", "number", "pattern", "mask", "fps"]

        def block(part: int, fps: np.ndarray) -> pa.RecordBatch:
            pattern, mask = shared_pattern(fps.view(np.uint64), np.full(len(fps), ALL), np.zeros(1, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array(pattern.view(np.int64)), pa.array(mask.view(np.int64)), pa.array([fps], pa.list_(pa.int64()))], names)

        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                rest = np.concatenate([rest, np.asarray(batch.column(1))])
            while len(rest) >= size:
                yield block(part, rest[:size])
                rest, number = rest[size:], number + 1
        if len(rest):
            yield block(part, rest)

    ordered = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(partitions, "rank").sortWithinPartitions("rank")
    parts = ordered.select(F.spark_partition_id().cast("long").alias("part"), "fp").mapInArrow(cut, "part long, number long, pattern long, mask long, fps array<long>")
    parts = stored(parts, "blocks")
    bits = (parts.agg(F.max("number")).first()[0] or 0).bit_length()
    return parts.select((F.shiftleft("part", bits) + F.col("number")).alias("node"), "pattern", "mask", "fps")


def level_above(nodes: DataFrame) -> DataFrame:
    """Parents of up to ``WIDE`` neighbouring nodes: (node, pattern, mask, children), with the bits that all children share."""
    ones, zeros = F.bit_and("pattern"), F.bit_and(F.bitwise_not("pattern"))
    mask = F.bit_and("mask").bitwiseAND(ones.bitwiseOR(zeros))
    above = nodes.groupBy(F.floor(F.col("node") / WIDE).alias("node"))
    return above.agg(ones.bitwiseAND(mask).alias("pattern"), mask.alias("mask"), F.collect_list(F.struct("node", "pattern", "mask")).alias("children"))


class GrayTree:
    """A hierarchical index over fingerprints in Gray order.

    A node's pattern and mask are the bits that all fingerprints below it share,
    without those that a node above it has already: shared bits stand, and are
    compared, once. ``levels`` run from the top to the fingerprints.
    """

    def __init__(self, fps: np.ndarray):
        patterns, masks = [fps], [np.full(len(fps), ALL)]
        while len(patterns[0]) > 1:
            pattern, mask = shared_pattern(patterns[0], masks[0], np.arange(0, len(patterns[0]), FAN))
            above = np.arange(len(patterns[0])) // FAN
            masks[0] = masks[0] & ~mask[above]
            patterns[0] = patterns[0] & masks[0]
            patterns.insert(0, pattern), masks.insert(0, mask)
        self.levels = list(zip(patterns, masks, strict=True))

    def near(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) of all fingerprints with ``most`` or fewer differing bits, for some queries at a time.

        Differences add up from the top; a node with more than ``most`` is left, and all below it.
        """
        for low in range(0, len(queries), QUERIES):
            some = queries[low : low + QUERIES]
            query, place = np.arange(len(some)), np.zeros(len(some), np.int64)
            apart = np.zeros(len(some), np.uint8)
            for depth, (pattern, mask) in enumerate(self.levels):
                if depth:
                    wide = (place[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = wide < len(pattern)
                    query, apart, place = np.repeat(query, FAN)[inside], np.repeat(apart, FAN)[inside], wide[inside]
                apart = apart + np.bitwise_count((some[query] ^ pattern[place]) & mask[place])
                left = apart <= most
                query, place, apart = query[left], place[left], apart[left]
            yield query + low, place


def joined(labels: np.ndarray, some: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Labels after joining ``some`` with ``other``: equal for what is connected, each the smallest place of its component."""
    while True:
        x, y = labels[some], labels[other]
        apart = x != y
        if not apart.any():
            return labels
        some, other = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(some, other), np.minimum(some, other))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def children_near(pairs: DataFrame, level: DataFrame, most: int) -> DataFrame:
    """(a, b) with a <= b: pairs of children of paired nodes that have fixed ``most`` or fewer bits differently."""
    own, other = (level.select(F.col("node").alias(x), *[F.col(f"children.{f}").alias(x + f) for f in ("node", "pattern", "mask")]) for x in "ab")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                an, ap, am, bn, bp, bm = (np.asarray(batch.column(c)[row].values) for c in range(6))
                apart = np.bitwise_count(((ap[:, None] ^ bp) & am[:, None] & bm).view(np.uint64))
                i, j = np.nonzero((apart <= most) & (an[:, None] <= bn))
                yield pa.RecordBatch.from_arrays([pa.array(an[i]), pa.array(bn[j])], ["a", "b"])

    met = pairs.join(own, "a").join(other, "b")
    return met.select("anode", "apattern", "amask", "bnode", "bpattern", "bmask").mapInArrow(expand, "a long, b long")


def near_links(distinct: DataFrame, most: int = 2, block: int = 2048) -> DataFrame:
    """(a, b): links that connect every two fingerprints with ``most`` or fewer differing bits; ``distinct`` has (fp).

    Fingerprints in Gray order are cut into blocks, and ``WIDE`` neighbouring
    nodes at a time get a parent that holds the bits they share, up to one root.
    From the root, pairs of nodes descend level by level: a pair lives while
    what the two have fixed differs in ``most`` bits or fewer. Paired blocks meet in
    a task, where the fingerprints of one search the tree of the other. Of two
    blocks the links only say what is connected, so a dense group makes fewer of
    them than it has fingerprints.
    """
    partitions = min(shuffle_partitions(distinct.sparkSession), 1 + distinct.count() // block)
    blocks = blocks_in_order(distinct, block, partitions)
    levels = [stored(level_above(blocks), "level")]
    while levels[0].agg(F.max("node")).first()[0]:
        levels.insert(0, stored(level_above(levels[0]), "level"))
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"))  # the root with itself; no row for an empty table
    for level in levels:
        pairs = stored(children_near(pairs, level, most), "node-pairs")
    met = pairs.join(blocks.select(F.col("node").alias("a"), F.col("fps").alias("one")), "a").join(blocks.select(F.col("node").alias("b"), F.col("fps").alias("two")), "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = (np.asarray(batch.column(c)[row].values) for c in range(2))
                own = len(one) == len(two) and one[0] == two[0]  # a block with itself
                both, start = (one, 0) if own else (np.concatenate([one, two]), len(one))
                labels = np.arange(len(both))
                for query, place in GrayTree(two.view(np.uint64)).near(one.view(np.uint64), most):
                    labels = joined(labels, query, place + start)
                more = np.flatnonzero(labels != np.arange(len(both)))
                yield pa.RecordBatch.from_arrays([pa.array(both[more]), pa.array(both[labels[more]])], ["a", "b"])

    return met.select("one", "two").mapInArrow(search, "a long, b long")


def simhash_duplicates(docs: DataFrame, width: int = 3, most: int = 2, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in ``most`` bits or fewer.

    Rows with equal fingerprints are one node, aggregated before they are
    shuffled, so copies cost nothing further. Links between nodes come from
    ``near_links``, components from alternating stars; no fingerprint, link or
    component passes the driver.

    Returns (id, fp, component_id), a row for each input row; ``fp`` is the
    fingerprint as a signed long. Texts without words, null and empty ones
    included, have fingerprint zero and link like any other. A row with a null id
    links its fingerprint's neighbours as well, but never names a component; one
    without any id has a null component. Rows that repeat an id, with equal or
    other texts, are rows of their own. Extra columns are ignored; an empty table
    gives no row.
    """
    found = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    linked = connected_components(near_links(nodes.select("fp"), most, block), "a", "b")
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = stored(named.join(smallest, "component").select(F.col("fp").alias("node"), "component_id"), "components")
    return found.join(by_fp, F.col("fp") == F.col("node")).select(F.col("id").alias(id_col), "fp", "component_id")
