"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from random import Random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleon.llm.common import shuffle_partitions, stored, text_or_empty


class FreeSpace:
    """Balanced search tree (a treap) of bins by (free space, bin)."""

    def __init__(self):
        self.root = None
        self.random = Random(5)

    @staticmethod
    def _split(node, key):
        """The parts of a tree below ``key``, and from it on."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = FreeSpace._split(node[3], key)
            return (*node[:3], low), high
        low, high = FreeSpace._split(node[2], key)
        return low, (*node[:2], high, node[3])

    @staticmethod
    def _join(low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return (*low[:3], FreeSpace._join(low[3], high))
        return (*high[:2], FreeSpace._join(low, high[2]), high[3])

    def add(self, space: int, where: int) -> None:
        low, high = self._split(self.root, (space, where))
        self.root = self._join(self._join(low, ((space, where), self.random.random(), None, None)), high)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least space of at least ``need``; ties go to the lower bin."""
        low, high = self._split(self.root, (need, -1))
        if high is None:
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._join(low, rest)
        return first[0]


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item in as few bins of ``capacity`` as the rule opens.

    Items go from large to small (ties in their order) into the bin whose
    remaining capacity is the tightest that fits; a new bin opens when none does.
    None if that takes more than ``most`` bins, or an item exceeds the capacity.
    """
    free, where, opened = FreeSpace(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.take_tightest(sizes[i])
        if found is None:
            if sizes[i] > capacity or opened == most:
                return None
            found, opened = (capacity, opened), opened + 1
        where[i] = found[1]
        free.add(found[0] - sizes[i], found[1])
    return where


def balanced_bins(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing into at most ``bins`` bins of the smallest capacity that works.

    An item of at least the mean load of the bins left takes a bin alone, and the
    rest are levelled over the other bins.
    """
    where = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total, first, k = sum(sizes), 0, bins
    while k > 1 and first < len(order) and sizes[order[first]] * k >= total:
        where[order[first]] = bins - k
        total -= sizes[order[first]]
        first, k = first + 1, k - 1
    rest = order[first:]
    if not rest:
        return where
    own = [sizes[i] for i in rest]
    low = max(own[0], -(-total // k))
    high = low + own[0]
    while best_fit_decreasing(own, high, k) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(own, mid, k) is None:
            low = mid + 1
        else:
            high = mid
    for i, b in zip(rest, best_fit_decreasing(own, high, k), strict=True):
        where[i] = bins - k + b
    return where


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    bundles_per_shard: int = 256,
) -> DataFrame:
    """Deal rows into ``shards`` shards of nearly equal bytes; equal texts stay together.

    Returns (id, size, text_crc32, shard, slot). A row's size is its text's UTF-8
    bytes plus ``overhead``; null counts as an empty text. Slots run from 0
    without a gap in each shard.

    Groups heavier than ``1 / bundles_per_shard`` of the mean shard are items of
    their own, of which there can be no more than ``shards * bundles_per_shard``.
    Lighter groups fall by hash into as many bundles, which are items too. So the
    packing on the driver sees a number of items that does not grow with the
    data, while every group stays whole. A group above the mean load fills a
    shard alone. The numbering splits each shard into hash chunks, so that no
    task holds a whole shard.

    Null ids, repeated rows and empty tables are fine: each input row gives one
    row. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    items = shards * bundles_per_shard
    heavy = max(1, total // items)
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    bundle = F.pmod(F.col("h"), F.lit(items))
    # One light item for each bundle, one heavy item for each group above the bound.
    packed = (
        groups.select(
            F.when(F.col("size") > heavy, F.col("h")).alias("h"),
            F.when(F.col("size") <= heavy, bundle).alias("bundle"),
            "size",
        )
        .groupBy("h", "bundle")
        .agg(F.sum("size").alias("size"))
        .collect()
    )
    packed.sort(key=lambda r: (r.h is None, r.h or 0, r.bundle or 0))
    where = balanced_bins([r["size"] for r in packed], shards)
    # Both tables have at most shards * bundles_per_shard short rows.
    of_group = spark.createDataFrame([(r.h, b) for r, b in zip(packed, where, strict=True) if r.h is not None], "h long, own int")
    of_bundle = spark.createDataFrame([(r.bundle, b) for r, b in zip(packed, where, strict=True) if r.h is None], "bundle long, common int")
    chunks = shuffle_partitions(spark)
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(of_group), "h", "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select(
            id_col, "size", "text_crc32",
            F.coalesce("own", "common").alias("shard"),
            F.pmod(F.xxhash64(id_col, "h"), F.lit(chunks)).cast("int").alias("chunk"),
        )
    )
    placed = stored(placed, "shard-placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy(id_col, "text_crc32", "size")
    return (
        placed.withColumn("rn", F.row_number().over(within) - 1)
        .join(starts, ["shard", "chunk"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("start") + F.col("rn")).cast("long").alias("slot"))
    )
