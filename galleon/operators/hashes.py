"""Exact Hamming neighbours of 64-bit codes by multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleon.sources.shared import stored

#: Keys of a query in each part at most, where the number of parts is chosen here.
KEYS = 256
#: Share of all pairs that keys bring together, beyond which every two codes are compared in blocks: a row of a join costs that much more.
WIDE = 0.05
#: Codes of a block asked for, and held, about; tasks at most that they meet in.
ASKED, HELD, TASKS = 16_384, 65_536, 1024


def parts_for(radius: int) -> int:
    """The fewest parts of a code, so the longest ones, for which a query needs at most ``KEYS`` keys in each."""
    return next((p for p in (1, 2, 4, 8) if sum(comb(64 // p, m) for m in range(min(radius // p, 64 // p) + 1)) <= KEYS), 8)


def share(radius: int, parts: int) -> float:
    """Of all pairs of random codes, how many their keys bring together, each part's counted."""
    bits = 64 // parts
    return parts * sum(comb(bits, m) for m in range(min(radius // parts, bits) + 1)) / 2.0**bits


def part_of(code: Column, part: int, parts: int) -> Column:
    """Bits ``part * 64 / parts`` and on of a code, as a long."""
    bits = 64 // parts
    return code if parts == 1 else F.shiftrightunsigned(code, part * bits).bitwiseAND(F.lit((1 << bits) - 1))


def near_codes(asked: DataFrame, held: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """(a, b, distance): the codes of ``held`` (b) that differ from one of ``asked`` (a) in ``radius`` bits or fewer.

    If two codes differ in no more than ``radius`` bits, one of their ``parts`` differs in
    no more than radius // parts. So a query asks in each part for its own bits and all
    that are so near to them, and Spark joins the parts by equality. A pair is taken in the
    first of its near parts and in no other, and its whole codes are compared. Codes
    are distinct on both sides.
    """
    parts = parts or parts_for(radius)
    bits, flips = 64 // parts, min(radius // parts, 64 // parts)
    masks = [sum(1 << b for b in c) for m in range(flips + 1) for c in combinations(range(bits), m)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    near = F.array(*[F.lit(m).cast("long") for m in signed])
    own = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), part_of(F.col("b"), p, parts).alias("value")) for p in range(parts)])).alias("x")
    items = held.select("b", own).select("b", "x.part", "x.value")
    keys = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), part_of(F.col("a"), p, parts).alias("value")) for p in range(parts)])).alias("x")
    queries = asked.select("a", keys).select("a", "x.part", F.explode(F.transform(near, lambda m: F.col("x.value").bitwiseXOR(m))).alias("value"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(F.bit_count(part_of(differs, p, parts)) <= flips, F.lit(p)) for p in range(parts)])
    found = queries.join(items, ["part", "value"]).where((F.bit_count(differs) <= radius) & (first == F.col("part")))
    return found.select("a", "b", F.bit_count(differs).cast("int").alias("distance"))


def near_codes_in_blocks(asked: DataFrame, held: DataFrame, radius: int) -> DataFrame:
    """The rows of ``near_codes``, where keys would bring most pairs together: every two codes are compared, in blocks.

    Codes are dealt by hash. A block of each side meets in one task, as bits side by side, and only
    pairs within ``radius`` are rows.
    """

    def dealt(df: DataFrame, code: str, block: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        return df.select(code, F.pmod(F.xxhash64(code), F.lit(n)).cast("int").alias(f"{code}_block")), n

    (a, n), (b, m) = dealt(asked, "a", ASKED), dealt(held, "b", HELD)
    tasks = min(n * m, TASKS)
    a = a.withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(tasks, "a_block", "b_block")
    b = b.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(tasks, "a_block", "b_block")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (np.sort(t.column(c).to_numpy()) for t, c in ((left, "a"), (right, "b")))
        found = [(x[:0], y[:0], np.zeros(0, np.int32))]
        rows = max(1, (1 << 20) // max(1, len(y)))
        for low in range(0, len(x) if len(y) else 0, rows):
            distance = np.bitwise_count((x[low : low + rows, None] ^ y[None, :]).view(np.uint64))  # of a signed number it would count the absolute value
            i, j = np.nonzero(distance <= radius)
            found.append((x[low + i], y[j], distance[i, j].astype(np.int32)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "distance"])

    return a.groupBy("a_block", "b_block").cogroup(b.groupBy("a_block", "b_block")).applyInArrow(compare, "a long, b long, distance int")


def hash_neighbours(queries: DataFrame, gallery: DataFrame, radius: int, parts: int | None = None, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """All gallery rows whose code differs from a query's in ``radius`` bits or fewer: (query_id, item_id, distance).

    Rows with equal codes are looked up once, by ``near_codes``, or, where ``parts`` is not given and
    the radius is so wide that keys bring more than ``WIDE`` of all pairs together, by
    ``near_codes_in_blocks``. A row never finds its
    own id. Null ids and codes are left out, rows that repeat an id are rows of their
    own, and an empty table gives no row.
    """
    def known(df: DataFrame, name: str, code: str) -> DataFrame:
        return df.select(F.col(id_col).alias(name), F.col(code_col).cast("long").alias(code)).dropna()

    asked, held = known(queries, "query_id", "a"), known(gallery, "item_id", "b")
    # Stored: a code is looked up and joined again, and made once.
    asked, held = stored(asked, "asked"), stored(held, "held")
    own, other = asked.select("a").distinct(), held.select("b").distinct()
    wide = parts is None and share(radius, parts_for(radius)) > WIDE
    near = near_codes_in_blocks(own, other, radius) if wide else near_codes(own, other, radius, parts)
    return near.join(asked, "a").join(held, "b").where("query_id <> item_id").select("query_id", "item_id", "distance")
