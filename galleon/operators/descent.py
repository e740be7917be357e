"""A graph of nearest neighbours by descent: neighbours of neighbours are tried until few of them help."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleon.operators.pivots import usable
from galleon.operators.search import SCORES, ranked, rounded
from galleon.sources.shared import stored

#: Groups that each row starts in.
DEALS = 4
PAIRS = "id long, other long, score double"


def _tried(groups: DataFrame, width: int, counted: Accumulator | None) -> DataFrame:
    """(id, other, score): both ways, the pairs of members of a group that improve a list.

    ``groups`` has ``members``, an array of (id, new, least, v). Pairs of two members that are
    not new have met before. A member takes the best ``width`` that are above its ``least``.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            lists = batch.column(0)
            size = np.diff(lists.offsets.to_numpy())
            members = lists.flatten()
            ids, new, least = (members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "new", "least"))
            v = np.array(members.field("v").flatten(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            start, found = np.cumsum(size) - size, []
            # Groups of one size are scored together.
            for m in np.unique(size[size > 1]):
                some = start[size == m]
                step = max(1, SCORES // int(m * m))
                for low in range(0, len(some), step):
                    at = some[low : low + step, None] + np.arange(m)
                    own, x = ids[at], v[at]
                    meet = (new[at][:, :, None] | new[at][:, None, :]) & (own[:, :, None] != own[:, None, :])
                    n += int(meet.sum()) // 2
                    norm = np.sqrt((x * x).sum(2))
                    s = rounded((x @ x.transpose(0, 2, 1)) / (norm[:, :, None] * norm[:, None, :]))
                    key = np.where(meet & (s > least[at][:, :, None]), -s, np.inf)
                    if m > width:
                        key[key > np.partition(key, width - 1, 2)[:, :, width - 1 : width]] = np.inf
                    g, i, j = np.nonzero(key < np.inf)
                    row, other, got = at[g, i], own[g, j], s[g, i, j]
                    by = np.lexsort((other, -got, row))
                    by = by[np.arange(len(by)) - np.searchsorted(row[by], row[by]) < width]
                    found.append((ids[row[by]], other[by], got[by]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "other", "score"])
        if counted is not None:
            counted.add(n)

    return groups.select("members").mapInArrow(score, PAIRS)


def _shortened(pairs: DataFrame, by: str, most: int, salt: int) -> DataFrame:
    """Up to ``most`` rows of each (``by``, new), by a hash that is another one each round."""
    order = Window.partitionBy(by, "new").orderBy(F.xxhash64("id", "other", F.lit(salt)))
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def knn_graph(gallery: DataFrame, k: int, width: int = 20, sample: int = 10, rounds: int = 10, least_change: float = 0.002, start: int = 40, id_col: str = "vec_id", vector_col: str = "embedding", counted: Accumulator | None = None) -> DataFrame:
    """About the k nearest rows of every row by cosine: (query_id, item_id, score, rank). Checked by recall.

    Rows start with the best of about ``start`` others, in ``DEALS`` groups by hash. In each round a
    row brings together up to ``sample`` of its new and of its old neighbours, and as many of
    the rows whose neighbour it is; of these, pairs with a new one are scored, and what is better than
    the last of a list of ``width`` enters it. Lists are bounded, so a hub costs no more than
    another row. It ends when less than ``least_change`` of all places change, or after ``rounds``.

    Null ids and vectors, vectors of length zero and those with a null or non-finite
    component are left out; of rows that repeat an id the smallest vector counts; ties go
    to the smaller item; an empty table gives no row. ``counted`` adds up the pairs scored.
    """
    spark = gallery.sparkSession
    rows = stored(usable(gallery, id_col, vector_col).select(F.col("id").cast("long").alias("id"), "v").groupBy("id").agg(F.min("v").alias("v")), "vectors")
    n = rows.count()
    if not n:
        return ranked(spark.createDataFrame([], "query_id long, item_id long, score double"), k, True)
    member = F.struct("id", F.lit(True).alias("new"), F.lit(-2.0).alias("least"), "v")
    # One dealing alone would make closed groups, which no neighbour of a neighbour leads out of.
    dealt = rows.withColumn("deal", F.explode(F.sequence(F.lit(1), F.lit(DEALS))))
    groups = dealt.groupBy("deal", F.pmod(F.xxhash64("id", F.negative("deal")), F.lit(max(1, DEALS * n // start))).alias("at")).agg(F.collect_list(member).alias("members"))
    first = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")

    def lists(pairs: DataFrame) -> DataFrame:
        """The best ``width`` of each row; a pair that a list has already is not new."""
        once = pairs.groupBy("id", "other").agg(F.max("score").alias("score"), F.min("new").alias("new"))
        return once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= width).drop("place")

    graph = stored(lists(_tried(groups, width, counted).withColumn("new", F.lit(True))), "graph")
    for step in range(rounds):
        last = graph.groupBy("id").agg(F.when(F.count("*") == width, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        nodes = stored(rows.join(last, "id", "left").select(F.col("id").alias("m"), F.coalesce("least", F.lit(-2.0)).alias("least"), "v"), "nodes")
        ahead = _shortened(graph.select("id", "other", "new"), "id", sample, step).select(F.col("id").alias("at"), F.col("other").alias("m"), "new")
        back = _shortened(graph.select("id", "other", "new"), "other", sample, step).select(F.col("other").alias("at"), F.col("id").alias("m"), "new")
        met = ahead.union(back).groupBy("at", "m").agg(F.max("new").alias("new"))
        groups = met.join(nodes, "m").groupBy("at").agg(F.collect_list(F.struct(F.col("m").alias("id"), "new", "least", "v")).alias("members")).where(F.exists("members", lambda x: x["new"]))
        tried = _tried(groups, width, counted).withColumn("new", F.lit(True))
        graph = stored(lists(graph.withColumn("new", F.lit(False)).union(tried)), "graph")
        if graph.where("new").count() <= least_change * n * width:
            break
    return ranked(graph.select(F.col("id").alias("query_id"), F.col("other").alias("item_id"), "score"), k, True)
