"""Exact search: a set of query vectors against a whole gallery, in blocks.

Vectors are packed by hash into blocks of a bounded number of rows. A task scores
a pair of blocks with matrix arithmetic and keeps what the operator asks for. A
single block of queries is broadcast; several meet the gallery by an equi-join on
(query block, stripe of gallery blocks), so that a key has one block of queries
and a bounded number of gallery blocks, whatever the size of either table. No
vector passes through the driver, and no row of a pair of vectors is made unless
it is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, on average.
BLOCK = 2048
#: Gallery blocks in a stripe.
STRIPE = 8
#: Scores that a task holds at once, about.
SCORES = 1 << 19


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero."""
    return np.trunc(x * 1e6 + np.copysign(0.5, x)) / 1e6


def _cosine(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (q @ g.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((g * g).sum(1))[None, :])


def _by_rows(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda q, g: np.stack([f(row, g) for row in q])


#: Score and whether a larger one is better.
METRICS: dict[str, tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], bool]] = {
    "cosine": (_cosine, True),
    "ip": (lambda q, g: q @ g.T, True),
    "l2": (_by_rows(lambda row, g: np.sqrt(((g - row) ** 2).sum(1))), False),
    "l1": (_by_rows(lambda row, g: np.abs(g - row).sum(1)), False),
    "hamming": (_by_rows(lambda row, g: (np.sign(g) != np.sign(row)).sum(1).astype(float)), False),
}


def scores(queries: np.ndarray, gallery: np.ndarray, metric: str) -> np.ndarray:
    """Scores to six decimals, so that equal ones tie everywhere; NaN (a vector of length zero) stays."""
    return rounded(METRICS[metric][0](queries, gallery))


def packed(rows: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows gathered in blocks by a hash of the first column: (name, {name}_rows), and the number of blocks."""
    blocks = max(1, -(-rows.count() // BLOCK))
    number = F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).cast("int").alias(name)
    return rows.select(number, *columns).groupBy(name).agg(*[F.collect_list(c).alias(f"{name}_{c}") for c in columns]), blocks


def slices(rows: int, columns: int) -> Iterator[slice]:
    """Parts of the rows of a matrix with ``SCORES`` scores at most, and one row at least: its copies while it is ranked take a task's memory."""
    step = max(1, SCORES // max(1, columns))
    return (slice(low, min(low + step, rows)) for low in range(0, rows, step))


def in_blocks(queries: DataFrame, gallery: DataFrame, keep: Callable, schema: str, id_col: str = "vec_id", vector_col: str = "embedding", extra: str | None = None) -> DataFrame:
    """Apply ``keep(query ids, query vectors, item ids, item vectors, extra)`` to every pair of blocks,
    some queries at a time.

    ``keep`` yields tuples of arrays, the columns of ``schema``. Rows with a null id
    or vector are left out; rows that repeat an id are rows of their own.
    """

    def whole(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select(*columns).dropna()

    own, n = packed(whole(queries, [id_col, vector_col]), "q", [id_col, vector_col])
    items, m = packed(whole(gallery, [id_col, vector_col, *([extra] if extra else [])]), "g", [id_col, vector_col, *([extra] if extra else [])])
    items = items.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if n == 1:
        pairs = items.join(F.broadcast(own), "q")  # about BLOCK rows, whatever the tables' sizes
    else:
        stripes = F.sequence(F.lit(0), F.lit((m - 1) // STRIPE))
        meets = items.withColumn("stripe", F.floor(F.col("g") / STRIPE).cast("int"))
        pairs = meets.join(own.withColumn("stripe", F.explode(stripes)).hint("merge"), ["q", "stripe"])
    names = [x.split()[0] for x in schema.split(", ")]

    def flat(column: pa.Array, row: int) -> np.ndarray:
        return np.array(column[row].values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, item_ids = flat(batch.column(0), row), flat(batch.column(2), row)
                vectors, items = (np.array(batch.column(c)[row].values.flatten(), np.float64).reshape(n, -1) for c, n in ((1, len(ids)), (3, len(item_ids))))
                other = flat(batch.column(4), row) if extra else None
                kept = [cols for part in slices(len(ids), len(item_ids)) for cols in keep(ids[part], vectors[part], item_ids, items, other)]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)

    columns = [f"q_{id_col}", f"q_{vector_col}", f"g_{id_col}", f"g_{vector_col}", *([f"g_{extra}"] if extra else [])]
    return pairs.select(*columns).mapInArrow(score, schema)


def best(s: np.ndarray, ids: np.ndarray, k: int, larger: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores, the places of the best k: by score, then by smaller id. NaN never counts."""
    key = np.where(np.isnan(s), np.inf, -s if larger else s)
    for row, own in enumerate(key):
        if len(own) > k:
            limit = np.partition(own, k - 1)[k - 1]
            places = np.flatnonzero(own <= limit)
        else:
            places = np.arange(len(own))
        places = places[own[places] < np.inf]
        yield row, places[np.lexsort((ids[places], own[places]))][:k]


def ranked(candidates: DataFrame, k: int, larger: bool, *also: str) -> DataFrame:
    """(query_id, item_id, score, rank) of the best k of each query; ties go to the smaller item."""
    order = [F.col("score").desc() if larger else F.col("score").asc(), F.col("item_id").asc()]
    best = Window.partitionBy("query_id", *also).orderBy(*order)
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def topk(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "cosine", include_self: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k gallery rows nearest to each query: (query_id, item_id, score, rank).

    Every query meets every row. Scores are rounded to six decimals before they
    are ranked. Null vectors, and for cosine vectors of length zero, are left
    out. A k beyond the gallery returns the whole gallery.
    """
    larger = METRICS[metric][1]

    def keep(ids, vectors, item_ids, items, _):
        s = scores(vectors, items, metric)
        if not include_self:
            s[ids[:, None] == item_ids[None, :]] = np.nan
        found = [(np.full(len(p), ids[row]), item_ids[p], s[row, p]) for row, p in best(s, item_ids, k, larger)]
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

    return ranked(in_blocks(queries, gallery, keep, "query_id long, item_id long, score double", id_col, vector_col), k, larger)


def filtered_topk(queries: DataFrame, gallery: DataFrame, predicate, k: int, metric: str = "cosine") -> DataFrame:
    """``topk`` among the gallery rows that meet a predicate, which reaches the scan."""
    return topk(queries, gallery.where(predicate), k, metric)


def topk_per_label(queries: DataFrame, gallery: DataFrame, k: int, label_col: str = "label") -> DataFrame:
    """The best k by cosine of each query within each label: (query_id, label, item_id, score, rank).

    Ties go to the smaller item. Null labels, ids or vectors and vectors of length
    zero are left out; a label with fewer rows gives all of them.
    """

    def keep(ids, vectors, item_ids, items, labels):
        s = scores(vectors, items, "cosine")
        s[ids[:, None] == item_ids[None, :]] = np.nan
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            found = [(np.full(len(p), ids[row]), np.full(len(p), label), item_ids[own[p]], s[row, own[p]]) for row, p in best(s[:, own], item_ids[own], k, True)]
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

    found = in_blocks(queries, gallery.where(F.col(label_col).isNotNull()), keep, "query_id long, label int, item_id long, score double", extra=label_col)
    return ranked(found, k, True, "label")


def exact_dups(gallery: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors that occur more than once: (first_id, copies). Rows without a vector are left out; an empty table gives no row."""
    return gallery.where(F.col(vector_col).isNotNull()).groupBy(vector_col).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")
