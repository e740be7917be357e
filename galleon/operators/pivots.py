"""Exact metric joins with triangle-inequality bounds from pivots.

Vectors are taken as directions, where the Euclidean distance d and the cosine c
belong together as d * d = 2 - 2 * c. Each gallery row lies in the cell of its
nearest pivot. A row whose partners are within r goes to a cell only if the
cell's least and largest distance from its pivot leave room for one, and if the
cell's pivot is at most 2r farther away than its own. In a cell only rows whose distance
from the pivot differs by r or less are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.operators.search import scores
from galleon.sources.shared import stored

#: Pivots at most; all of them, and a bound for each cell, are held by every task.
MOST_PIVOTS = 4096
#: Rows that pivots are chosen from, about.
FIT_ROWS = 20_000
#: Rows of a block, about.
BLOCK = 2048
#: Queries that share a window of a block.
CHUNK = 64
#: Slack of distances and scores for rounding.
SLACK = 2e-6


def directions(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between directions."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def radius(score: float) -> float:
    """Directions with a rounded cosine of ``score`` or more are within this distance."""
    return float(np.sqrt(max(0.0, 2 - 2 * min(1.0, score - SLACK)))) + SLACK


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a finite vector that has a direction."""
    v = F.col(vector_col)
    # In Spark's order NaN is above every number, so it fails like an infinity.
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


def sampled(rows: DataFrame, n: int, bound: int = FIT_ROWS) -> np.ndarray:
    """The directions of about ``bound`` rows, by a hash of the id."""
    found = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // bound)))) == 0).orderBy("id").select("v").toArrow().column(0)
    return directions(np.array(found.to_pylist(), np.float64))


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` pivots: each next one is the row of the sample farthest from those chosen."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        k = int(far.argmax())
        if far[k] <= SLACK:
            break
        chosen.append(k)
        far = np.minimum(far, distances(sample, sample[k : k + 1])[:, 0])
    return sample[chosen]


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, v) with the cell of the nearest pivot and the distance from it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(directions(vectors_of(batch.column(1))), pivots)
                cell = d.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "dist"])

    return rows.select("id", "v").mapInArrow(place, f"id {dict(rows.dtypes)['id']}, v {dict(rows.dtypes)['v']}, cell int, dist double")


def cell_bounds(cells: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest distance from the pivot, and rows, of each cell; an empty cell has room for nothing."""
    low, high, n = np.full(count, np.inf), np.full(count, -np.inf), np.zeros(count, np.int64)
    for r in cells.groupBy("cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).collect():
        low[r.cell], high[r.cell], n[r.cell] = r.low, r.high, r.n
    return low, high, n


def reached(d: np.ndarray, low: np.ndarray, high: np.ndarray, r: np.ndarray | float) -> np.ndarray:
    """Which cells can hold a row within ``r`` of rows at distances ``d`` (rows, pivots)."""
    r = np.broadcast_to(np.asarray(r, float), len(d))[:, None] + SLACK
    return (d - r <= high) & (d + r >= low) & (d - d.min(1)[:, None] <= 2 * r)


def sent(rows: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, r: float, above: bool = False, nearest: int | None = None, after: int = 0) -> DataFrame:
    """``rows`` (id, v), once for each cell they reach within ``r``: (id, v, cell, dist).

    With ``above``, where rows have a cell, only cells beyond it count, so that each
    two cells meet once. Of the cells that count, nearest first, those from place
    ``after`` on are meant, and ``nearest`` of them at most.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(directions(vectors_of(batch.column(1))), pivots)
                meant = np.arange(len(pivots)) > np.array(batch.column(2))[:, None] if above else np.ones(d.shape, bool)
                order = np.argsort(np.where(meant, d, np.inf), 1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(d.shape[1])[None, :], 1)
                goes = meant & reached(d, low, high, r) & (place >= after)
                if nearest is not None:
                    goes &= place < after + nearest
                row, cell = np.nonzero(goes)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(d[row, cell])], ["id", "v", "cell", "dist"])

    columns = ["id", "v", "cell"] if above else ["id", "v"]
    return rows.select(*columns).mapInArrow(send, f"id {dict(rows.dtypes)['id']}, v {dict(rows.dtypes)['v']}, cell int, dist double")


def blocks_of(cells: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """Rows of a cell gathered in blocks by a hash of their id: (cell, {name}_part, {name}_parts, {name}_ids, {name}_v, {name}_dist)."""
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = cells.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    found = own.groupBy("cell", "part").agg(F.first("parts").alias("parts"), *[F.collect_list(c).alias(c) for c in ("id", "v", "dist")])
    return found.select("cell", F.col("part").alias(f"{name}_part"), F.col("parts").alias(f"{name}_parts"), F.col("id").alias(f"{name}_ids"), F.col("v").alias(f"{name}_v"), F.col("dist").alias(f"{name}_dist"))


def met(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Every two blocks of a cell: (q_ids, q_v, q_dist, g_ids, g_v, g_dist, own, cell)."""
    stripes = asked.join(items.groupBy("cell").agg(F.max("g_parts").alias("parts")), "cell")
    pairs = stripes.withColumn("g_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(items, ["cell", "g_part"])
    return pairs.select("q_ids", "q_v", "q_dist", "g_ids", "g_v", "g_dist", F.lit(False).alias("own"), "cell")


def met_itself(items: DataFrame) -> DataFrame:
    """Every two blocks of one cell once, and each block with itself; columns as of ``met``."""
    first = items.withColumn("q_part", F.explode(F.sequence("g_part", F.col("g_parts") - 1)))
    first = first.select("cell", F.col("q_part").alias("g_part"), F.col("g_part").alias("from"), *[F.col(f"g_{c}").alias(f"q_{c}") for c in ("ids", "v", "dist")])
    return first.join(items, ["cell", "g_part"]).select("q_ids", "q_v", "q_dist", "g_ids", "g_v", "g_dist", (F.col("from") == F.col("g_part")).alias("own"))


def candidates(pairs: DataFrame, r: float, keep, schema: str, counted: Accumulator | None = None) -> DataFrame:
    """Score the pairs of ``met`` whose distances from the pivot differ by ``r`` at most.

    ``keep(query ids, item ids, scores)`` gets a matrix for some queries and the
    window of items around them, NaN where an id meets itself, and yields columns
    of ``schema``. ``counted`` adds up the pairs that are scored.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    r += SLACK

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                ids, q_dist, item_ids, g_dist = (np.array(batch.column(c)[row].values) for c in (0, 2, 3, 5))
                q, g = (np.array(batch.column(c)[row].values.flatten(), np.float64).reshape(k, -1) for c, k in ((1, len(ids)), (4, len(item_ids))))
                own = batch.column(6)[row].as_py()
                near = np.argsort(g_dist, kind="stable")
                item_ids, g, g_dist = item_ids[near], g[near], g_dist[near]
                order = np.argsort(q_dist, kind="stable")
                for low in range(0, len(order), CHUNK):
                    some = order[low : low + CHUNK]
                    a, b = np.searchsorted(g_dist, q_dist[some[0]] - r, "left"), np.searchsorted(g_dist, q_dist[some[-1]] + r, "right")
                    if a == b:
                        continue
                    n += len(some) * int(b - a)
                    s = scores(q[some], g[a:b], "cosine")
                    s[(ids[some][:, None] >= item_ids[a:b]) if own else (ids[some][:, None] == item_ids[a:b])] = np.nan
                    for cols in keep(ids[some], item_ids[a:b], s):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        if counted is not None:
            counted.add(n)

    return pairs.mapInArrow(score, schema)


def _fitted(rows: DataFrame, pivots: int | None) -> tuple[np.ndarray, int]:
    n = rows.count()
    count = pivots or max(1, min(MOST_PIVOTS, round(n**0.5)))
    return (spread_out(sampled(rows, n), count), n) if n else (np.zeros((0, 0)), 0)


def range_search(queries: DataFrame, gallery: DataFrame, least: float, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", counted: Accumulator | None = None) -> DataFrame:
    """All gallery rows with a cosine of at least ``least`` to a query: (query_id, item_id, score).

    About as many ``pivots`` as the square root of the rows, ``MOST_PIVOTS`` at
    most, are chosen from a bounded sample; the result does not depend on them. A
    row never finds its own id. Null ids or vectors, vectors of length zero and
    those with a null or non-finite component find and are found by nothing; rows
    that repeat an id are rows of their own; an empty table gives no row. All
    vectors have the same number of places.
    """
    schema = "query_id long, item_id long, score double"
    asked, rows = usable(queries, id_col, vector_col), usable(gallery, id_col, vector_col)
    chosen, n = _fitted(rows, pivots)
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    cells, r = stored(in_cells(rows, chosen), "cells"), radius(least)
    low, high, _ = cell_bounds(cells, len(chosen))

    def keep(ids, item_ids, s):
        row, col = np.nonzero(s >= least)
        if len(row):
            yield ids[row], item_ids[col], s[row, col]

    pairs = met(blocks_of(sent(asked, chosen, low, high, r), "q"), blocks_of(cells, "g"))
    return candidates(pairs, r, keep, schema, counted)


def top_pairs(gallery: DataFrame, n: int, pivots: int | None = None, ahead: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", counted: Accumulator | None = None) -> DataFrame:
    """The n closest pairs by cosine: (a_id, b_id, score) with a_id < b_id; ties go to smaller ids.

    Three rounds tighten the bound. The pairs inside cells give a first one; then
    rows go to the nearest ``ahead`` of the cells that the bound lets them reach;
    under the bound that this gives they go to the others. A round keeps ``n`` rows
    at most of two blocks, and ``n`` in all, so only one score comes to the driver.

    Rows that share an id make no pair with each other. Null ids or vectors, vectors
    of length zero and those with a null or non-finite component are in no pair;
    fewer than two rows give none. All vectors have the same number of places.
    """
    schema = "a_id long, b_id long, score double"
    rows = usable(gallery, id_col, vector_col)
    chosen, count = _fitted(rows, pivots)
    if count < 2 or n < 1:
        return gallery.sparkSession.createDataFrame([], schema)
    cells = stored(in_cells(rows, chosen), "cells")
    low, high, _ = cell_bounds(cells, len(chosen))
    items = blocks_of(cells, "g")

    def keep(bound: float):
        def best(ids, item_ids, s):
            s = np.where(np.isnan(s), -np.inf, s)
            limit = max(bound, np.partition(s.ravel(), -n)[-n] if s.size > n else -np.inf)
            row, col = np.nonzero((s >= limit) & (s > -np.inf))
            a, b = np.minimum(ids[row], item_ids[col]), np.maximum(ids[row], item_ids[col])
            order = np.lexsort((b, a, -s[row, col]))[:n]
            if len(order):
                yield a[order], b[order], s[row[order], col[order]]

        return best

    found, bound = gallery.sparkSession.createDataFrame([], schema), -np.inf
    for step in range(3):
        r = radius(bound) if bound > -np.inf else 2.0
        if step:
            more = sent(cells, chosen, low, high, r, True, ahead if step == 1 else None, 0 if step == 1 else ahead)
            pairs = met(blocks_of(more, "q"), items)
        else:
            pairs = met_itself(items)
        found = found.union(candidates(pairs, r, keep(bound), schema, counted)).orderBy(F.col("score").desc(), "a_id", "b_id").limit(n)
        if step == 2:
            return found
        found = stored(found, "pairs")
        last = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        bound = last.least if last.n == n else -np.inf
    return found
