"""Approximate search: cells, projections, product codes, and reduced vectors. Checked by recall, never by equality."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.functions.vectors import cosine
from galleon.operators.pivots import blocks_of, directions, in_cells, met, sampled, spread_out, usable, vectors_of
from galleon.operators.search import best, ranked, scores, slices
from galleon.sources.shared import stored

#: Cells at most: their means are held by every task.
MOST_CELLS = 4096
#: A query that is sent to a cell takes the memory of so many scores, about.
SENT = 16
FOUND = "query_id long, item_id long, score double"


def means(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Means of up to ``count`` groups of the rows of a bounded sample, by k-means from rows far apart."""
    rng = np.random.default_rng(seed)
    some = sample[rng.permutation(len(sample))[: 16 * count]]
    centres = some[rng.permutation(len(some))[:count]]
    if count > 1:
        half = spread_out(directions(some + 1e-12), max(1, count // 2))
        centres[: len(half)] = half
    for _ in range(rounds):
        own = ((centres * centres).sum(1)[None, :] - 2 * (sample @ centres.T)).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def tail(x: np.ndarray) -> np.ndarray:
    """About the share of a normal variable above x."""
    a = np.abs(x)
    q = 0.5 * np.exp(-0.717 * a - 0.416 * a * a)
    return np.where(x >= 0, q, 1 - q)


class Cells:
    """Cells of a gallery by the mean of their directions, and what they can be expected to hold."""

    def __init__(self, means_: np.ndarray):
        self.means, self.centres = means_, directions(means_ + 1e-12)
        self.sizes = np.zeros(len(means_), np.int64)

    def first(self, directions_: np.ndarray, least: int) -> np.ndarray:
        """(queries, cells): the cells of the largest expected cosine that hold ``least`` rows together."""
        expected = np.where(self.sizes > 0, directions_ @ self.means.T, -np.inf)
        order = np.argsort(-expected, 1, kind="stable")
        before = np.cumsum(self.sizes[order], 1) - self.sizes[order]
        out = np.zeros(expected.shape, bool)
        np.put_along_axis(out, order, before < least, 1)
        return out & (self.sizes > 0)

    def held(self, directions_: np.ndarray, score: np.ndarray) -> np.ndarray:
        """(queries, cells): rows with a cosine above ``score`` that each cell can be expected to hold.

        The cosines of a query with the rows of a cell spread around that with
        their mean, evenly in all directions.
        """
        spread = np.sqrt(np.maximum(1 - (self.means**2).sum(1), 1e-9) / self.means.shape[1])
        return self.sizes * tail((score[:, None] - directions_ @ self.means.T) / spread)

    def further(self, directions_: np.ndarray, score: np.ndarray, seen: np.ndarray, k: int, missed: float) -> np.ndarray:
        """(queries, cells): the cells to look at besides ``seen``, so that ``missed`` of the best k rows are expected in the rest.

        ``score`` is that of the k-th best row so far. If the cells are expected to
        hold more than k better rows, the score above which there are k takes its place.
        """
        low, high = score.astype(float), np.ones(len(score))
        for _ in range(20):
            middle = (low + high) / 2
            many = self.held(directions_, middle).sum(1) > k
            low, high = np.where(many, middle, low), np.where(many, high, middle)
        held = np.where(seen, 0, self.held(directions_, low))
        order = np.argsort(held, 1, kind="stable")
        rest = np.cumsum(np.take_along_axis(held, order, 1), 1)
        out = np.zeros(held.shape, bool)
        np.put_along_axis(out, order, rest > missed * k, 1)
        return out & (held > 0)


def fit_cells(rows: DataFrame, count: int | None, fit_rows: int) -> tuple[Cells, DataFrame, np.ndarray]:
    """Cells fitted on a bounded sample, all ``rows`` (id, v) in them, and the sample."""
    n = rows.count()
    sample = sampled(rows, n, fit_rows)
    cells = Cells(means(sample, count or max(1, min(MOST_CELLS, round(n**0.5)))))
    placed = stored(in_cells(rows, cells.centres), "cells")
    for r in placed.groupBy("cell").count().collect():
        cells.sizes[r["cell"]] = r["count"]
    return cells, placed, sample


def _asking(asked: DataFrame, cells: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``asked`` (id, v, score), once for each of the ``cells`` that ``choose(directions, scores)`` names: (id, v, cell, dist).

    A query can go to most cells, so some are sent at a time.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch.num_rows, SENT * cells):
                ids, v, score = (batch.column(c).slice(some.start, some.stop - some.start) for c in range(3))
                row, cell = np.nonzero(choose(directions(vectors_of(v)), np.array(score)))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(at), v.take(at), pa.array(cell.astype(np.int32)), pa.array(np.zeros(len(row)))], ["id", "v", "cell", "dist"])

    return asked.select("id", "v", "score").mapInArrow(send, f"id {dict(asked.dtypes)['id']}, v {dict(asked.dtypes)['v']}, cell int, dist double")


def _best_in_blocks(pairs: DataFrame, score: Callable, k: int, counted: Accumulator | None) -> DataFrame:
    """The best k of each query in each pair of blocks of ``met``, by ``score(item column, cell)(query vectors)``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                ids, item_ids = (np.array(batch.column(c)[row].values) for c in (0, 3))
                q = np.array(batch.column(1)[row].values.flatten(), np.float64).reshape(len(ids), -1)
                n += len(ids) * len(item_ids)
                scored, found = score(batch.column(4)[row].values, batch.column(5)[row].as_py()), []
                for part in slices(len(ids), len(item_ids)):
                    s = scored(q[part])
                    s[ids[part][:, None] == item_ids[None, :]] = np.nan
                    found += [(np.full(len(p), ids[part][i]), item_ids[p], s[i, p]) for i, p in best(s, item_ids, k, True)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "item_id", "score"])
        if counted is not None:
            counted.add(n)

    columns = ["q_ids", "q_v", "q_dist", "g_ids", "g_v", "cell"]
    return pairs.select(*columns).mapInArrow(keep, FOUND)


def _in_two_steps(asked: DataFrame, cells: Cells, items: DataFrame, score: Callable, k: int, missed: float, counted: Accumulator | None) -> DataFrame:
    """The best k of each query: among its first cells, then in those that can hold a better row than the last of these."""
    least = 4 * k
    first = _asking(asked.withColumn("score", F.lit(-1.0)), len(cells.means), lambda d, _: cells.first(d, least))
    found = stored(ranked(_best_in_blocks(met(blocks_of(first, "q"), items), score, k, counted), k, True), "found")
    last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    known = asked.join(last, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("least", F.lit(-1.0)).alias("score"))
    more = _asking(known, len(cells.means), lambda d, s: cells.further(d, s, cells.first(d, least), k, missed))
    other = _best_in_blocks(met(blocks_of(more, "q"), items), score, k, counted)
    return ranked(found.drop("rank").union(other), k, True)


def ivf_topk(queries: DataFrame, gallery: DataFrame, k: int, cells: int | None = None, missed: float = 0.05, fit_rows: int = 20_000, counted: Accumulator | None = None) -> DataFrame:
    """Rows in the cells that can be expected to hold a query's nearest ones, ranked exactly: (query_id, item_id, score, rank).

    There are about as many ``cells`` as the square root of the rows, by k-means on
    about ``fit_rows`` rows; every row is in the index. A query looks into its
    nearest cells first. The score of the k-th best row there, and the expected
    spread of scores in every other cell, say how many better rows each of them
    holds; the query looks into the richest until ``missed`` of k rows are expected
    in the rest. Well-parted cells are few, vectors without structure need many.

    Null ids and vectors, vectors of length zero and those with a null or non-finite
    component are left out, a row never finds its own id, ties go to the smaller
    item, and an empty table gives no row. ``counted`` adds up the pairs scored.
    """
    rows, asked = usable(gallery), stored(usable(queries), "asked")
    if rows.isEmpty():
        return ranked(gallery.sparkSession.createDataFrame([], FOUND), k, True)
    index, placed, _ = fit_cells(rows, cells, fit_rows)
    items = stored(blocks_of(placed, "g"), "blocks")

    def score(vectors: pa.Array, cell: int) -> Callable[[np.ndarray], np.ndarray]:
        held = vectors_of(vectors)
        return lambda q: scores(q, held, "cosine")

    return _in_two_steps(asked, index, items, score, k, missed, counted)


class ProductCodes:
    """A byte for each part of a vector: the nearest of up to 256 codewords for what its cell's mean leaves of it."""

    def __init__(self, sample: np.ndarray, cells: Cells, places: int, seed: int = 2):
        self.cell_means, self.width, self.places = cells.means, places, sample.shape[1]
        own = (sample @ cells.centres.T).argmax(1)
        rest = self._parts(sample - cells.means[own])
        self.words = np.stack([means(rest[:, k], min(256, max(1, len(rest) // 4)), 6, seed + k) for k in range(rest.shape[1])])

    def _parts(self, v: np.ndarray) -> np.ndarray:
        """(rows, parts, width); places that the last part lacks are zero."""
        return np.pad(v, ((0, 0), (0, -self.places % self.width))).reshape(len(v), -1, self.width)

    def codes(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self._parts(unit - self.cell_means[cell])
        lengths = (self.words**2).sum(2)
        return np.stack([(lengths[k] - 2 * rest[:, k] @ self.words[k].T).argmin(1) for k in range(rest.shape[1])], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Cosines of queries with coded rows of a cell: one table of products with the codewords for each query and part."""
        unit = directions(q)
        s = np.repeat((unit @ self.cell_means[cell])[:, None], len(codes), 1)
        parts = self._parts(unit)
        for k in range(parts.shape[1]):
            s += (parts[:, k] @ self.words[k].T)[:, codes[:, k]]
        return s


def pq_topk(queries: DataFrame, gallery: DataFrame, k: int, cells: int | None = None, width: int = 4, rerank: int = 40, missed: float = 0.05, fit_rows: int = 20_000, counted: Accumulator | None = None) -> DataFrame:
    """Search over product codes, the best ``rerank * k`` by code ranked exactly: (query_id, item_id, score, rank).

    The index holds a byte for each ``width`` places of a vector, so 64 floats are
    16 bytes. Cells and codewords are fitted on about ``fit_rows`` rows, every row is
    coded. Queries are kept whole and meet the codes by tables, in the cells that
    ``ivf_topk`` would look into. Vectors are read again for the best ones only.

    What is left out, ties and empty tables are as for ``ivf_topk``; of rows that
    repeat an id all vectors count, the best of an id once.
    """
    rows, asked = usable(gallery), stored(usable(queries), "asked")
    if rows.isEmpty():
        return ranked(gallery.sparkSession.createDataFrame([], FOUND), k, True)
    index, placed, sample = fit_cells(rows, cells, fit_rows)
    coder = ProductCodes(sample, index, width)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = coder.codes(directions(vectors_of(batch.column(1))), np.array(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "dist", "v"])

    coded = placed.select("id", "v", "cell", "dist").mapInArrow(code, f"id {dict(rows.dtypes)['id']}, cell int, dist double, v binary")
    items = stored(blocks_of(stored(coded, "codes"), "g"), "blocks")

    def score(codes: pa.Array, cell: int) -> Callable[[np.ndarray], np.ndarray]:
        held = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
        return lambda q: coder.scores(q, held, cell)

    near = _in_two_steps(asked, index, items, score, rerank * k, missed, counted).select("query_id", "item_id").distinct()
    both = stored(near, "near").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").join(rows.select(F.col("id").alias("item_id"), F.col("v").alias("b")), "item_id")
    exact = both.groupBy("query_id", "item_id").agg(F.max(F.round(cosine(F.col("a"), F.col("b")), 6)).alias("score"))
    return ranked(exact, k, True)


def sign_codes(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, tables): the signs of the projections of each table, as bits."""
    bits = planes.shape[1]
    return np.stack([((v @ p.T > 0).astype(np.int64) << np.arange(bits)).sum(1) for p in planes], 1)


def shared_before(a: np.ndarray, b: np.ndarray, table: int, flips: int) -> np.ndarray:
    """(rows of a, rows of b): whether an earlier table than ``table`` has the two within ``flips`` bits already."""
    seen = np.zeros((len(a), len(b)), bool)
    for t in range(table):
        seen |= np.bitwise_count(a[:, None, t] ^ b[None, :, t]) <= flips
    return seen


def sign_planes(sample: np.ndarray, tables: int, flips: int, k: int, recall: float, bits: int | None, seed: int = 3) -> np.ndarray:
    """Random directions (tables, bits, places); unless given, the most bits for which the sample finds ``recall`` of its own neighbours."""
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, 24, sample.shape[1]))
    if bits:
        return planes[:, :bits]
    q = sample[:: max(1, len(sample) // 200)]
    s = q @ sample.T
    s[s > 1 - 1e-9] = -2  # itself
    near = np.argsort(-s, 1)[:, : min(k, len(sample))]
    for bits in range(24, flips + 1, -1):
        codes, own = (sign_codes(v, planes[:, :bits]) for v in (sample, q))
        found = np.take_along_axis(shared_before(own, codes, tables, flips), near, 1)
        if found.mean() >= recall:
            return planes[:, :bits]
    return planes[:, : flips + 1]


def lsh_topk(queries: DataFrame, gallery: DataFrame, k: int, tables: int = 6, bits: int | None = None, flips: int = 1, recall: float = 0.95, fit_rows: int = 4_000, counted: Accumulator | None = None) -> DataFrame:
    """Rows that share a bucket of signs of random projections with a query, ranked exactly: (query_id, item_id, score, rank).

    A row has a bucket in each of ``tables``, and a query also looks into those that
    differ in up to ``flips`` signs. Unless ``bits`` is given, buckets are as small as
    a sample of ``fit_rows`` rows allows when ``recall`` of its own neighbours are to
    be found. Two rows are scored in the first table that brings them together and
    in no other.

    What is left out, ties and empty tables are as for ``ivf_topk``.
    """
    rows, asked = usable(gallery), usable(queries)
    n = rows.count()
    if not n:
        return ranked(gallery.sparkSession.createDataFrame([], FOUND), k, True)
    planes = sign_planes(sampled(rows, n, fit_rows), tables, flips, k, recall, bits)
    near = np.array([sum(1 << b for b in c) for m in range(flips + 1) for c in combinations(range(planes.shape[1]), m)])

    def bucketed(df: DataFrame, flip: np.ndarray) -> DataFrame:
        """A row for each bucket; ``v`` becomes (vector, codes of all tables)."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes = sign_codes(vectors_of(batch.column(1)), planes)
                    cell = ((codes[:, :, None] ^ flip) | (np.arange(tables)[None, :, None] << 32)).reshape(len(codes), -1)
                    at = pa.array(np.repeat(np.arange(len(codes)), cell.shape[1]))
                    lists = pa.array(list(codes), pa.list_(pa.int64()))
                    both = pa.StructArray.from_arrays([batch.column(1).take(at), lists.take(at)], ["v", "codes"])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), both, pa.array(cell.ravel()), pa.array(np.zeros(cell.size))], ["id", "v", "cell", "dist"])

        kinds = dict(df.dtypes)
        return df.select("id", "v").mapInArrow(place, f"id {kinds['id']}, v struct<v:{kinds['v']},codes:array<long>>, cell long, dist double")

    pairs = met(blocks_of(bucketed(asked, near), "q"), blocks_of(bucketed(rows, near[:1]), "g")).select("q_ids", "q_v", "g_ids", "g_v", "cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for row in range(batch.num_rows):
                ids, item_ids = (np.array(batch.column(c)[row].values) for c in (0, 2))
                q, g = (batch.column(c)[row].values for c in (1, 3))
                q_codes, g_codes = (np.array(x.field("codes").flatten()).reshape(len(x), tables) for x in (q, g))
                new = ~shared_before(q_codes, g_codes, batch.column(4)[row].as_py() >> 32, flips) & (ids[:, None] != item_ids[None, :])
                i, j = np.nonzero(new)
                total += len(i)
                if len(i):
                    s = np.full(new.shape, np.nan)
                    s[i, j] = scores(vectors_of(q.field("v")), vectors_of(g.field("v")), "cosine")[i, j]
                    found = [(np.full(len(p), ids[at]), item_ids[p], s[at, p]) for at, p in best(s, item_ids, k, True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "item_id", "score"])
        if counted is not None:
            counted.add(total)

    return ranked(pairs.mapInArrow(score, FOUND), k, True)


def pca_reduce(gallery: DataFrame, parts: int = 16, fit_rows: int = 20_000) -> DataFrame:
    """Vectors projected on their first ``parts`` principal directions: (vec_id, embedding).

    The sign of a direction is such that its largest place is positive. Rows
    without a vector are left out; an empty table gives no row.
    """
    known = gallery.where(F.col("embedding").isNotNull())
    rows = known.select("vec_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if rows.isEmpty():
        return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    every = max(1, -(-rows.count() // fit_rows))
    model = PCA(k=parts, inputCol="features", outputCol="reduced").fit(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0))
    vectors = model.pc.toArray()
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    signed = F.transform(vector_to_array("reduced"), lambda x, i: x * F.array(*[F.lit(float(v)) for v in signs])[i])
    return model.transform(rows).select("vec_id", signed.alias("embedding"))
