"""Image search by visual words: an inverted index with upper bounds that end a search early."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleon.operators.search import ranked, rounded
from galleon.sources.shared import stored

#: Words of a vocabulary at most: every task holds them.
MOST_WORDS = 65_536
#: Images of a block, about.
BLOCK = 64
#: Images of a stripe and queries of a group, about; postings of either for each of these at most, about.
STRIPE, ASKED, POSTINGS_A_ROW = 4096, 2048, 128
#: Places of a whole matrix of queries and words at most, for each posting: beyond, postings are gathered, for so many queries at a time.
DENSE, CHUNK = 16, 64
#: Tasks at most that groups and stripes meet in.
TASKS = 1024
#: Scores that wait to be ranked, about.
WAITING = 262_144
#: Slack of scores for rounding.
SLACK = 2e-6


def visual_words(tiles: DataFrame, vocabulary: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, word): the nearest word of each tile by squared distance of samples; ties go to the smaller word.

    ``vocabulary`` has (word, samples), ``MOST_WORDS`` rows at most. Tiles of another
    size than the words, null tiles and null ids give no row.
    """
    known = vocabulary.dropna().orderBy("word").limit(MOST_WORDS + 1).collect()
    if len(known) > MOST_WORDS:
        raise ValueError(f"a vocabulary holds {MOST_WORDS} words at most")
    words = np.array([r.word for r in known], np.int32)
    size = len(known[0].samples) if known else 0
    held = np.array([list(bytes(r.samples)) for r in known], np.float64).reshape(len(known), size)
    lengths = (held * held).sum(1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words[(lengths - 2 * x @ held.T).argmin(1)])], [id_col, "word"])

    fits = tiles.where(F.col(id_col).isNotNull() & (F.octet_length("samples") == size) & F.lit(bool(known)))
    return fits.select(id_col, "samples").mapInArrow(nearest, f"{id_col} {dict(tiles.dtypes)[id_col]}, word int")


def weighted(words: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, word, weight): tf * ln(N / df) of an image's words, scaled to length one; words in every image weigh nothing and are left out."""
    tf = words.groupBy(id_col, "word").agg(F.count("*").alias("tf"))
    tf = stored(tf, "terms")
    n = tf.select(id_col).distinct().count()
    df = tf.groupBy("word").agg(F.log(F.lit(float(n)) / F.count("*")).alias("idf")).where("idf > 0")
    raw = tf.join(df, "word").select(id_col, "word", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "word", (F.col("x") / norm).alias("weight"))


class _Rows:
    """Rows of (id, words, weights), as places in a vocabulary that they share."""

    def __init__(self, table: pa.Table, id_col: str):
        found = table.combine_chunks()
        lists = [found.column(c).combine_chunks() for c in ("words", "weights")]
        self.ids = found.column(id_col).to_numpy()
        self.n = np.diff(lists[0].offsets.to_numpy())
        self.words, self.weights = (x.flatten().to_numpy() for x in lists)
        self.row, self.start = np.repeat(np.arange(len(self.n)), self.n), np.cumsum(self.n) - self.n

    def among(self, known: np.ndarray) -> None:
        """Words that are not ``known`` weigh nothing from now on."""
        self.at = np.minimum(np.searchsorted(known, self.words), len(known) - 1)
        self.weights = np.where(known[self.at] == self.words, self.weights, 0.0)
        self.whole = None
        if len(self.n) * len(known) <= DENSE * len(self.words):
            self.whole = np.zeros((len(self.n), len(known)))
            np.add.at(self.whole, (self.row, self.at), self.weights)

    def times(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """(rows, columns): the sums of products of some rows with ``columns`` (words, columns)."""
        if self.whole is not None:
            return self.whole[rows] @ columns
        out = np.empty((len(rows), columns.shape[1]))
        for low in range(0, len(rows), CHUNK):
            some = rows[low : low + CHUNK]
            n = self.n[some]
            first = np.cumsum(n) - n
            take = np.repeat(self.start[some] - first, n) + np.arange(n.sum())
            out[low : low + CHUNK] = np.add.reduceat(self.weights[take][:, None] * columns[self.at[take]], first, 0)
        return out


def _best_of_blocks(queries: pa.Table, images: pa.Table, k: int, first: int, read: Callable[[int, int], None] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, item ids, scores): the best k of some images for each query, by the bounds of the images' blocks.

    A query reads its ``first`` blocks, those with the largest bounds, and then the blocks whose bound
    is not below the k-th score that it has by then. ``read`` gets the postings read, and all.
    """
    q, g = _Rows(queries, "query_id"), _Rows(images, "item_id")
    known = np.unique(g.words)
    q.among(known)
    g_at = np.searchsorted(known, g.words)
    block = np.unique(images.column("block").to_numpy(), return_inverse=True)[1]
    blocks = int(block.max()) + 1
    most = np.zeros((len(known), blocks))
    np.maximum.at(most, (g_at, block[g.row]), g.weights)
    every = np.arange(len(q.ids))
    bounds = q.times(every, most)
    # Places instead of ids: a query's own image, and the order of items for ties.
    place = np.unique(np.concatenate([g.ids, q.ids]), return_inverse=True)[1]
    order, own = place[: len(g.ids)], np.full(place.max() + 1, -1)
    own[order] = np.arange(len(g.ids))
    own = own[place[len(g.ids) :]]
    members = np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block))[:-1])
    postings = np.split(np.argsort(block[g.row], kind="stable"), np.cumsum(np.bincount(block[g.row]))[:-1])
    column = np.zeros(len(g.ids), np.int64)
    for m in members:
        column[m] = np.arange(len(m))
    least, held, waiting, seen = np.full(len(q.ids), -np.inf), [(every[:0], every[:0], np.zeros(0))], 0, [0, 0]
    if read:
        matches = np.zeros((len(known), blocks))
        np.add.at(matches, (g_at, block[g.row]), 1)
        hits = np.add.reduceat((q.weights > 0)[:, None] * matches[q.at], q.start, 0)

    def settle() -> None:
        """Only the best k stay, and the k-th closes blocks."""
        nonlocal held, waiting
        row, item, score = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.lexsort((order[item], -score, row))
        row, item, score = row[by], item[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        least[row[rank == k - 1]] = score[rank == k - 1]
        held, waiting = [(row[rank < k], item[rank < k], score[rank < k])], 0

    def visit(b: int, rows: np.ndarray) -> None:
        nonlocal waiting
        columns = np.zeros((len(known), len(members[b])))
        p = postings[b]
        np.add.at(columns, (g_at[p], column[g.row[p]]), g.weights[p])
        s = q.times(rows, columns)
        mine = np.flatnonzero((own[rows] >= 0) & (block[own[rows]] == b))
        s[mine, column[own[rows[mine]]]] = 0
        i, j = np.nonzero((s > 0) & (s >= least[rows][:, None] - SLACK))
        held.append((rows[i], members[b][j], rounded(s[i, j])))
        waiting += len(i)
        if read:
            seen[0] += int(hits[rows, b].sum())
        if waiting > WAITING:
            settle()

    early = np.zeros(bounds.shape, bool)
    np.put_along_axis(early, np.argsort(-bounds, 1, kind="stable")[:, :first], True, 1)
    for b in range(blocks):
        visit(b, np.flatnonzero(early[:, b] & (bounds[:, b] > 0)))
    settle()
    for b in np.argsort(-bounds.max(0), kind="stable"):
        visit(b, np.flatnonzero(~early[:, b] & (bounds[:, b] > 0) & (bounds[:, b] >= least - SLACK)))
    settle()
    if read:
        read(seen[0], int(hits.sum()))
    row, item, score = held[0]
    return q.ids[row], g.ids[item], score


def word_search(queries: DataFrame, index: DataFrame, k: int, id_col: str = "vec_id", counted: list | None = None) -> DataFrame:
    """The k images most alike to each query by their weighted words: (query_id, item_id, score, rank).

    Both tables have (id, word, weight), weights above zero. Images are gathered in blocks by their heaviest
    word, and the largest weight of each word in a block, times a query's weights, bounds the score of any
    image of the block. Blocks are dealt into stripes of a bounded number of images and postings, and
    queries into groups; a group and a stripe meet in one task. There each query first reads
    the blocks with the largest bounds, enough for k images; the k-th score so far closes
    all blocks whose bound is below it. Only the best k of a query in a stripe leave the task, so
    what is shuffled does not grow with the pairs. ``counted`` gets the number of postings read, and
    of those that a search without bounds would read.

    Images that share no word with a query are not ranked, and an image never finds its
    own id. Scores are rounded to six decimals, ties go to the smaller item. Rows that
    repeat an id count as one image. Null ids and words are left out; an empty table gives no row.
    """
    spark, kind = index.sparkSession, dict(index.dtypes)[id_col]

    def gathered(df: DataFrame, name: str) -> DataFrame:
        lists = [F.collect_list(F.col(c).cast(t)).alias(f"{c}s") for c, t in (("word", "long"), ("weight", "double"))]
        top = F.max(F.struct("weight", F.negative("word").alias("w")))
        return df.select(F.col(id_col).alias(name), "word", "weight").dropna().groupBy(name).agg(*lists, F.negative(top["w"]).alias("top"))

    def groups(df: DataFrame, most: int) -> int:
        """Groups of about ``most`` rows, and of a bounded number of postings."""
        n = df.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        return max(1, -(-n[0] // most), -(-n[1] // (POSTINGS_A_ROW * most)))

    held, asked = stored(gathered(index, "item_id"), "images"), stored(gathered(queries, "query_id"), "asked")
    stripes, blocks, first = groups(held, STRIPE), groups(asked, ASKED), 1 + 2 * k // BLOCK
    parts = held.groupBy("top").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    block = F.concat_ws("/", "top", F.pmod(F.xxhash64("item_id"), F.col("parts")))
    images = held.join(parts, "top").withColumn("block", block).withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
    images = images.select("item_id", "words", "weights", "block", "stripe", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))
    own = asked.select("query_id", "words", "weights", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    # So many tasks, however few bytes: the work is in the pairs.
    tasks = min(blocks * stripes, TASKS)
    images, own = images.repartition(tasks, "q", "stripe"), own.repartition(tasks, "q", "stripe")
    reads = [spark.sparkContext.accumulator(0) for _ in range(2)] if counted is not None else []

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "item_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("query_id").slice(0, 0), right.column("item_id").slice(0, 0), pa.array([], pa.float64())], names)
        found = _best_of_blocks(left, right, k, first, (lambda *n: [a.add(x) for a, x in zip(reads, n, strict=True)]) if reads else None)
        return pa.table([pa.array(x) for x in found], names)

    found = own.groupBy("q", "stripe").cogroup(images.groupBy("q", "stripe")).applyInArrow(search, f"query_id {dict(queries.dtypes)[id_col]}, item_id {kind}, score double")
    if counted is not None:
        found = stored(found, "scores")
        counted[:] = [a.value for a in reads]
    return ranked(found, k, True)
