"""MinHash near-duplicate detection with banding, exact verification and star components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import payload, small_batches, stored, worker_store
from galleon.llm.components import connected_components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(data: bytes, width: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles.

    A-Z are lower-cased; words are parted by ASCII white space. A text with fewer
    words than ``width`` has its whole sequence as one shingle, one without words none.
    """
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _A + h[i : len(words) - k + 1 + i] * _B + _C)
    return np.unique(out)


def _key(x: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.md5(x.tobytes()).digest()


def bands_for(percent: int, rows: int, miss: float = 1e-7) -> int:
    """Bands of ``rows`` minima, so that a pair at the threshold shares no band with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1


class MinHash:
    """``bands * rows`` minima of universal hash functions ``(a * x + b) >> 32`` on 64-bit words."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 64, (bands * rows, 1), np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, (bands * rows, 1), np.uint64)

    def signature(self, x: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(x), 2048):
            least = np.minimum(least, (self.a * x[k : k + 2048] + self.b).min(1))
        return (least >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """64-bit keys of the bands of (n, bands * rows) signatures, as signed integers."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2])
        for k in range(self.rows):
            keys = _mixed(keys * _A + parts[:, :, k] * _B + _C)
        return keys.view(np.int64)


def _described(docs: DataFrame, hashes: MinHash, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, key, n_shingles, bands, sketch): the key stands for the whole set; bands and sketch come once a task for each key."""
    kind = dict(docs.dtypes)[id_col]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = worker_store("minhash")
        seen.clear()
        for batch in batches:
            keys, sizes, where, signatures = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                x = shingles(text.as_py(), width)
                key = _key(x)
                keys.append(key), sizes.append(len(x))
                if len(x) and key not in seen:
                    if len(seen) < 1_000_000:
                        seen[key] = True
                    where.append(row), signatures.append(hashes.signature(x))
            bands, sketches = [None] * len(keys), [None] * len(keys)
            if where:
                full = np.stack(signatures)
                for row, band, sketch in zip(where, hashes.band_keys(full), full.astype(np.uint8), strict=True):
                    bands[row], sketches[row] = band.astype("<i8").tobytes(), sketch.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary()), pa.array(sketches, pa.binary())],
                [id_col, "key", "n_shingles", "bands", "sketch"],
            )

    return docs.select(id_col, payload(text_col).alias("text")).mapInArrow(describe, f"{id_col} {kind}, key binary, n_shingles long, bands binary, sketch binary")


def _band_rows(nodes: DataFrame) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(b, "<i8") for b in batch.column(1).to_pylist()]
            if keys:
                at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(keys), pa.int64())], ["node", "band"])

    return nodes.select("node", "bands").mapInArrow(split, "node long, band long")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the share of their minima that agree, by sketches (the low byte of each minimum)."""
    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches, "node").withColumnRenamed("sketch", "one").join(sketches.toDF("leader", "other"), "leader").select("leader", "node", "one", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(1))], ["leader", "node", "alike"])

    return both.mapInArrow(compare, "leader long, node long, alike double")


def _alike_in_buckets(left: DataFrame, nodes: DataFrame, coarse: float, block: int) -> DataFrame:
    """(leader, node, alike): a spanning forest, for each pair of blocks of a bucket, of the pairs that are ``coarse`` alike."""
    sizes = left.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / block).cast("int").alias("k"))
    sizes = stored(sizes, "buckets")
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    blocks = left.join(sizes, "band").select("node", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct("band", F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).alias("group"))
    held = blocks.join(nodes.select("node", "sketch"), "node").select("group", "node", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        ids = np.unique(table.column("node").to_numpy(), return_index=True)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)[ids[1]]
        found, root = [], np.arange(len(sketch))
        for i in range(len(sketch) - 1):  # a row against all later ones
            alike = (sketch[i + 1 :] == sketch[i]).mean(1)
            for j in np.flatnonzero((alike >= coarse) & (root[i + 1 :] != root[i])).tolist():
                if root[i + 1 + j] != root[i]:
                    root[root == root[i + 1 + j]] = root[i]
                    found.append((i, i + 1 + j, alike[j]))
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"leader": pa.array(ids[0][np.array(cols[0], int)], pa.int64()), "node": pa.array(ids[0][np.array(cols[1], int)], pa.int64()), "alike": pa.array(cols[2], pa.float64())})

    return held.groupBy("group").applyInArrow(compare, "leader long, node long, alike double")


def _stars(nodes: DataFrame, coarse: float, tight: float, rounds: int, block: int) -> DataFrame:
    """(leader, node, alike): edges such that nodes which share a bucket and are alike end up connected.

    The smallest node of a bucket leads it. A node that is ``coarse`` alike to
    its leader gets an edge, and one that is ``tight`` alike leaves the bucket;
    the others choose their next leader among themselves. As ``tight`` exceeds
    ``coarse`` by more than linked nodes can differ in their likeness to a third,
    a node never leaves without an edge to what its own links are joined to.
    What is left of a bucket after ``rounds`` leaders is compared in blocks, so
    that nothing is dropped.
    """
    left, edges = _band_rows(nodes), []
    for step in range(rounds):
        heads = left.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
        stars = stored(left.join(heads, "band").where("node <> leader"), "stars")
        pairs = stored(_alike(stars.select("leader", "node").distinct(), nodes), "pairs")
        edges.append(pairs.where(F.col("alike") >= coarse))
        left = stored(stars.join(pairs.where(F.col("alike") < tight), ["leader", "node"], "left_semi").select("node", "band"), "left")
        if left.isEmpty():
            return reduce(DataFrame.union, edges)
    return reduce(DataFrame.union, edges).union(stored(_alike_in_buckets(left, nodes, coarse, block), "rest"))


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The smallest set that each other one is connected to by links: pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(ids)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    cols = place[ids]
    owner, cols = owner[cols >= 0], cols[cols >= 0]
    order = np.argsort(cols, kind="stable")
    owner, cols = owner[order], cols[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(cols, (low, low + 4096))
        part = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
        part[owner[a:b], cols[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    left, right = np.nonzero(np.triu(100 * common.astype(np.int64) >= percent * union.astype(np.int64), 1))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(len(sets)) if find(i) != i]


def _star_groups(edges: DataFrame, members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(node, group): each node meets the leader that it is most alike to, in blocks of bounded size."""
    near = members.join(edges.groupBy("node").agg(F.max_by("leader", "alike").alias("leader")), "node")
    sizes = near.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).cast("int").alias("k"))
    sizes = stored(sizes, "leaders")

    def name(part):
        return F.concat_ws("/", F.lit("star"), "leader", part)

    own = near.join(sizes, "leader").select("node", name(F.pmod(F.xxhash64("node"), F.col("k"))).alias("group"))
    return own.union(sizes.select("leader", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), name))))


def _groups(members: DataFrame, percent: int, block: int, block_bytes: int) -> DataFrame:
    """(node, group): every two nodes of a cluster whose set sizes allow a link meet in some group.

    Settled nodes of a cluster are connected already and need not meet each
    other. Each cluster is cut by size class, whose width is the ratio of sizes
    that a link allows, and by hash into blocks; a group is a pair of blocks of
    the same or neighbouring classes.
    """
    # Sizes at exactly the ratio may fall one class apart, as the groups allow.
    classed = members.select("cluster", "node", "settled", "bytes", F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent))).cast("int").alias("class"))
    parts = classed.groupBy("cluster", "class", "settled").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).cast("int").alias("k"))
    parts = stored(parts, "blocks")

    def name(kind, settled, number):
        return F.concat_ws(".", kind, settled.cast("int"), number)

    own = classed.join(parts, ["cluster", "class", "settled"])
    own = own.select("cluster", "node", "settled", "class", name(F.col("class"), F.col("settled"), F.pmod(F.xxhash64("node"), F.col("k"))).alias("own"))
    meets = own.select("cluster", "node", "own", F.col("settled").alias("from"), F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class"))
    met = meets.join(parts, ["cluster", "class"]).where(~(F.col("from") & F.col("settled")))
    met = met.select("cluster", "node", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: name(F.col("class"), F.col("settled"), j))).alias("other"))
    return met.select("node", F.concat_ws("/", "cluster", F.least("own", "other"), F.greatest("own", "other")).alias("group"))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int | None = None,
    rows: int = 5,
    coarse: float = 0.5,
    rounds: int = 2,
    block: int = 256,
    block_bytes: int = 8 << 20,
    broadcast_nodes: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of ``percent`` or more.

    Rows with equal sets are one node. The minima of each node are banded, and
    each bucket joins its nodes to leaders that they are roughly alike to by
    their sketches (see ``_stars``), so a bucket of any size makes edges in
    proportion to its rows. Components of these edges are coarse clusters.

    Links come from full sets only. A small cluster is compared as one group. In a
    large one each node is first compared with its leader, in blocks; what this
    connects to the leader with the most nodes is settled, and only the rest of
    the cluster is compared with it and with each other, again in blocks. So a large
    group of near copies costs one comparison for each, no link is taken from an
    estimate, and none is lost because two nodes are unlike the smallest node of
    their bucket.

    Unless ``bands`` says otherwise there are as many as ``bands_for`` names: two
    documents right at the threshold share no bucket once in ten million pairs,
    and more alike ones less often.

    Returns (id, n_shingles, component_id, kept), a row for each input row. A
    document without words, null or empty, has size 0 and links with nothing. A
    row with a null id takes no part: its component is null and it is kept. Rows
    that repeat an id are rows of their own: with other texts each links by its
    own set, with equal texts all have the same component. Extra columns are
    ignored; an empty table gives no row. The id is a long.
    """
    small_batches(docs.sparkSession)
    hashes = MinHash(bands or bands_for(percent, rows), rows)
    described = stored(_described(docs, hashes, id_col, text_col, width).withColumnRenamed(id_col, "id"), "signatures")
    with_words = described.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    nodes = with_words.groupBy("key").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.first("bands", True).alias("bands"), F.first("sketch", True).alias("sketch"))
    # A node is a set, not an id: ids may repeat. Its number is written with it.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # A tenth covers the error of the estimates besides what links allow.
    edges = _stars(nodes, coarse, coarse + 1 - percent / 100 + 0.1, rounds, 4 * block)
    clusters = connected_components(edges, "leader", "node").withColumnRenamed("component", "cluster")
    members = stored(clusters.join(nodes.select("node", "n_shingles", (F.col("n_shingles") * 8).alias("bytes")), "node"), "members")
    fits = (F.count("*") <= 2 * block) & (F.sum("bytes") <= 2 * block_bytes)
    large = stored(members.groupBy("cluster").agg(fits.alias("fits")).where(~F.col("fits")).select("cluster"), "large")

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("least"), payload(text_col).alias("text"))
    places = nodes.select("node", "least", "key")

    def compare(table: pa.Table) -> pa.Table:
        sets = {}
        for node, key, text in zip(table.column("node").to_pylist(), table.column("key").to_pylist(), table.column("text"), strict=True):
            if node not in sets and _key(x := shingles(text.as_py(), width)) == key:  # another text of the same id is another node
                sets[node] = x
        ids = sorted(sets)
        found = links_within([sets[i] for i in ids], percent) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    def links(groups: DataFrame) -> DataFrame:
        """Links inside groups; the list of the texts' places is broadcast only when it is short."""
        wanted = stored(groups.join(places, "node"), "groups")
        few = wanted.count() <= broadcast_nodes
        return texts.join(F.broadcast(wanted) if few else wanted, "least").select("group", "node", "key", "text").groupBy("group").applyInArrow(compare, "a long, b long")

    groups = members.join(large, "cluster", "left_anti").select("node", F.col("cluster").cast("string").alias("group"))
    if large.isEmpty():
        found = links(groups)
    else:
        parted = members.join(large, "cluster")
        to_leaders = stored(links(_star_groups(edges, parted.select("node", "bytes"), block, block_bytes)), "to-leaders")
        # Leaders are smaller than their nodes, so the pairs of a star group name its leader first.
        main = to_leaders.groupBy(F.col("a").alias("node")).count().join(parted, "node").groupBy("cluster").agg(F.max_by("node", F.struct("count", "node")).alias("main"))
        close = to_leaders.join(stored(main, "main"), F.col("a") == F.col("main")).select(F.col("b").alias("close")).distinct()
        parted = parted.join(stored(close, "close"), F.col("node") == F.col("close"), "left").withColumn("settled", F.col("close").isNotNull())
        found = to_leaders.union(links(groups.union(_groups(parted, percent, block, block_bytes))))
    linked = connected_components(found, "a", "b")
    grouped = stored(nodes.select("key", "node", "least").join(linked, "node", "left").select("key", "least", F.coalesce("component", "node").alias("part")), "grouped")
    named = grouped.select("key", "part").join(grouped.groupBy("part").agg(F.min("least").alias("component")), "part").select("key", "component")
    own = described.select("id", "key", "n_shingles")
    known = own.where((F.col("n_shingles") > 0) & F.col("id").isNotNull()).join(named, "key").select("id", "n_shingles", F.col("component"))
    alone = own.where((F.col("n_shingles") == 0) | F.col("id").isNull()).select("id", "n_shingles", F.col("id"))
    return known.union(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
