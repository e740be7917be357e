"""Approximate search: recall against exact search, and the work it takes."""

import numpy as np
import pytest

from galleon.operators import approximate, search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell int"
METHODS = ["ivf_topk", "lsh_topk", "pq_topk"]
SF = "/root/testdata/sf0.1"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", 1) for i, v in rows], SCHEMA)


def found(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


@pytest.mark.parametrize("method", METHODS)
def test_recall_on_the_registered_table(spark, method):
    g = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = g.where("vec_id % 20 = 0")
    want, counted = search.topk(q, g, 5), spark.sparkContext.accumulator(0)
    got = getattr(approximate, method)(q, g, 5, counted=counted)
    exact = {(r.query_id, r.item_id): r.score for r in search.topk(q, g, 2000).collect()}
    assert all(r.score == exact[r.query_id, r.item_id] for r in got.collect())
    assert len(found(want) & found(got)) >= 0.9 * want.count()
    counted.value = 0
    found(got)
    assert counted.value <= q.count() * g.count()  # no pair twice


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 24))
    x = centers[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 24))
    return frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)]).cache()


@pytest.mark.parametrize("method", METHODS)
def test_defaults_look_at_few_clustered_vectors(spark, clustered, method):
    q = clustered.where("vec_id % 20 = 0")
    want, counted = found(search.topk(q, clustered, 5)), spark.sparkContext.accumulator(0)
    got = found(getattr(approximate, method)(q, clustered, 5, counted=counted))
    assert len(want & got) >= 0.9 * len(want)
    assert 0 < counted.value < 0.5 * 150 * 3000


@pytest.mark.parametrize("method", METHODS)
def test_nulls_zero_vectors_ties_repeats_and_empty_tables(spark, method):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [None, 1.0]), (4, [2.0, 0.0])]
    g, run = frame(spark, rows), getattr(approximate, method)
    got = run(g.where("vec_id = 1"), g, 10).orderBy("rank").collect()
    assert {r.item_id for r in got} <= {2, 3, 4} and got[0].item_id == 4 and got[0].score == 1.0
    none = frame(spark, [])
    assert run(g, none, 3).columns == ["query_id", "item_id", "score", "rank"]
    assert run(g, none, 3).count() == 0 and run(none, g, 3).count() == 0


def test_codes_are_a_sixteenth_of_the_vectors(spark):
    g = approximate.usable(spark.read.parquet(f"{SF}/embeddings.parquet"))
    cells, placed, sample = approximate.fit_cells(g, None, 20_000)
    coder = approximate.ProductCodes(sample, cells, 4)
    v = approximate.directions(np.array([r.v for r in placed.limit(200).collect()]))
    own = (v @ cells.centres.T).argmax(1)
    codes = coder.codes(v, own)
    assert codes.nbytes * 16 == np.float32(v).nbytes
    q = sample[:20]
    for row in range(0, 200, 9):
        s = coder.scores(q, codes[row : row + 1], int(own[row]))[:, 0]
        coded = cells.means[own[row]] + np.concatenate([coder.words[k, c] for k, c in enumerate(codes[row])])
        assert np.allclose(s, q @ coded)


def test_pairs_are_scored_in_their_first_table_only():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    planes = rng.normal(size=(4, 6, 5))
    codes = approximate.sign_codes(v, planes)
    apart = np.bitwise_count(codes[:, None] ^ codes[None])
    for flips in (0, 1):
        times = sum(((apart[:, :, t] <= flips) & ~approximate.shared_before(codes, codes, t, flips)).astype(int) for t in range(4))
        assert (times == (apart <= flips).any(2)).all()


def test_expected_rows_in_cells_follow_what_is_there():
    rng = np.random.default_rng(6)
    v = approximate.directions(rng.normal(size=(4000, 64)))
    cells = approximate.Cells(approximate.means(v, 20))
    own = (v @ cells.centres.T).argmax(1)
    cells.sizes = np.bincount(own, minlength=20)
    s = np.sort(v[:50] @ v.T, 1)[:, -30]
    looked = cells.further(v[:50], s, np.zeros((50, 20), bool), 30, 0.1)
    above = (v[:50] @ v.T) >= s[:, None]
    missed = (above & ~looked[np.arange(50)[:, None], own[None, :]]).sum(1).mean()
    assert missed < 4.5 and looked.mean() < 0.9
    low = cells.further(v[:50], np.full(50, -1.0), np.zeros((50, 20), bool), 30, 0.1)
    assert looked.mean() <= low.mean() < 0.95


def test_blocks_of_a_cell_are_scored_some_queries_at_a_time(spark):
    lists = "array_repeat(array(float(1)), {n}) AS {s}_v"
    pairs = spark.range(1).selectExpr("sequence(0L, 399L) AS q_ids", lists.format(n=400, s="q"), "0 AS q_dist", "sequence(0L, 2999L) AS g_ids", lists.format(n=3000, s="g"), "0 AS cell")

    def score(column, cell):
        return lambda q: np.full((len(q), len(column)), float(len(q) * len(column)))

    found = approximate._best_in_blocks(pairs, score, 1, None).collect()
    assert len(found) == 400 and max(r.score for r in found) <= 1 << 19


def test_queries_are_sent_to_many_cells_some_at_a_time(spark):
    asked = spark.range(0, 2000, 1, 1).selectExpr("id", "array(float(1), float(2)) AS v", "double(id) AS score")
    found = approximate._asking(asked, 100, lambda d, score: np.ones((len(d), 100), bool) & (len(d) <= 400))
    assert found.groupBy("id").count().where("count = 100").count() == 2000
