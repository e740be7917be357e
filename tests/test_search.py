import numpy as np
import pytest
from pyspark.sql import functions as F

from galleon.functions import vectors
from galleon.operators import approximate, evaluate, expansion, pivots, search

SCHEMA = "vec_id long, embedding array<float>, label int"
ROWS = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 1), (4, [2.0, 0.0], 1), (5, [0.0, 0.0], 0), (6, None, 1)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cosine_ties_go_to_the_smaller_id_and_zero_and_null_vectors_are_left_out(tiny):
    got = rows(search.topk(tiny.where("vec_id = 1"), tiny, 10), "query_id", "rank", "item_id", "score")
    assert got == [(1, 1, 4, 1.0), (1, 2, 3, 0.707107), (1, 3, 2, 0.0)]


@pytest.mark.parametrize(("metric", "best"), [("ip", 4), ("l2", 3), ("l1", 3), ("hamming", 4)])
def test_other_metrics(tiny, metric, best):
    got = search.topk(tiny.where("vec_id = 1"), tiny, 1, metric).collect()
    assert [r.item_id for r in got] == [best]


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(0)
    g = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(300)], SCHEMA)
    q = g.where("vec_id % 20 = 0")
    whole = rows(search.topk(q, g, 4), "query_id", "item_id", "rank")
    monkeypatch.setattr(search, "BLOCK", 32)
    assert rows(search.topk(q, g, 4), "query_id", "item_id", "rank") == whole


def test_builtin_expressions_agree_with_the_block_scores(tiny):
    pair = tiny.where("vec_id = 1").select(F.col("embedding").alias("a")).join(tiny.where("vec_id = 3").select(F.col("embedding").alias("b")))
    a, b = F.col("a"), F.col("b")
    got = pair.select(vectors.dot(a, b), vectors.l1(a, b), vectors.l2(a, b), vectors.hamming(a, b), F.round(vectors.cosine(a, b), 6)).first()
    assert tuple(got) == (1.0, 1.0, 1.0, 1.0, 0.707107)


def test_range_pairs_and_duplicates(tiny):
    assert rows(pivots.range_search(tiny.where("vec_id = 1"), tiny, 0.7), "item_id") == [(3,), (4,)]
    assert rows(pivots.top_pairs(tiny, 1), "a_id", "b_id") == [(1, 4)]
    twice = tiny.union(tiny.where("vec_id = 1").withColumn("vec_id", F.lit(9).cast("long")))
    assert rows(search.exact_dups(twice), "first_id", "copies") == [(1, 2)]


def test_empty_tables(spark, tiny):
    none = spark.createDataFrame([], SCHEMA)
    assert search.topk(none, tiny, 3).count() == 0
    assert search.topk(tiny, none, 3).count() == 0
    assert pivots.top_pairs(none, 3).count() == 0


def test_metrics_by_hand(spark):
    j = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 1, 2), (1, 3, 1, 2), (2, 1, 0, 0), (2, 2, 0, 0)], "query_id long, rank int, relevant int, n_relevant long")
    assert rows(evaluate.precision_at_k(j, 2), "query_id", "precision") == [(1, 0.5), (2, 0.0)]
    assert rows(evaluate.recall_at_k(j, 2), "query_id", "recall") == [(1, 0.5), (2, 0.0)]
    assert rows(evaluate.average_precision(j), "query_id", "average_precision") == [(1, 0.583333), (2, 0.0)]
    assert tuple(evaluate.mrr(j).first()) == (0.25, 2)
    assert rows(evaluate.ndcg_at_k(j, 3), "query_id", "ndcg") == [(1, 0.693426), (2, 0.0)]


def test_centroids_and_votes(tiny):
    clean = tiny.where("vec_id < 5")
    means = expansion.as_vectors(expansion.centroids(clean), "label")
    assert rows(means, "label", "embedding") == [(0, [0.5, 0.5]), (1, [1.5, 0.5])]
    assert rows(expansion.nearest_centroid(clean, means), "vec_id", "label") == [(1, 0), (2, 0), (3, 0), (4, 1)]
    assert rows(expansion.knn_vote(clean.where("vec_id = 1"), clean, 2), "query_id", "label", "votes") == [(1, 1, 2)]


def test_fusion_and_expansion(spark, tiny):
    r = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, item_id long, rank int")
    s = spark.createDataFrame([(1, 6, 1)], "query_id long, item_id long, rank int")
    assert rows(expansion.rank_fusion([r, s], 2), "rank", "item_id") == [(1, 6), (2, 5)]
    clean = tiny.where("vec_id < 5")
    assert expansion.query_expansion(clean.where("vec_id = 1"), clean, 2, 2).count() == 2


def found(df):
    return set(rows(df, "query_id", "item_id"))


def test_pca_against_numpy(spark, tiny):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)) * [5, 4, 3, 1, 1, 1]
    g = spark.createDataFrame([*((i, [float(v) for v in row], 0) for i, row in enumerate(x)), (99, None, 0)], SCHEMA)
    values, vectors = np.linalg.eigh(np.cov(np.float32(x).astype(float).T))
    top = vectors[:, np.argsort(-values)[:3]]
    top = top * np.sign(top[np.abs(top).argmax(0), range(3)])
    got = np.array([r.embedding for r in approximate.pca_reduce(g, 3).orderBy("vec_id").collect()])
    assert np.allclose(got, np.float32(x) @ top, atol=1e-4)
    assert approximate.pca_reduce(spark.createDataFrame([], SCHEMA), 3).count() == 0


def test_no_task_gets_the_whole_gallery(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "STRIPE", 2)
    rng = np.random.default_rng(4)
    g = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(400)], SCHEMA)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:

        def keep(ids, vectors, item_ids, items, _):
            from pyspark import TaskContext

            yield np.array([TaskContext.get().partitionId()]), np.array([len(item_ids)])

        loads = search.in_blocks(g.where("vec_id % 20 = 0"), g, keep, "task long, n long").groupBy("task").agg(F.sum("n").alias("n")).collect()
        assert sum(r.n for r in loads) == 3 * 400 and max(r.n for r in loads) < 400
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_a_task_scores_some_queries_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 10_000)
    rows = spark.range(3000).selectExpr("id AS vec_id", "array(float(id), float(1)) AS embedding")

    def keep(ids, vectors, item_ids, items, _):
        yield np.array([len(ids) * len(item_ids)]), np.array([len(ids)])

    found = [tuple(r) for r in search.in_blocks(rows.where("vec_id < 400"), rows, keep, "n long, queries long").collect()]
    assert max(n for n, _ in found) <= search.SCORES and sum(n for _, n in found) == 400
