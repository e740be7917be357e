"""The graph of neighbours by descent: recall against exact search, and the pairs it scores."""

import numpy as np
import pyarrow as pa
import pytest

from galleon.operators import descent, search
from galleon.operators.descent import knn_graph

SCHEMA = "vec_id long, embedding array<float>, id int, new string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", "s") for i, v in rows], SCHEMA)


def found(df):
    return {(r.query_id, r.item_id): r.score for r in df.collect()}


def recall(spark, g, **options):
    counted = spark.sparkContext.accumulator(0)
    got, want = found(knn_graph(g, 5, counted=counted, **options)), found(search.topk(g, g, 5))
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got.keys() & want.keys())
    n = g.count()
    return len(got.keys() & want.keys()) / len(want), counted.value / (n * (n - 1) / 2)


def test_clustered_vectors_need_less_than_half_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 24))
    x = centers[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 24))
    share, pairs = recall(spark, frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)]))
    assert share >= 0.9 and pairs < 0.5


def test_recall_on_the_registered_table(spark):
    share, pairs = recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert share >= 0.9 and pairs < 1


def test_nulls_repeats_few_rows_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (3, [5.0, 5.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [1.0, 0.0])]
    got = knn_graph(frame(spark, rows), 2).collect()
    assert {(r.query_id, r["rank"]): r.item_id for r in got} == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert knn_graph(frame(spark, []), 2).count() == 0 and knn_graph(frame(spark, rows[:1]), 2).columns == ["query_id", "item_id", "score", "rank"]
    assert knn_graph(frame(spark, rows[:1]), 2).count() == 0


@pytest.mark.parametrize("width", [3, 50])
def test_groups_of_a_batch_are_scored_together(width):
    rng = np.random.default_rng(5)
    groups = [[{"id": int(i), "new": bool(rng.random() < 0.5), "least": float(rng.choice([-2.0, 0.0])), "v": rng.normal(size=4).tolist()} for i in rng.permutation(90)[:m]] for m in (1, 2, 7, 7, 0, 40, 7)]

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, score, _):
            return list(score([pa.RecordBatch.from_arrays([pa.array(groups)], ["members"])]))

    out = descent._tried(Table(), width, None)
    want = []
    for members in groups:
        for a in members:
            s = [(-round(float(search.scores(np.array([a["v"]]), np.array([b["v"]]), "cosine")[0, 0]), 6), b["id"]) for b in members if a is not b and (a["new"] or b["new"])]
            want += [(a["id"], b, -x) for x, b in sorted(s)[:width] if -x > a["least"]]
    assert len(out) == 1 and np.allclose(sorted(zip(*out[0].to_pydict().values(), strict=True)), sorted(want), atol=1e-9)
