"""Diffusion, against dense matrices and recursive SQL."""

import duckdb
import numpy as np
import pytest

from galleon.operators.descent import knn_graph
from galleon.operators.diffusion import candidate_edges, diffuse, graph_edges
from galleon.operators.search import topk
from galleon.plans import retrieval

FOUND = "query_id long, item_id long, score double, a long, weight string"
EDGES = "query_id long, a long, b long, weight double, score string"


def dense(found, edges, k, alpha=0.9, rounds=20):
    """(query, item, score, rank), one matrix a query."""
    own, out = {}, []
    for q, i, s in found:
        if None not in (q, i, s):
            own.setdefault(q, {})[i] = max(s, own.get(q, {}).get(i, s))
    for q, held in own.items():
        ids = sorted(held)
        w = np.zeros((len(ids), len(ids)))
        for e, a, b, x in edges:
            if e == q and a in held and b in held and a != b and x > 0:
                i, j = ids.index(a), ids.index(b)
                w[i, j] = w[j, i] = max(w[i, j], x)
        degree = w.sum(1)
        s = w / np.sqrt(np.outer(degree, degree) + (w == 0))
        y = np.array([max(held[i], 0) for i in ids])
        f = y
        for _ in range(rounds):
            f = alpha * s @ f + (1 - alpha) * y
        best = sorted(zip(-np.round(f, 6), ids, strict=True))[:k]
        out += [(q, i, round(float(-x), 6), n + 1) for n, (x, i) in enumerate(best)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.item_id, round(r.score, 6), r["rank"]) for r in df.select("query_id", "item_id", "score", "rank").collect())


def same(found, want):
    assert [(r[0], r[3]) for r in sorted(found)] == [(r[0], r[3]) for r in sorted(want)]
    assert {r[:2] for r in found} == {r[:2] for r in want}
    value = {r[:2]: r[2] for r in want}
    assert all(abs(r[2] - value[r[:2]]) <= 1.1e-6 for r in found)


def test_against_dense_matrices(spark):
    rng = np.random.default_rng(1)
    found = [(q, int(i), round(float(rng.uniform(-0.2, 1)), 4)) for q in range(6) for i in rng.choice(40, 12, False)]
    edges = [(q, int(rng.integers(40)), int(rng.integers(40)), round(float(rng.uniform(-0.1, 1)), 4)) for q in range(7) for _ in range(120)]
    found += [(0, None, 0.5), (None, 3, 0.5), (1, 99, None), found[0], (found[0][0], found[0][1], found[0][2] + 0.1), (50, 7, 0.25), (51, 1, 0.5), (51, 2, 0.5)]
    edges += [edges[0], (2, found[24][1], found[24][1], 9.0)]
    left = spark.createDataFrame([(*r, 5, "clash") for r in found], FOUND)
    right = spark.createDataFrame([(*r, "clash") for r in edges], EDGES)
    got = rows(diffuse(left, right, 4))
    same(got, dense(found, edges, 4))
    assert (50, 7, 0.025, 1) in got  # without edges
    assert [r[1] for r in got if r[0] == 51] == [1, 2]  # a tie
    assert rows(diffuse(left.limit(0), right, 4)) == [] and len(rows(diffuse(left, right.limit(0), 4))) == len(got)


def test_scores_settle(spark):
    found = spark.createDataFrame([(0, i, 1.0 if i == 0 else 0.0) for i in range(5)], "query_id long, item_id long, score double")
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(4)], "query_id long, a long, b long, weight double")
    settled = rows(diffuse(found, edges, 5, alpha=0.5, rounds=1000, least_change=1e-12))
    w = np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    s = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    want = np.linalg.solve(np.eye(5) - 0.5 * s, 0.5 * np.eye(5)[0])
    assert [r[2] for r in settled] == pytest.approx(want, abs=2e-6)


def test_over_the_graph_of_neighbour_descent_equals_recursive_sql(spark):
    g = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = topk(g.where("vec_id % 100 = 0"), g, 30)
    edges = graph_edges(found, knn_graph(g, 8))
    c, e = found.select("query_id", "item_id", "score").toPandas(), edges.toPandas()  # noqa: F841
    want = duckdb.sql("""
        WITH RECURSIVE s AS (SELECT query_id, least(a, b) AS lo, greatest(a, b) AS hi, max(weight) AS w FROM e GROUP BY ALL),
        u AS (SELECT query_id, lo AS a, hi AS b, w FROM s UNION ALL SELECT query_id, hi, lo, w FROM s),
        d AS (SELECT query_id, a, sum(w) AS d FROM u GROUP BY ALL),
        m AS (SELECT u.query_id, u.a, u.b, u.w / sqrt(x.d * y.d) AS w FROM u JOIN d AS x ON x.query_id = u.query_id AND x.a = u.a
              JOIN d AS y ON y.query_id = u.query_id AND y.a = u.b UNION ALL SELECT query_id, item_id, item_id, 0 FROM c),
        f AS (SELECT 0 AS step, query_id, item_id, greatest(score, 0) AS x FROM c UNION ALL
              SELECT f.step + 1, m.query_id, m.a, 0.9::DOUBLE * sum(m.w * f.x) + 0.1::DOUBLE * greatest(any_value(c.score), 0) FROM f JOIN m ON m.query_id = f.query_id AND m.b = f.item_id
              JOIN c ON c.query_id = m.query_id AND c.item_id = m.a WHERE f.step < 10 GROUP BY f.step, m.query_id, m.a)
        SELECT query_id, item_id, round(x, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 6) DESC, item_id) AS rank FROM f WHERE step = 10
    """).fetchall()
    assert len(e) > 100
    same(rows(diffuse(found, edges, 30, rounds=10)), want)


def test_candidate_edges(spark):
    g = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.1]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (None, [1.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    found = spark.createDataFrame([(9, i, 0.5) for i in (1, 2, 3, 4, 5, 6, 7)] + [(8, 1, 0.1)], "query_id long, item_id long, score double")
    edges = sorted(tuple(r) for r in candidate_edges(found, g, 1).collect())
    assert [e[:3] for e in edges] == [(9, 1, 2), (9, 2, 3), (9, 3, 2)]
    assert candidate_edges(found.limit(0), g, 1).count() == 0


def test_the_registered_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = duckdb.sql(retrieval.oracle_sql()["diffusion_topk"]).fetchall()
    assert rows(retrieval.diffusion_topk(spark, folder)) == sorted(want)
