"""Sort-means, against every vector with every centroid and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from galleon.llm.sortmeans import assign, centroid_order, sort_means

SF = "/root/testdata/sf0.01"
NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v int, distance string, inertia int, name int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1, "d", 2, 3) for i, v in rows], SCHEMA)


def plain(rows, clusters, rounds, places, scale):
    """Lloyd's steps as the contract states them, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == places and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in set(own):
            of = [v for (_, v), c in zip(kept, own, strict=True) if c == k]
            centres[k] = [sum(col) // len(of) for col in zip(*of, strict=True)]
    last = [nearest(v) for _, v in kept]
    out = []
    for (i, _), (d, k) in zip(kept, last, strict=True):
        out.append((i, k, d, sum(x for x, c in last if c == k), sum(x for x, _ in last), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=8), st.lists(st.tuples(st.lists(st.integers(-4, 4), min_size=2, max_size=2), st.integers(0, 7)), min_size=1, max_size=30))
@settings(max_examples=300, deadline=None)
def test_scan_is_the_nearest_with_ties_to_the_smaller(centroids, rows):
    c = np.array(centroids, np.int64)
    v, before = np.array([r[0] for r in rows], np.int64), np.array([r[1] % len(c) for r in rows], np.int32)
    best, least, _ = assign(v, before, c, *centroid_order(c))
    want = [min((int(((x - y) ** 2).sum()), k) for k, y in enumerate(c)) for x in v]
    assert list(zip(least.tolist(), best.tolist(), strict=True)) == want


def test_scan_stops_strictly_beyond_twice_the_distance():
    c = np.array([[0], [20], [4], [100]], np.int64)
    order, apart = centroid_order(c)
    assert order[0].tolist() == [0, 2, 1, 3] and apart[0].tolist() == [0, 16, 400, 10000]
    count = lambda x: assign(np.array([[x]], np.int64), np.zeros(1, np.int32), c, order, apart)[2]
    assert count(1) == 1  # the nearest other one is at 4 > 2
    assert count(2) == 2  # at exactly twice the distance it may tie, so it is looked at
    assert count(9) == 2 and count(10) == 3


def test_clustered_vectors_need_few_distances():
    rng = np.random.default_rng(5)
    c = rng.integers(-60, 60, (16, 64))
    own = rng.integers(0, 16, 3000).astype(np.int32)
    v = c[own] + rng.integers(-3, 4, (3000, 64))
    best, _, computed = assign(v, own, c, *centroid_order(c))
    assert (best == own).all() and computed < 1.1 * len(v)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).round(2).tolist()) for k in range(40)]
    rows += [(7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (None, [1.0, -1.0, 0.25]), (50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 2.0]), (54, [1.0, float("nan"), 2.0]), (55, [float("inf"), 0.0, 0.0]), (56, [-0.01, -0.0, 1e-300])]
    got = sort_means(frame(spark, rows), clusters=5, rounds=3, places=3, scale=8)
    assert got.columns == NAMES and result(got) == plain(rows, 5, 3, 3, 8)
    few = [(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0]), (3, [9.0, 9.0, 9.0])]
    assert result(sort_means(frame(spark, few), clusters=5, places=3)) == plain(few, 5, 3, 3, 64)
    assert sort_means(frame(spark, [(1, None)]), places=3).count() == 0 and sort_means(frame(spark, []), places=3).columns == NAMES


def test_large_components_stay_exact(spark):
    big = (1 << 21) - 1.0
    rows = [(1, [big] * 64), (2, [-big] * 64), (3, [big - 1] + [big] * 63), (4, [0.0] * 64), (5, [2.0**21] * 64)]
    assert result(sort_means(frame(spark, rows), clusters=2)) == plain(rows[:-1], 2, 3, 64, 64)


def test_registered_query_equals_its_sql_and_the_plain_steps(spark):
    from galleon.llm.queries import op11_sort_means, oracle_sql

    found = result(op11_sort_means(spark, SF))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = con.execute(oracle_sql()["op11_sort_means"])
    names = [d[0] for d in got.description]
    assert sorted((tuple(r[names.index(c)] for c in NAMES) for r in got.fetchall()), key=str) == found
    assert found == plain(con.execute("select vec_id, embedding from embeddings").fetchall(), 16, 3, 64, 64)
