"""Pivot-bounded joins, against every pair."""

import numpy as np
import pytest

from galleon.operators import pivots
from galleon.operators.search import scores

SCHEMA = "vec_id long, embedding array<float>, score string, cell int, dist string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, "d") for i, v in rows], SCHEMA)


def clustered(rng, n, clusters=30, noise=0.02, places=64):
    centres = rng.normal(size=(clusters, places))
    v = centres[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, places)) * np.sqrt(places)
    return [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


def scored(left, right):
    ok = lambda v: v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v)
    a, b = ([(i, v) for i, v in rows if i is not None and ok(v)] for rows in (left, right))
    s = scores(*(np.array([v for _, v in rows], np.float32).astype(float) for rows in (a, b)), "cosine")
    return [(i, j, float(s[x, y]), x, y) for x, (i, _) in enumerate(a) for y, (j, _) in enumerate(b)]


def ranged(left, right, least):
    return sorted((i, j, s) for i, j, s, _, _ in scored(left, right) if i != j and s >= least)


def closest(rows, n):
    pairs = [(-s, min(i, j), max(i, j)) for i, j, s, x, y in scored(rows, rows) if x < y and i != j]
    return [(a, b, -s) for s, a, b in sorted(pairs)[:n]]


def odd_rows(rng):
    rows = clustered(rng, 120, 5, 0.1, 6)
    rows += [(3, rows[70][1]), (3, rows[70][1]), (200, rows[70][1]), (201, [2 * x for x in rows[70][1]]), (None, rows[70][1]), (202, None), (203, [0.0] * 6), (204, [float("nan")] * 6), (205, [float("inf"), *[1.0] * 5]), (206, [None, *[1.0] * 5]), (207, [-x for x in rows[70][1]])]
    return rows


def result(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("count", "block"), [(1, 2048), (4, 7), (None, 2048), (60, 3)])
def test_joins_equal_every_pair(spark, monkeypatch, count, block):
    rows = odd_rows(np.random.default_rng(1))
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots.blocks_of, "__defaults__", (block,))
    g = frame(spark, rows)
    for least in (0.95, 0.3, -1.0):
        found = pivots.range_search(g.where("vec_id % 3 = 0"), g, least, count)
        assert result(found, "query_id", "item_id", "score") == ranged([r for r in rows if r[0] is not None and r[0] % 3 == 0], rows, least)
    for n in (1, 40, 100_000):
        assert [tuple(r) for r in pivots.top_pairs(g, n, count).orderBy("score", "a_id", "b_id").collect()] == sorted(closest(rows, n), key=lambda p: (p[2], p[0], p[1]))


def test_few_rows_and_empty_tables(spark):
    none, one = frame(spark, []), frame(spark, [(1, [1.0, 2.0])])
    for g in (none, one):
        assert pivots.top_pairs(g, 5).count() == 0 and pivots.range_search(g, g, 0.0).count() == 0
    assert pivots.range_search(none, one, 0.0).columns == ["query_id", "item_id", "score"]
    assert pivots.range_search(one, none, 0.0).count() == 0 and pivots.top_pairs(one, 0).count() == 0


def test_defaults_score_few_pairs_of_clustered_vectors(spark):
    rows = clustered(np.random.default_rng(3), 3000)
    g, every = frame(spark, rows), 3000 * 2999 / 2
    counted = spark.sparkContext.accumulator(0)
    assert [tuple(r) for r in pivots.top_pairs(g, 100, counted=counted).orderBy("score", "a_id", "b_id").collect()] == sorted(closest(rows, 100), key=lambda p: (p[2], p[0], p[1]))
    assert 0 < counted.value < 0.1 * every
    asked, counted = [r for r in rows if r[0] % 20 == 0], spark.sparkContext.accumulator(0)
    found = pivots.range_search(frame(spark, asked), g, 0.9, counted=counted)
    assert result(found, "query_id", "item_id", "score") == ranged(asked, rows, 0.9)
    assert 0 < counted.value < 0.1 * len(asked) * len(rows)


def test_rows_go_only_where_they_reach(spark):
    rows = clustered(np.random.default_rng(4), 600, 12)
    usable = pivots.usable(frame(spark, rows))
    chosen = pivots.spread_out(pivots.sampled(usable, 600), 12)
    cells = pivots.in_cells(usable, chosen)
    low, high, n = pivots.cell_bounds(cells, len(chosen))
    assert n.sum() == 600
    assert pivots.sent(usable, chosen, low, high, pivots.radius(0.9)).count() == 600  # its own cluster
    assert pivots.sent(usable, chosen, low, high, 2.0).count() == 600 * 12


def test_rounds_tighten_the_bound(spark, monkeypatch):
    seen, plain = [], pivots.radius

    def watched(score):
        seen.append(score)
        return plain(score)

    monkeypatch.setattr(pivots, "radius", watched)
    pivots.top_pairs(frame(spark, clustered(np.random.default_rng(5), 500, 10, 0.3)), 50, pivots=40).collect()
    assert len(seen) == 2 and seen[0] <= seen[1]
