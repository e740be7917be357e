"""Multi-index hashing, against every pair of codes."""

import random
from math import comb

import pytest
from hypothesis import given
from hypothesis import strategies as st

from galleon.operators import hashes
from galleon.operators.hashes import KEYS, hash_neighbours, near_codes, parts_for

SCHEMA = "vec_id long, code long, distance string, a int, b int, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if c is None else c - (1 << 64) if c >> 63 else c, "d", 1, 2, "p") for i, c in rows], SCHEMA)


def near(left, right, radius):
    return sorted((i, j, (a ^ b).bit_count()) for i, a in left for j, b in right if None not in (i, j, a, b) and i != j and (a ^ b).bit_count() <= radius)


def codes(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    rows = [(k, rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12)))) for k in range(n)]
    return rows + [(3, rows[5][1]), (3, rows[5][1]), (None, rows[5][1]), (n, None), (n + 1, rows[5][1])]


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 12, 20, 64])
def test_neighbours_equal_every_pair(spark, radius):
    rows = codes(200, radius)
    left = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    found = hash_neighbours(frame(spark, left), frame(spark, rows), radius)
    assert sorted(tuple(r) for r in found.collect()) == near(left, rows, radius)


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_the_number_of_parts_changes_nothing(spark, parts):
    rows = codes(80, 9)
    found = hash_neighbours(frame(spark, rows), frame(spark, rows), 3, parts)
    assert sorted(tuple(r) for r in found.collect()) == near(rows, rows, 3)


def test_empty_tables(spark):
    some, none = frame(spark, codes(8, 1)), frame(spark, [])
    assert hash_neighbours(some, none, 5).count() == 0 and hash_neighbours(none, some, 5).count() == 0


@given(st.integers(0, 64))
def test_a_query_asks_for_few_keys(radius):
    parts = parts_for(radius)
    assert 64 % parts == 0 and (parts == 8 or sum(comb(64 // parts, m) for m in range(radius // parts + 1)) <= KEYS)


def test_few_candidates_are_compared(spark):
    rng = random.Random(2)
    distinct = frame(spark, [(k, rng.getrandbits(64)) for k in range(4000)])
    found = near_codes(distinct.where("vec_id % 20 = 0").selectExpr("code AS a"), distinct.selectExpr("code AS b"), 7)
    assert found.count() == 200 and parts_for(7) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_wide_radius_joins_no_pair_by_its_keys(spark, monkeypatch):
    assert hashes.share(20, parts_for(20)) > hashes.WIDE > hashes.share(7, parts_for(7))
    monkeypatch.setattr(hashes, "ASKED", 50)
    monkeypatch.setattr(hashes, "HELD", 90)
    rows = codes(300, 4)
    found = hash_neighbours(frame(spark, rows[::3]), frame(spark, rows), 20)
    assert sorted(tuple(r) for r in found.collect()) == near(rows[::3], rows, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "part" not in plan.replace("partition", "")
