"""Bootstrap intervals, against weights and sums made row by row."""

import hashlib
import random
from collections import defaultdict
from math import ceil, exp, factorial

from galleon.operators.resampling import metric_intervals

SCHEMA = "query_id long, ap double, label string, draw string, w int, mean string"


def weight(i, draw):
    u, total, n = int(hashlib.md5(f"{i}:{draw}".encode()).hexdigest()[:8], 16) / 2**32, 0.0, 0
    for k in range(11):
        total += exp(-1) / factorial(k)
        n += u >= total
    return n


def plain(rows, draws, level):
    groups = defaultdict(list)
    for i, x, label in rows:
        if i is not None and x is not None:
            groups[label, False].append((i, x))
            groups[None, True].append((i, x))
    out = []
    for (label, whole), held in groups.items():
        means = []
        for d in range(1, draws + 1):
            w = [weight(i, d) for i, _ in held]
            if sum(w):
                means.append(round(sum(a * x for a, (_, x) in zip(w, held, strict=True)) / sum(w), 6))
        means.sort()
        if means:
            edge = (1 - level) / 2
            pick = [means[max(1, ceil(len(means) * s)) - 1] for s in (edge, 1 - edge)]
            out.append((label, whole, len(held), round(sum(x for _, x in held) / len(held), 6), *pick))
    return sorted(out, key=str)


def test_intervals_against_plain_resampling(spark):
    rng = random.Random(1)
    rows = [(i, round(rng.random(), 4), rng.choice(["a", "b", None])) for i in range(60)] + [(3, 0.5, "a"), (3, 0.5, "a"), (None, 0.1, "a"), (70, None, "b"), (71, 0.25, "alone")]
    df = spark.createDataFrame([(i, x, g, "d", 1, "m") for i, x, g in rows], SCHEMA)
    found = sorted((tuple(r) for r in metric_intervals(df, "ap", ["label"], 50, 0.9).collect()), key=str)
    want = plain(rows, 50, 0.9)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert all(abs(x - y) <= 1.01e-6 for a, b in zip(found, want, strict=True) for x, y in zip(a[3:], b[3:], strict=True))
    assert metric_intervals(df.limit(0), "ap", ["label"]).count() == 0


def test_an_interval_holds_the_mean_of_what_is_sampled(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0.5, 0.1), "x", "d", 1, "m") for i in range(2000)]
    r = metric_intervals(spark.createDataFrame(rows, SCHEMA), "ap", ["label"]).where("whole").first()
    assert r.low < r.mean < r.high and 0.005 < r.high - r.low < 0.01  # 2 * 1.645 * 0.1 / sqrt(2000) = 0.0074


def test_rows_are_shuffled_as_sums_only(spark):
    rows = [(i, 0.5, "x", "d", 1, "m") for i in range(200)]
    plan = metric_intervals(spark.createDataFrame(rows, SCHEMA), "ap", ["label"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")  # printed from the top: the sums stand below the exchange
