"""Confidence intervals of a metric by resampling its queries, in one pass."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries' weights are Poisson(1); beyond this count the rest of the probability is dropped (3e-10 of it).
MOST = 11


def poisson_weight(key: Column) -> Column:
    """A weight 0, 1, 2, ... drawn from Poisson(1) by the first 32 bits of md5 of a string."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    total, weight = 0.0, F.lit(0)
    for n in range(MOST):
        total += exp(-1) / factorial(n)
        weight = weight + (u >= F.lit(total)).cast("int")
    return weight


def metric_intervals(values: DataFrame, metric_col: str, groups: list[str], draws: int = 200, level: float = 0.9, id_col: str = "query_id") -> DataFrame:
    """(groups..., n, mean, low, high): the mean of a metric and its bootstrap interval, in all rows and in each group.

    ``values`` has a row for each query. Each draw gives each query a Poisson weight that
    depends on its id and the draw alone, so rows need no order and no draw needs the
    others: sums of weights and weighted values of all draws are added up before the
    only shuffle of rows, for the grouping sets of ``groups`` and of nothing. Draws in
    which a group has no weight are left out. The interval spans the draws'
    means from the lower to the upper (1 - ``level``) / 2, each the draw nearest above.

    Null metrics and ids are left out, rows that repeat an id get the same weights, a null
    group is a group of its own (``whole`` is false for it, and true for all rows), and an
    empty table gives no row. Means are rounded to six decimals.
    """
    rows = values.where(F.col(metric_col).isNotNull() & F.col(id_col).isNotNull())
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.col("draw").cast("string"))
    drawn = rows.select(*groups, F.col(metric_col).cast("double").alias("x"), F.col(id_col), F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    # Draw 0 is the sample itself.
    weighted = drawn.select(*groups, "draw", "x", F.when(F.col("draw") == 0, F.lit(1)).otherwise(poisson_weight(key)).alias("w"))
    sets = weighted.groupingSets([["draw", *groups], ["draw"]], "draw", *groups)
    # Values are summed as decimals, so that no order of rows shows.
    sums = sets.agg(F.grouping(groups[0]).alias("all"), F.sum("w").alias("w"), F.sum(F.col("x").cast("decimal(20,9)") * F.col("w")).alias("s"))
    means = sums.where("w > 0").select(*groups, (F.col("all") == 1).alias("whole"), "draw", "w", F.round(F.col("s").cast("double") / F.col("w"), 6).alias("mean"))
    found = F.array_sort(F.collect_list(F.when(F.col("draw") > 0, F.col("mean"))))
    per = means.groupBy(*groups, "whole").agg(F.max(F.when(F.col("draw") == 0, F.col("w"))).alias("n"), F.max(F.when(F.col("draw") == 0, F.col("mean"))).alias("mean"), found.alias("found"))
    edge = (1 - level) / 2

    def at(share: float) -> Column:
        return F.element_at("found", F.greatest(F.lit(1), F.ceil(F.size("found") * F.lit(share)).cast("int")))

    known = per.where(F.size("found") > 0)
    return known.select(*groups, "whole", "n", "mean", at(edge).alias("low"), at(1 - edge).alias("high"))
