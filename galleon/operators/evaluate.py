"""Retrieval metrics over rankings with (query_id, rank, relevant), relevant 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(ranking: DataFrame, gallery: DataFrame) -> DataFrame:
    """Mark the items that have their query's label; also each query's number of such rows, itself aside."""
    label = gallery.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    own = gallery.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    total = gallery.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("n_relevant"))
    return (
        ranking.join(label, "item_id").join(own.join(total, "query_label"), "query_id")
        .select("query_id", "item_id", "rank", (F.col("item_label") == F.col("query_label")).cast("int").alias("relevant"), "n_relevant")
    )


def _top(judgements: DataFrame, k: int) -> DataFrame:
    return judgements.where(F.col("rank") <= k)


def precision_at_k(judgements: DataFrame, k: int) -> DataFrame:
    return _top(judgements, k).groupBy("query_id").agg(F.round(F.sum("relevant") / k, 6).alias("precision"))


def recall_at_k(judgements: DataFrame, k: int) -> DataFrame:
    """Share of a query's relevant rows within the first k; 0 where it has none."""
    found = F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0))
    return judgements.groupBy("query_id", "n_relevant").agg(found.alias("found")).select("query_id", F.when(F.col("n_relevant") > 0, F.round(F.col("found") / F.col("n_relevant"), 6)).otherwise(0.0).alias("recall"))


def average_precision(judgements: DataFrame) -> DataFrame:
    """Mean precision at the ranks of the relevant rows that were returned; 0 where there are none. Its mean is mAP."""
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = judgements.withColumn("p", F.when(F.col("relevant") == 1, F.sum("relevant").over(run) / F.col("rank")))
    return at.groupBy("query_id").agg(F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 6).alias("average_precision"))


def mrr(judgements: DataFrame) -> DataFrame:
    """One row: the mean over queries of 1 / rank of the first relevant row, 0 where there is none."""
    first = judgements.groupBy("query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    return first.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n_queries"))


def ndcg_at_k(judgements: DataFrame, k: int) -> DataFrame:
    """Binary gain over the best possible within k; 0 where the query has no relevant row."""
    gain = F.sum(F.col("relevant") * F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).alias("dcg")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_relevant", F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, r: s + F.log(F.lit(2.0)) / F.log(r + 1.0))
    return _top(judgements, k).groupBy("query_id", "n_relevant").agg(gain).select("query_id", F.when(F.col("n_relevant") > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"))
