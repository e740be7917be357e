"""Operators built on rankings and centroids: voting, expansion, fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleon.functions.vectors import norm, sign_code
from galleon.operators.search import in_blocks, scores, topk


def knn_vote(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """The label that most of the k nearest rows have: (query_id, label, votes); ties go to the smaller label."""
    near = topk(queries, gallery, k).join(gallery.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "label")
    return votes.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("query_id", "label", "votes")


def centroids(gallery: DataFrame) -> DataFrame:
    """Mean vector of each label, one row a place: (label, pos, mean), to six decimals.

    Null and empty vectors add nothing, a null component is left out of its mean, a null
    label is a label of its own, repeated rows count each, an empty table gives no row.
    """
    return gallery.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def as_vectors(places: DataFrame, key: str, value: str = "mean") -> DataFrame:
    """Rows of (key, pos, value) gathered to (key, embedding)."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value)))
    return places.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias("embedding"))


def nearest_centroid(gallery: DataFrame, means: DataFrame) -> DataFrame:
    """The label whose centroid is nearest to each row by L2: (vec_id, label, score). ``means`` has (label, embedding)."""

    def keep(ids, vectors, item_ids, items, _):
        s = scores(vectors, items, "l2")
        best = np.lexsort((np.broadcast_to(ids[:, None], s.shape), s), axis=0)[0]
        yield item_ids, ids[best].astype(np.int32), s[best, np.arange(len(item_ids))]

    own = means.select(F.col("label").cast("long").alias("vec_id"), "embedding")
    found = in_blocks(own, gallery, keep, "vec_id long, label int, score double")
    return found.groupBy("vec_id").agg(F.min(F.struct("score", "label")).alias("best")).select("vec_id", "best.label", "best.score")


def query_expansion(queries: DataFrame, gallery: DataFrame, m: int, k: int) -> DataFrame:
    """Search again with the mean of each query's m nearest rows, by inner product."""
    near = topk(queries, gallery, m).select("query_id", "item_id")
    places = near.join(gallery.select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("pos", "x")), "item_id")
    means = places.groupBy("query_id", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
    return topk(as_vectors(means, "query_id").withColumnRenamed("query_id", "vec_id"), gallery, k, "ip")


def rank_fusion(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (query_id, item_id, score, rank)."""
    every = None
    for r in rankings:
        part = r.select("query_id", "item_id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part"))
        every = part if every is None else every.union(part)
    fused = every.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_norms(gallery: DataFrame) -> DataFrame:
    """(vec_id, norm) of every row, to six decimals: null for a null vector or one with a null component, 0 for an empty one."""
    return gallery.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def sign_bucket(gallery: DataFrame, bits: int) -> DataFrame:
    """Rows by the signs of their first ``bits`` places: (bucket, n, first_id).

    Null vectors are left out; a component that is null, zero or missing gives a bit of 0;
    a null id counts in n but is never the first, unless it is alone (null then).
    """
    code: Column = sign_code(F.col("embedding"), bits)
    return gallery.where(F.col("embedding").isNotNull()).groupBy(code.alias("bucket")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
