"""Diffusion: ranks by how scores flow over the neighbour graph of a query's candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.operators.search import best, ranked, scores

EDGES = "query_id long, a long, b long, weight double"


def candidate_edges(found: DataFrame, gallery: DataFrame, neighbours: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, a, b, weight): each candidate's nearest other candidates of the same query by cosine, where above zero.

    ``found`` has (query_id, item_id), a bounded number a query, as ``topk`` gives. A
    query's candidates meet in one group and only ``neighbours`` edges of each leave it;
    ties go to the smaller id. Candidates without a vector in ``gallery`` or with
    one of length zero have no edge. Of rows that repeat an id the smallest vector counts.
    """
    vectors = gallery.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(vector_col).alias("v"))
    # Only vectors that some query asks for are grouped; a popular one is joined to each of its queries.
    wanted = vectors.join(found.select("item_id").distinct(), "item_id", "left_semi").groupBy("item_id").agg(F.min("v").alias("v"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        ids, v = group["item_id"].to_numpy(), np.stack(group["v"].to_numpy()).astype(np.float64)
        s = scores(v, v, "cosine")
        s[ids[:, None] == ids[None, :]] = np.nan
        s[~(s > 0)] = np.nan
        rows = [(ids[i], ids[p], s[i, p]) for i, p in best(s, ids, neighbours, True)]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "a": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), "b": np.concatenate([r[1] for r in rows]), "weight": np.concatenate([r[2] for r in rows])})

    return found.select("query_id", "item_id").distinct().join(wanted, "item_id").groupBy("query_id").applyInPandas(link, EDGES)


def graph_edges(found: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, a, b, weight): the edges of a graph of all rows that have both ends among a query's candidates.

    ``graph`` has (query_id, item_id, score), as ``knn_graph`` gives; weights are its
    scores where above zero.
    """
    ends = found.select("query_id", "item_id").distinct()
    out = graph.where("score > 0").select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), F.col("score").alias("weight"))
    ahead = ends.withColumnRenamed("item_id", "a").join(out, "a")
    return ahead.join(ends.withColumnRenamed("item_id", "b"), ["query_id", "b"], "left_semi").select("query_id", "a", "b", "weight")


def diffuse(found: DataFrame, edges: DataFrame, k: int, alpha: float = 0.9, rounds: int = 20, least_change: float = 0.0) -> DataFrame:
    """Rank each query's candidates again by diffusion: (query_id, item_id, score, rank).

    ``found`` has (query_id, item_id, score), ``edges`` (query_id, a, b, weight) between
    candidates. An edge counts both ways, once, by its largest weight; weights are
    divided by the square roots of the sums at both ends. Scores f start as y, the
    candidate's own score or 0 if that is lower, and each round sets
    f = ``alpha`` * S f + (1 - ``alpha``) * y, until no score of the query
    changes by more than ``least_change``, or for ``rounds``. Queries are independent
    and their candidates bounded, so rows are shuffled once, for all rounds.

    A candidate without edges keeps (1 - ``alpha``) of its score. Null ids and scores
    are left out, rows that repeat a candidate count once by the largest score, edges
    that lead elsewhere or to themselves are ignored, a tie goes to the smaller item, and
    an empty table gives no row. Scores are rounded to six decimals before they are ranked.
    """
    own = found.where("query_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL").groupBy("query_id", "item_id").agg(F.max("score").cast("double").alias("score"))
    links = edges.where("a <> b AND weight > 0").select(F.col("query_id").alias("of"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    links = links.groupBy("of", "a", "b").agg(F.max("weight").cast("double").alias("weight"))

    def flow(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id")
        ids, y = rows["item_id"].to_numpy(), np.maximum(rows["score"].to_numpy(), 0)
        held = pairs[pairs["a"].isin(ids) & pairs["b"].isin(ids)].sort_values(["a", "b"])
        if not len(ids):
            return rows[["query_id", "item_id", "score"]]
        a, b, w = np.searchsorted(ids, held["a"]), np.searchsorted(ids, held["b"]), held["weight"].to_numpy()
        a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        degree = np.bincount(a, w, len(ids))
        w = w / np.sqrt(degree[a] * degree[b])
        f = y
        for _ in range(rounds):
            last, f = f, alpha * np.bincount(a, w * f[b], len(ids)) + (1 - alpha) * y
            if np.abs(f - last).max() <= least_change:
                break
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "item_id": ids, "score": f})

    spread = own.groupBy("query_id").cogroup(links.groupBy("of")).applyInPandas(flow, "query_id long, item_id long, score double")
    return ranked(spread.withColumn("score", F.round("score", 6)), k, True)
