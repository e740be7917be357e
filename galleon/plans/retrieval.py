"""Queries over ``embeddings`` and the DuckDB SQL that must return the same rows.

Searches ask with every vector whose id is divisible by 20, against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleon.functions.images import average_hash, color_histogram, hash_distance, histogram_intersection
from galleon.functions.tiles import image_tiles
from galleon.operators import approximate, descent, diffusion, evaluate, expansion, pivots, search
from galleon.operators.hashes import hash_neighbours
from galleon.operators.resampling import metric_intervals
from galleon.operators.words import visual_words, weighted, word_search
from galleon.sources.images import grey_images
from galleon.sources.shared import shared_folder, stored
from galleon.sources.shards import from_shards, in_shards
from galleon.streaming.search import STORE, windowed_topk

K, DEEP = 5, 10


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def asked(g: DataFrame) -> DataFrame:
    return g.where("vec_id % 20 = 0")


def _top(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = gallery(spark, sf_dir)
        return search.topk(asked(g), g, K, metric)

    return query


def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return pivots.range_search(asked(g), g, 0.3)


def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return search.filtered_topk(asked(g), g, F.col("label") < 5, K)


def topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return search.topk_per_label(asked(g), g, 2)


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_pairs(gallery(spark, sf_dir), 100)


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_dups(gallery(spark, sf_dir))


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return expansion.knn_vote(asked(g), g, 7)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.centroids(gallery(spark, sf_dir))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return expansion.nearest_centroid(g, expansion.as_vectors(expansion.centroids(g), "label"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return expansion.query_expansion(asked(g), g, 3, K)


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return expansion.rank_fusion([search.topk(asked(g), g, DEEP, "cosine"), search.topk(asked(g), g, DEEP, "l1")], K)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.vector_norms(gallery(spark, sf_dir))


def sign_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.sign_bucket(gallery(spark, sf_dir), 8)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return evaluate.judged(search.topk(asked(g), g, DEEP), g)


def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_at_k(_judged(spark, sf_dir), K)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_at_k(_judged(spark, sf_dir), K)


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_judged(spark, sf_dir))


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mrr(_judged(spark, sf_dir))


def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg_at_k(_judged(spark, sf_dir), K)


def map_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision with its interval, in all and for each label of the queries."""
    g = gallery(spark, sf_dir)
    labels = g.select(F.col("vec_id").alias("query_id"), "label")
    return metric_intervals(evaluate.average_precision(_judged(spark, sf_dir)).join(labels, "query_id"), "average_precision", ["label"])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image in a shard of many, read back by byte range. Files are written when the result is read."""
    shards = in_shards(grey_images(gallery(spark, sf_dir)), shared_folder(spark, "images"))
    return from_shards(shards).select(F.col("id").alias("vec_id"), "height", "width", "channels", F.hex("data").alias("samples"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grey_images(gallery(spark, sf_dir)).select("vec_id", F.posexplode(color_histogram(F.col("image"), 4)).alias("cell", "share"))
    return cells.where("share > 0")


def histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images whose histograms share most with each asked one; equal histograms are compared once."""
    h = grey_images(gallery(spark, sf_dir)).select("vec_id", color_histogram(F.col("image"), 4).alias("embedding"))
    # |min| sums are (1 + 1 - L1) / 2, so the nearest by L1 are the nearest by intersection.
    near = search.topk(asked(h), h, K, "l1").select("query_id", "item_id", "rank")
    own = h.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
    other = h.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("b"))
    return near.join(own, "query_id").join(other, "item_id").select("query_id", "item_id", F.round(histogram_intersection(F.col("a"), F.col("b")), 6).alias("score"), "rank")


def average_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = grey_images(gallery(spark, sf_dir)).select("vec_id", average_hash(F.col("image")).alias("code"))
    return h.select("vec_id", "code", hash_distance(F.col("code"), F.lit(0).cast("long")).cast("long").alias("ones"))


def hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose average hashes differ in 20 bits or fewer from an asked one's."""
    h = grey_images(gallery(spark, sf_dir)).select("vec_id", average_hash(F.col("image")).alias("code"))
    return hash_neighbours(asked(h), h, 20)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of 4 x 4 samples of each image and of its half-size copy."""
    return image_tiles(grey_images(gallery(spark, sf_dir))).select("vec_id", "level", "top", "left", F.hex("samples").alias("samples"))


def word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by visual words. The vocabulary is the middle tile of the 64 images with the smallest ids, numbered by id."""
    t = image_tiles(grey_images(gallery(spark, sf_dir)))
    middle = t.where("level = 0 AND top = 2 AND left = 2").orderBy("vec_id").limit(64)
    index = stored(weighted(visual_words(t, middle.select(F.col("vec_id").cast("int").alias("word"), "samples"))), "words")
    return word_search(asked(index), index, K)


def stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a stream, one a second: the best of each 100 seconds for each asked one, as windows close."""
    g = gallery(spark, sf_dir)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(g.schema).parquet(f"{sf_dir}/embeddings.parque[t]").withColumn("ts", F.timestamp_seconds(F.col("vec_id") + 1))
    found = windowed_topk(asked(g), stream, K, 100)
    path = shared_folder(spark, "stream")
    run = found.writeStream.format("parquet").option("compression", "zstd").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{path}/rows")
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "query_id", "item_id", "score", "rank")


def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return approximate.lsh_topk(asked(g), g, K)


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return approximate.ivf_topk(asked(g), g, K)


def pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return approximate.pq_topk(asked(g), g, K)


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector, by descent."""
    return descent.knn_graph(gallery(spark, sf_dir), K)


def diffusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest of each asked vector, ranked again by 20 rounds of diffusion over their own neighbour graph."""
    g = gallery(spark, sf_dir)
    found = stored(search.topk(asked(g), g, 50), "candidates")
    return diffusion.diffuse(found, diffusion.candidate_edges(found, g, 5), K, rounds=20)


def pca_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced vectors, to four decimals."""
    return approximate.pca_reduce(gallery(spark, sf_dir)).select("vec_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "cosine_topk": _top("cosine"), "ip_topk": _top("ip"), "l2_topk": _top("l2"), "l1_topk": _top("l1"), "hamming_topk": _top("hamming"),
        "range_search": range_search, "filtered_topk": filtered_topk, "topk_per_label": topk_per_label, "top_pairs": top_pairs, "exact_dups": exact_dups,
        "knn_vote": knn_vote, "centroids": centroids, "nearest_centroid": nearest_centroid, "query_expansion": query_expansion, "rank_fusion": rank_fusion,
        "vector_norms": vector_norms, "sign_bucket": sign_bucket,
        "precision_at_k": precision_at_k, "recall_at_k": recall_at_k, "average_precision": average_precision, "mrr": mrr, "ndcg_at_k": ndcg_at_k, "map_intervals": map_intervals,
        "read_images": images, "color_histogram": histograms, "histogram_intersection": histogram_topk, "average_hash": average_hashes, "hash_neighbours": hash_pairs, "stream_topk": stream_topk, "image_tiles": tiles, "word_topk": word_topk,
        "lsh_topk": lsh_topk, "ivf_topk": ivf_topk, "pq_topk": pq_topk, "knn_graph": knn_graph, "diffusion_topk": diffusion_topk, "pca_reduce": pca_reduce,
    }


_G = "g AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT item_id AS query_id, label AS query_label, v FROM g WHERE item_id % 20 = 0)"
_SCORE = {
    "cosine": ("list_cosine_similarity(q.v, g.v)", "DESC"),
    "ip": ("list_inner_product(q.v, g.v)", "DESC"),
    "l2": ("list_distance(q.v, g.v)", "ASC"),
    "l1": ("list_sum(list_transform(list_zip(q.v, g.v), lambda x: abs(x[1] - x[2])))", "ASC"),
    "hamming": ("CAST(list_sum(list_transform(list_zip(q.v, g.v), lambda x: CASE WHEN sign(x[1]) <> sign(x[2]) THEN 1 ELSE 0 END)) AS DOUBLE)", "ASC"),
}


def _ranked(metric: str, name: str, where: str = "true", q: str = "q") -> str:
    """Tables {name}_s with all scores and {name} with ranks."""
    score, order = _SCORE[metric]
    return (
        f"{name}_s AS (SELECT q.query_id, g.item_id, g.label, round({score}, 6) AS score FROM {q} AS q, g WHERE q.query_id <> g.item_id AND {where}), "
        f"{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, item_id) AS INTEGER) AS rank FROM {name}_s)"
    )


def _topk_sql(metric: str, where: str = "true") -> str:
    return f"WITH {_G}, {_ranked(metric, 'r', where)} SELECT query_id, item_id, score, rank FROM r WHERE rank <= {K}"


_JUDGED = (
    f"WITH {_G}, {_ranked('cosine', 'r')}, n AS (SELECT label, count(*) - 1 AS n_relevant FROM g GROUP BY label), "
    f"j AS (SELECT r.query_id, r.rank, CAST(r.label = q.query_label AS INTEGER) AS relevant, n.n_relevant FROM r JOIN q USING (query_id) JOIN n ON n.label = q.query_label WHERE r.rank <= {DEEP}) "
)
_MEANS = "m AS (SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM g) GROUP BY label, pos)"
_BYTE = "CAST(least(greatest(floor((x + 1) * 127.5), 0), 255) AS INTEGER)"
_SAMPLES = f"s AS (SELECT vec_id, pos, {_BYTE} AS b FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings))"


def oracle_sql() -> dict[str, str]:
    sql = {f"{m}_topk": _topk_sql(m) for m in _SCORE}
    sql["range_search"] = f"WITH {_G}, {_ranked('cosine', 'r')} SELECT query_id, item_id, score FROM r_s WHERE score >= 0.3"
    sql["stream_topk"] = (
        f"WITH {_G}, {_ranked('cosine', 'r')}, w AS (SELECT *, (item_id + 1) // 100 * 100 AS window_start FROM r_s), "
        "t AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start, query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM w) "
        f"SELECT window_start, query_id, item_id, score, rank FROM t WHERE rank <= {K} AND window_start + 100 <= (SELECT max(item_id) + 1 FROM g)"
    )
    sql["filtered_topk"] = _topk_sql("cosine", "g.label < 5")
    sql["topk_per_label"] = (
        f"WITH {_G}, {_ranked('cosine', 'r')} SELECT query_id, label, item_id, score, rank FROM "
        "(SELECT query_id, label, item_id, score, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM r_s) WHERE rank <= 2"
    )
    sql["top_pairs"] = f"WITH {_G} SELECT a.item_id AS a_id, b.item_id AS b_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM g AS a, g AS b WHERE a.item_id < b.item_id ORDER BY score DESC, a_id, b_id LIMIT 100"
    sql["exact_dups"] = "SELECT min(vec_id) AS first_id, count(*) AS copies FROM embeddings GROUP BY embedding HAVING count(*) > 1"
    sql["knn_vote"] = (
        f"WITH {_G}, {_ranked('cosine', 'r')}, v AS (SELECT query_id, label, count(*) AS votes FROM r WHERE rank <= 7 GROUP BY query_id, label) "
        "SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n FROM v) WHERE n = 1"
    )
    sql["centroids"] = f"WITH {_G}, {_MEANS} SELECT label, CAST(pos AS INTEGER) AS pos, mean FROM m"
    sql["nearest_centroid"] = (
        f"WITH {_G}, {_MEANS}, c AS (SELECT label, list(mean ORDER BY pos) AS c FROM m GROUP BY label), "
        "s AS (SELECT g.item_id AS vec_id, c.label, round(list_distance(g.v, c.c), 6) AS score FROM g, c) "
        "SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, label) AS n FROM s) WHERE n = 1"
    )
    sql["query_expansion"] = (
        f"WITH {_G}, {_ranked('cosine', 'r')}, p AS (SELECT r.query_id, unnest(range(0, 64)) AS pos, unnest(g.v) AS x FROM r JOIN g USING (item_id) WHERE rank <= 3), "
        "e AS (SELECT query_id, list(mean ORDER BY pos) AS v FROM (SELECT query_id, pos, round(avg(x), 6) AS mean FROM p GROUP BY query_id, pos) GROUP BY query_id), "
        f"{_ranked('ip', 't', 'true', 'e')} SELECT query_id, item_id, score, rank FROM t WHERE rank <= {K}"
    )
    sql["rank_fusion"] = (
        f"WITH {_G}, {_ranked('cosine', 'r')}, {_ranked('l1', 't')}, u AS (SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) AS part FROM r WHERE rank <= {DEEP} UNION ALL SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) FROM t WHERE rank <= {DEEP}), "
        "f AS (SELECT query_id, item_id, round(sum(part), 9) AS score FROM u GROUP BY query_id, item_id) "
        f"SELECT query_id, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM f) WHERE rank <= {K}"
    )
    sql["vector_norms"] = f"WITH {_G} SELECT item_id AS vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM g"
    sql["sign_bucket"] = (
        "WITH b AS (SELECT vec_id, CAST(sum(CASE WHEN x > 0 THEN pow(2, pos) ELSE 0 END) AS BIGINT) AS bucket FROM "
        "(SELECT vec_id, unnest(range(0, 8)) AS pos, unnest(embedding[1:8]) AS x FROM embeddings) GROUP BY vec_id) "
        "SELECT bucket, count(*) AS n, min(vec_id) AS first_id FROM b GROUP BY bucket"
    )
    sql["precision_at_k"] = _JUDGED + f"SELECT query_id, round(sum(relevant) / {K}, 6) AS precision FROM j WHERE rank <= {K} GROUP BY query_id"
    sql["recall_at_k"] = _JUDGED + f"SELECT query_id, CASE WHEN n_relevant > 0 THEN round(sum(CASE WHEN rank <= {K} THEN relevant ELSE 0 END) / n_relevant, 6) ELSE 0.0::DOUBLE END AS recall FROM j GROUP BY query_id, n_relevant"
    sql["average_precision"] = _JUDGED + (
        "SELECT query_id, round(coalesce(avg(p), 0), 6) AS average_precision FROM (SELECT query_id, CASE WHEN relevant = 1 THEN sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) / rank END AS p FROM j) GROUP BY query_id"
    )
    above = [sum(exp(-1) / factorial(k) for k in range(n + 1)) for n in range(11)]
    weight = " + ".join(f"CAST(u >= {x!r} AS INTEGER)" for x in above)
    sql["map_intervals"] = _JUDGED + (
        ", p AS (SELECT query_id, round(coalesce(avg(p), 0), 6) AS x FROM (SELECT query_id, CASE WHEN relevant = 1 THEN sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) / rank END AS p FROM j) GROUP BY query_id), "
        "u AS (SELECT label, x, draw, CAST('0x' || substr(md5(query_id || ':' || draw), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM p JOIN g ON item_id = query_id, (SELECT unnest(range(0, 201)) AS draw)), "
        f"w AS (SELECT label, x, draw, CASE WHEN draw = 0 THEN 1 ELSE {weight} END AS w FROM u), "
        "m AS (SELECT label, grouping(label) = 1 AS whole, draw, sum(w) AS n, round(CAST(sum(CAST(x AS DECIMAL(20,9)) * w) AS DOUBLE) / sum(w), 6) AS mean FROM w GROUP BY GROUPING SETS ((draw, label), (draw)) HAVING sum(w) > 0), "
        "f AS (SELECT label, whole, CAST(max(CASE WHEN draw = 0 THEN n END) AS BIGINT) AS n, max(CASE WHEN draw = 0 THEN mean END) AS mean, list_sort(list(mean) FILTER (draw > 0)) AS found FROM m GROUP BY label, whole) "
        "SELECT label, whole, n, mean, found[greatest(1, CAST(ceil(len(found) * 0.05::DOUBLE) AS INTEGER))] AS low, found[greatest(1, CAST(ceil(len(found) * 0.95::DOUBLE) AS INTEGER))] AS high FROM f WHERE len(found) > 0"
    )
    sql["mrr"] = _JUDGED + "SELECT round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, count(*) AS n_queries FROM (SELECT query_id, min(CASE WHEN relevant = 1 THEN rank END) AS f FROM j GROUP BY query_id)"
    sql["ndcg_at_k"] = _JUDGED + (
        f"SELECT query_id, CASE WHEN n_relevant > 0 THEN round(sum(relevant * ln(2) / ln(rank + 1)) / list_sum(list_transform(range(1, least(n_relevant, {K}) + 1), lambda r: ln(2) / ln(r + 1))), 6) ELSE 0.0::DOUBLE END AS ndcg "
        f"FROM j WHERE rank <= {K} GROUP BY query_id, n_relevant"
    )
    sql["read_images"] = f"WITH {_SAMPLES} SELECT vec_id, 8 AS height, 8 AS width, 1 AS channels, string_agg(printf('%02X', b), '' ORDER BY pos) AS samples FROM s GROUP BY vec_id"
    sql["color_histogram"] = f"WITH {_SAMPLES} SELECT vec_id, (b * 4 // 256) * 21 AS cell, count(*) / 64 AS share FROM s GROUP BY vec_id, cell"
    sql["histogram_intersection"] = (
        f"WITH {_SAMPLES}, h AS (SELECT vec_id, list(share ORDER BY c) AS v FROM (SELECT vec_id, c, count(CASE WHEN b * 4 // 256 = c THEN 1 END) / 64 AS share FROM s, (SELECT unnest(range(0, 4)) AS c) GROUP BY vec_id, c) GROUP BY vec_id), "
        "t AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: least(x[1], x[2]))), 6) AS score FROM h AS a, h AS b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) "
        f"SELECT query_id, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM t) WHERE rank <= {K}"
    )
    code = (
        f"WITH {_SAMPLES}, m AS (SELECT vec_id, avg(b) AS mean FROM s GROUP BY vec_id), "
        "c AS (SELECT vec_id, sum(CASE WHEN b > mean THEN CAST(1 AS HUGEINT) << CAST(pos AS HUGEINT) ELSE 0 END) AS code, count(CASE WHEN b > mean THEN 1 END) AS ones FROM s JOIN m USING (vec_id) GROUP BY vec_id) "
    )
    sql["hash_neighbours"] = code + (
        "SELECT a.vec_id AS query_id, b.vec_id AS item_id, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS distance "
        "FROM c AS a JOIN c AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 20"
    )
    tile = (
        f"WITH {_SAMPLES}, a AS (SELECT vec_id, 0 AS level, pos // 8 AS y, pos % 8 AS x, b FROM s UNION ALL SELECT vec_id, 1, pos // 16, pos % 8 // 2, CAST(sum(b) // 4 AS INTEGER) FROM s GROUP BY vec_id, pos // 16, pos % 8 // 2), "
        "p AS (SELECT level, top, lft FROM (SELECT unnest([0, 0, 0, 0, 0, 0, 0, 0, 0, 1]) AS level, unnest([0, 0, 0, 2, 2, 2, 4, 4, 4, 0]) AS top, unnest([0, 2, 4, 0, 2, 4, 0, 2, 4, 0]) AS lft)), "
        "t AS (SELECT vec_id, p.level, p.top, p.lft, list(b ORDER BY y, x) AS v FROM a JOIN p ON a.level = p.level AND y BETWEEN top AND top + 3 AND x BETWEEN lft AND lft + 3 GROUP BY ALL)"
    )
    sql["image_tiles"] = tile + " SELECT vec_id, level, top, lft AS \"left\", array_to_string(list_transform(v, lambda b: printf('%02X', b)), '') AS samples FROM t"
    sql["word_topk"] = tile + (
        ", voc AS (SELECT vec_id AS word, v FROM t WHERE level = 0 AND top = 2 AND lft = 2 ORDER BY vec_id LIMIT 64), "
        "near AS (SELECT t.vec_id, t.level, t.top, t.lft, arg_min(word, list_sum(list_transform(list_zip(t.v, voc.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 1000000 + word) AS word FROM t, voc GROUP BY ALL), "
        "tf AS (SELECT vec_id, word, count(*) AS tf FROM near GROUP BY ALL), n AS (SELECT count(DISTINCT vec_id) AS n FROM tf), "
        "df AS (SELECT word, ln(n / count(*)) AS idf FROM tf, n GROUP BY word, n HAVING ln(n / count(*)) > 0), "
        "raw AS (SELECT vec_id, word, tf * idf AS x FROM tf JOIN df USING (word)), w AS (SELECT vec_id, word, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS weight FROM raw), "
        "r AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(sum(a.weight * b.weight), 6) AS score FROM w AS a JOIN w AS b USING (word) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL) "
        f"SELECT query_id, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM r) WHERE rank <= {K}"
    )
    sql["diffusion_topk"] = (
        f"WITH RECURSIVE {_G}, {_ranked('cosine', 'r')}, c AS (SELECT query_id, item_id, score FROM r WHERE rank <= 50), "
        "p AS (SELECT x.query_id, x.item_id AS a, y.item_id AS b, round(list_cosine_similarity(gx.v, gy.v), 6) AS w FROM c AS x JOIN c AS y ON x.query_id = y.query_id AND x.item_id <> y.item_id JOIN g AS gx ON gx.item_id = x.item_id JOIN g AS gy ON gy.item_id = y.item_id), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY query_id, a ORDER BY w DESC, b) AS n FROM p WHERE w > 0), "
        "e AS (SELECT query_id, least(a, b) AS lo, greatest(a, b) AS hi, max(w) AS w FROM n WHERE n <= 5 GROUP BY ALL), "
        "u AS (SELECT query_id, lo AS a, hi AS b, w FROM e UNION ALL SELECT query_id, hi, lo, w FROM e), d AS (SELECT query_id, a, sum(w) AS d FROM u GROUP BY ALL), "
        "m AS (SELECT u.query_id, u.a, u.b, u.w / sqrt(x.d * y.d) AS w FROM u JOIN d AS x ON x.query_id = u.query_id AND x.a = u.a JOIN d AS y ON y.query_id = u.query_id AND y.a = u.b UNION ALL SELECT query_id, item_id, item_id, 0 FROM c), "
        "f AS (SELECT 0 AS step, query_id, item_id, greatest(score, 0) AS x FROM c UNION ALL "
        "SELECT f.step + 1, m.query_id, m.a, 0.9::DOUBLE * sum(m.w * f.x) + 0.1::DOUBLE * greatest(any_value(c.score), 0) FROM f JOIN m ON m.query_id = f.query_id AND m.b = f.item_id "
        "JOIN c ON c.query_id = m.query_id AND c.item_id = m.a WHERE f.step < 20 GROUP BY f.step, m.query_id, m.a), "
        "t AS (SELECT query_id, item_id, round(x, 6) AS score FROM f WHERE step = 20) "
        f"SELECT query_id, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM t) WHERE rank <= {K}"
    )
    sql["average_hash"] = code + (
        "SELECT vec_id, CAST(CASE WHEN code >= CAST(9223372036854775808 AS HUGEINT) THEN code - CAST(18446744073709551616 AS HUGEINT) ELSE code END AS BIGINT) AS code, ones FROM c"
    )
    return sql
