"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.media import FEATURES, media_columns

    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", *FEATURES, "width", "height")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.suffixdedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), length=2048)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.langid import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.linededup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.quality import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.sortmeans import sort_means

    return sort_means(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.grayindex import simhash_duplicates

    out = simhash_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, list_slice(w, p0, p0 + least(10, len(w)) - 1) AS win, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p0 FROM b WHERE len(w) > 0)
), place AS (
  SELECT doc_id, n, p0, list_slice(w, p0, p0 + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM d, (SELECT DISTINCT n FROM win))
), hit AS (
  SELECT DISTINCT doc_id, p0, place.n, item FROM place JOIN win ON place.win = win.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0, false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle AS a JOIN shingle AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM pair JOIN size AS p ON p.doc_id = x JOIN size AS q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.y FROM reach JOIN edge ON reach.b = edge.x
), component AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN component USING (doc_id) LEFT JOIN size USING (doc_id)
"""

OP2_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)
), gone AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1
), island AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM gone)
), span AS (
  SELECT doc_id, min(p) AS low, max(p) + 100 AS high FROM island GROUP BY doc_id, i
), piece AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS back FROM span
), cut AS (
  SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(substr(h, 2 * back + 1, 2 * (low - back)), '' ORDER BY low) AS kept
  FROM piece JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""



OP9_SQL = """
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, k, line, n, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS c
  FROM (SELECT doc_id, k, x[k] AS line, length(trim(x[k], ' ')) AS n FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS k FROM d))
), run AS (
  SELECT a.doc_id, a.k AS low, min(b.k) AS high FROM l AS a JOIN l AS b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - a.c + a.n >= 60 GROUP BY a.doc_id, a.k
  UNION SELECT b.doc_id, max(a.k), b.k FROM l AS a JOIN l AS b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - a.c + a.n >= 60 GROUP BY b.doc_id, b.k
), held AS (
  SELECT run.*, min(doc_id) OVER (PARTITION BY list_slice(x, low, high)) AS first FROM run JOIN d USING (doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS k FROM held WHERE first < doc_id
), cut AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, coalesce(string_agg(CASE WHEN gone.k IS NULL THEN line END, chr(10) ORDER BY l.k), '') AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k GROUP BY l.doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(octet_length(encode(coalesce(kept, ''))) AS BIGINT) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN cut USING (doc_id)
"""

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), word AS (
  SELECT i, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term
), l AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang
), s AS (
  SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (kept.n + 2) // (l.total + 2 * l.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed ON summed.lang = a.lang AND summed.source = a.source AND summed.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM part
) WHERE part = 'pair' OR rank <= 10
"""


def _sort_means_sql(clusters: int, rounds: int) -> str:
    """Plain k-means: every vector against every centroid."""
    steps = [
        "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h, v LIMIT {clusters}))",
    ]
    for k in range(rounds + 1):
        apart = "CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT)"
        steps.append(f"a{k} AS (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, c) AS n FROM (SELECT i, vec_id, v.v, c, {apart} AS d FROM (SELECT *, row_number() OVER () AS i FROM v) AS v, c{k} AS c)) WHERE n = 1)")
        if k < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            parts = f"SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(64)) AS p, unnest(v) AS x FROM a{k}) GROUP BY c, p"
            steps.append(f"m{k} AS (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY p) AS v FROM ({parts}) GROUP BY c), c{k + 1} AS (SELECT c, coalesce(m.v, c.v) AS v FROM c{k} AS c LEFT JOIN m{k} AS m USING (c))")
    return ", ".join(steps) + (
        f" SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c USING (c)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op5_minhash": OP5_SQL, "op6_decontamination": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_sort_means": _sort_means_sql(16, 3), "op13_divergence": OP13_SQL}
