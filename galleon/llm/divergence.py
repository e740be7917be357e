"""Audit of how the sources of a language differ in their terms: shards counted by DuckDB, merged by Spark."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleon.llm.common import payload, shuffle_partitions, small_batches, stored, worker_store

#: Bytes of terms: ASCII letters, small after translation, and all of a non-ASCII character; the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a task keeps before it hands them on.
HELD = 300_000
#: Counts, of every term in every source, that a shard holds about.
DENSE = 400_000
#: What DuckDB may hold in memory in a task; beyond that it spills.
MEMORY = "256MB"


@contextmanager
def in_duckdb() -> Iterator[duckdb.DuckDBPyConnection]:
    """A database of one task, on one thread; what it spills goes with it."""
    with tempfile.TemporaryDirectory() as spill:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill})
        try:
            yield con
        finally:
            con.close()


def terms(data: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of letters and non-ASCII characters, A-Z lower-cased."""
    return data.translate(TERM_BYTES).split(b" ") if data else []


def term_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, sums of about ``most`` counts of a task at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("divergence")  # lets go of what an earlier stage has left in the worker
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in groups.items():
                n.pop(b"", None)
                names, size = list(n), len(n)
                cols = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([in_docs[t] for t in names], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found), in_docs.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > most:
                yield from held()
        yield from held()

    return docs.select("lang", "source", payload("text").alias("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts): terms in ``least`` or more documents of their language, each once."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
        reader = pa.RecordBatchReader.from_batches(schema, batches)  # noqa: F841  DuckDB reads it by its name
        with in_duckdb() as con:
            con.execute("CREATE TABLE counted AS SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM reader GROUP BY ALL")
            kept = con.execute(
                "SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts "
                f"FROM counted GROUP BY lang, term HAVING sum(docs) >= {least}"
            )
            yield from kept.to_arrow_reader(10_000)

    by_term = counts.repartition(shuffle_partitions(counts.sparkSession), "lang", "term")
    return by_term.mapInArrow(settle, "lang string, term string, sources array<string>, counts array<long>")


#: Of one shard: p of each of its terms in each source and in the language, then partial sums of pairs and the first terms of each source.
#: A kept term has a p in every source of its language, so the two meet in full; ``DENSE`` bounds that.
SHARD_SQL = """
CREATE TABLE named AS SELECT row_number() OVER (ORDER BY term) AS t, term, list_sum(counts) AS n, sources, counts FROM terms;
CREATE TABLE grouped AS SELECT row_number() OVER (ORDER BY source) AS s, source, total, lang_total, v FROM sources;
CREATE TABLE held AS SELECT t, grouped.s, n FROM (SELECT t, unnest(sources) AS source, unnest(counts) AS n FROM named) JOIN grouped USING (source);
CREATE TABLE rated AS
  SELECT t, s, coalesce(held.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(held.n, 0) + 2)) // (total + 2 * v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (named.n + 2)) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM named CROSS JOIN grouped LEFT JOIN held USING (t, s);
CREATE TABLE summed AS
  SELECT a.s, b.s AS other, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM rated AS a JOIN rated AS b ON a.t = b.t AND a.s < b.s GROUP BY ALL;
CREATE TABLE first_terms AS
  SELECT s, t, (p - q) * (p - q) // (p + q) AS value FROM rated WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY value DESC, t) <= {most};
"""
RESULT_SQL = """
SELECT a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
FROM grouped AS a JOIN grouped AS b ON a.s < b.s LEFT JOIN summed ON summed.s = a.s AND summed.other = b.s
UNION ALL SELECT source, 'term', term, value FROM first_terms JOIN grouped USING (s) JOIN named USING (t)
"""


def source_divergence(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """How far the sources of each language are apart in their terms, and the terms that set each one apart.

    Terms are counted in the tasks that read them, the counts go to shards by a
    hash of language and term, and DuckDB sums a shard and keeps the terms in
    ``least`` documents of the language. Kept terms then go by the same hash to
    shards of about ``DENSE`` counts, as many as the language needs, each with
    the totals of the language's sources. There DuckDB computes the partial sums
    of all pairs of sources and the first ``most`` terms of each source. Spark
    adds the sums and ranks them. A frequent term is one row of a shard, and a
    large language or source is spread over all of its shards.

    Returns (lang, source, part, item, value, rank) with a rank from 1 for each
    (lang, source, part). Part ``pair`` has a row for each other source of the
    language, part ``term`` up to ``most`` rows. Null text, lang and source count as
    empty strings; a row with an empty text still makes its group occur. Rows that
    repeat an id are documents of their own. A language without kept terms has
    pairs of value 0, one with a single source has none. Extra columns are
    ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = stored(kept_terms(term_counts(own), least), "terms")
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("lang_total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    groups = stored(groups, "groups")
    shards = groups.groupBy("lang").agg((F.max("v") * F.count("*") / DENSE + 1).cast("int").alias("shards"))
    shards = stored(shards, "shards")
    left = kept.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.col("shards")).cast("int"))
    right = groups.join(shards, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def audit(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        if not terms.num_rows and key[1].as_py():
            return kinds.empty_table()  # the first shard of a language speaks for its pairs without terms
        with in_duckdb() as con:
            con.execute(SHARD_SQL.format(most=most))
            found = con.execute(RESULT_SQL).to_arrow_table()
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * found.num_rows, pa.string()), *found.columns], names=kinds.names).cast(kinds)

    def of(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("lang", "shard", *columns).groupBy("lang", "shard")

    parts = of(left, "term", "sources", "counts").cogroup(of(right, "source", "total", "lang_total", "v")).applyInArrow(audit, "lang string, source string, part string, item string, value long")
    parts = stored(parts, "parts")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = sums.select("lang", "value", turned).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    first = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.union(first).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most))
