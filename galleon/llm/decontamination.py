"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleon.llm.common import stored, text_or_empty

#: Values of the word filter that goes before the shuffled join: an upper bound of its rows.
FILTER = 1 << 20
_PLAIN = set(string.ascii_lowercase + string.digits)
_FROM = "".join(chr(c) for c in range(128) if chr(c) not in _PLAIN)
_TO = "".join(c.lower() if c.isalpha() else " " for c in _FROM)


def spaced_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space between: runs of a-z, 0-9 and anything beyond ASCII."""
    return F.array_join(F.filter(F.split(F.translate(text, _FROM, _TO), " "), lambda w: w != ""), " ")


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def item_windows(benchmark: DataFrame, length: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of ``length`` words with the ids of their items; an item with fewer words is one window."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), _words(spaced_words(text_or_empty(text_col))).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    windows = items.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("at"))
    return windows.groupBy(F.slice("words", F.col("at"), F.lit(length)).alias("window")).agg(F.collect_set("item").alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Which words of each document lie inside a benchmark window that occurs there.

    Words are ordered by rarity in the whole corpus. A window can only occur
    where its rarest word does, so that one word is the prefix that has to be
    joined; a window with a word that the corpus lacks falls away. Candidates
    must leave room for the window before and after the word, and are then
    compared in full with the document's words at that place.

    The prefix table is broadcast where its measured size is below
    ``broadcast_bytes``; beyond that words that no prefix can equal are filtered
    out by a table of at most ``FILTER`` hash values, the join is shuffled, and the
    candidates go back to their rows.

    Returns (id, n_words, n_hit, n_items, items_sha256, contaminated). A null or
    empty text has no words and a null or empty item no windows; either table may
    be empty. Each input row gives a row from its own text alone, so repeated ids
    and null ids are rows like others. An item with a null id is named ``null``.
    Extra columns are ignored.
    """
    # The number of a row is written with it, so that it stays the same wherever the table is read.
    spaced = stored(documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), spaced_words(text_or_empty(text_col)).alias("spaced")), "words")
    windows = stored(item_windows(benchmark, length), "windows")
    wanted = windows.select(F.explode("window").alias("word")).distinct()
    size = windows.agg(F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 64)).first()[0] or 0
    small = size <= broadcast_bytes

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # At most one row for each word of the windows.
    counts = spaced.select(F.explode(_words(F.col("spaced"))).alias("word")).join(hint(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))
    rarest = (
        windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
        .join(hint(counts), "word")
        .groupBy("window", "items")
        .agg(F.min(F.struct("n", "offset", "word")).alias("first"), F.count("*").alias("found"))
        .where(F.col("found") == F.size("window"))
        .select(F.col("first.word").alias("word"), F.col("first.offset").alias("offset"), "window", "items")
    )
    prefixes = stored(rarest, "prefixes")

    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    equal = F.slice("words", F.col("start") + 1, F.size("window")) == F.col("window")
    texts = spaced.select("row", _words(F.col("spaced")).alias("words"))
    if small:
        places = texts.select("row", "words", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
        found = places.join(F.broadcast(prefixes), "word").where(fits).withColumn("start", start).where(equal)
    else:
        value = F.pmod(F.xxhash64("word"), F.lit(FILTER))
        wanted = prefixes.select(value.alias("value")).distinct()
        places = texts.select("row", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word")).withColumn("value", value).join(F.broadcast(wanted), "value", "left_semi")
        near = places.join(prefixes, "word").where(fits).select(F.col("row").alias("near_row"), start.alias("start"), "window", "items")
        found = texts.join(near, F.col("row") == F.col("near_row")).where(equal)
    hits = stored(found.select("row", "start", (F.col("start") + F.size("window")).alias("end"), "items").distinct(), "hits")

    ordered = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(ordered), F.lit(0))))
    covered = hits.select("row", "start", "end").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found_in = covered.join(named, "row").select(F.col("row").alias("found_row"), "n_hit", "items")
    rows = spaced.select("row", "id", F.size(_words(F.col("spaced"))).cast("long").alias("n_words"))
    return rows.join(found_in, F.col("row") == F.col("found_row"), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.encode(F.coalesce(F.array_join("items", ","), F.lit("")), "UTF-8"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
