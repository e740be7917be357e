"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleon.llm.common import shared_path, stored
from galleon.llm.decontamination import contamination
from galleon.llm.langid import fit, predict, training_rows
from galleon.llm.linededup import line_dedup
from galleon.llm.minhash import near_duplicates
from galleon.llm.packing import best_fit_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that the language model learns from.
FIT_ROWS = 10_000
#: A text whose best language has a lower posterior probability is rejected,
SURE = 0.5
#: and one whose letters that language explains so much worse than letters drawn at random (natural logarithm).
LOSS = -20.0


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The columns of documents with a number for each row, written so that it stays the same wherever it is read."""
    return stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), name)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language: not ``und``, not torn between languages, and explained by one at all.

    Where no row has a language to learn from, nothing can be recognised and all stay.
    A null or empty text has no letter and goes. Null ids and repeated rows are rows
    like others, an empty table gives no row, extra columns are left out.
    """
    known = F.col("lang").isNotNull() & F.col("text").isNotNull()
    model = fit(training_rows(docs, known, FIT_ROWS).select("text", "lang"))
    if not model.languages:
        return docs.select(*COLUMNS)
    known = predict(docs.select(*COLUMNS), model, with_gain=True)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE) & (F.col("gain") >= LOSS)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of lines that an earlier document has; a document left without any text goes.

    A document that loses nothing stays as it is, null text included, as does a row
    with a null id. Rows that repeat an id are cut each by its own text. An empty
    table gives no row; extra columns are left out.
    """
    out = line_dedup(docs.select(*COLUMNS))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select("doc_id", "text", "lang", "source", size)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near-duplicates.

    Documents are rows, not ids: of rows that repeat an id only those with like
    texts are a group, a null id comes last in its group, and among equal ids one
    row stays. Null texts and texts without words are like nothing and stay. An
    empty table gives no row; extra columns are left out.
    """
    rows = _numbered(docs, "minhash-rows")
    parts = near_duplicates(rows.select("row", "text"), width=5, percent=80, id_col="row").select("row", "component_id")
    named = parts.join(rows.select("row", "doc_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = stored(first.select(F.col("first.row").alias("row")), "minhash-kept")
    return rows.join(stay.hint("merge"), "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs.

    Each row is judged by its own text, whatever its id. Null and empty texts stay.
    An empty table gives no row, an empty benchmark drops none; extra columns are
    left out.
    """
    rows = _numbered(docs, "benchmark-rows")
    found = contamination(rows.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, id_col="row")
    bad = stored(found.where("contaminated").select("row"), "benchmark-hits")
    return rows.join(bad.hint("merge"), "row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, packed into sequences of 2048.

    A null or empty text is one piece with the end id alone; each row, repeated or
    with a null id, is packed. An empty table gives no row.
    """
    return best_fit_packing(docs.select("doc_id", "text"), length=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("pack_sequences", pack_sequences),
]

#: SQL expresses neither the language model nor the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
