import random

from pyspark.sql import functions as F

import corpus_pipeline
from galleon.llm.queries import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    rows = docs.collect()
    planted = [(9001, rows[0].text, rows[0].lang, "p", 1), (9002, None, "en", "p", 0), (9003, "", None, None, None), (9004, "12 34 56", "en", "p", 8)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            assert docs.where("doc_id IN (9002, 9003, 9004)").count() == 0
            assert docs.count() == before - 3
        if name == "line_dedup":
            assert docs.where("doc_id = 9001").count() == 0
    assert docs.where("length > 2048 OR offset + length > 2048").count() == 0 and docs.count() > 50


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def result(df):
    return sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None), sorted(r.text or "" for r in df.collect() if r.doc_id is None)


def test_documents_are_rows_in_near_dedup(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 100) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (2, near(a)), (2, b), (3, b), (None, c), (None, near(c)), (None, None), (None, None), (4, ""), (4, ""), (5, a), (1, a), (6, "long " + words(rng, 30_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], COLUMNS + ", row string, component_id int")
    out = corpus_pipeline.minhash_dedup(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    named, unnamed = result(out)
    assert named == sorted([(1, a), (2, b), (4, ""), (4, ""), (6, rows[-1][1])])
    assert len(unnamed) == 3 and unnamed[:2] == ["", ""] and unnamed[2] in (c, near(c))


def test_documents_are_rows_in_decontamination(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean, bad = "a clean text of its own", f"before {item} after"
    rows = [(None, clean), (None, bad), (1, clean), (1, bad), (2, bad), (2, None), (3, ""), (1, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], COLUMNS + ", contaminated string")
    out = corpus_pipeline.decontaminate(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, clean), (1, clean), (2, None), (3, ""), (1, clean)], key=str)


def test_texts_in_no_learned_language_go(spark):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40))
    other = ["Съешь же ещё этих мягких французских булок, да выпей чаю.", "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", noise]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(90_000 + k, t, "en", "p", 0) for k, t in enumerate([*other, "the"])], COLUMNS)
    out = corpus_pipeline.language_id(spark, docs.union(planted), SF)
    assert sorted(r.doc_id for r in out.where("doc_id >= 90000").collect()) == [90_003]
    assert out.where("doc_id < 90000").count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_pipeline_over_repeated_and_null_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = [(None, rows[0].text + " " + item, "en", None, 1), (None, rows[1].text, None, "p", 1), (rows[2].doc_id, rows[3].text, "de", "p", 1), (70_007, None, "en", "p", None), (70_008, "the of and " * 40_000, "en", "p", 0)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema)).withColumn("row", F.lit("x")).withColumn("N_LINES", F.lit(3))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack_sequences":
            assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before
            assert docs.where("doc_id = 70007").count() == 0 and docs.where("doc_id = 70008").count() == 1
            before = docs.count()
    assert docs.where("doc_id = 70008").count() > 10


def test_empty_documents_pass_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_documents_stay_where_no_language_can_be_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert sorted(corpus_pipeline.language_id(spark, docs, SF).collect()) == sorted(docs.collect())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
