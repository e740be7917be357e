"""Image shards: round trips, byte ranges, filters that read less, commit and abort."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

import __spark_entry__ as entry
from galleon.sources import shards

SCHEMA = "id long, height int, width int, channels int, data binary, note string"


def images(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        h, w, c = (int(x) for x in rng.integers(1, 9, 3))
        out.append((k, h, w, c, bytearray(rng.bytes(h * w * c)), "extra"))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    shards.register(spark)
    path = str(tmp_path_factory.mktemp("shards"))
    spark.createDataFrame(images(300), SCHEMA).repartition(2).write.format("image_shards").option("shard_bytes", 9000).mode("append").save(path)
    return path


def read(spark, path, **options):
    return spark.read.format("image_shards").options(**options).load(path)


def rows(df):
    return sorted((r.id, r.height, r.width, r.channels, bytes(r.data)) for r in df.collect())


WANT = [(i, h, w, c, bytes(d)) for i, h, w, c, d, _ in images(300)]


@pytest.mark.parametrize("split", [100, 5000, 32 << 20])
def test_round_trip_in_byte_ranges(spark, folder, split):
    found = read(spark, folder, split_bytes=split)
    files = [f for f in os.listdir(folder) if f.endswith(".shard")]
    assert rows(found) == WANT and 2 < len(files) < 30
    assert found.rdd.getNumPartitions() == sum(-(-os.path.getsize(f"{folder}/{f}") // split) for f in files)


def test_a_filter_on_headers_reads_fewer_bytes(spark, folder):
    every, some = read(spark, folder), read(spark, folder).where("width > 6 AND id IN (1, 2, 3, 5, 8, 13, 21, 34, 55) AND channels >= 2")
    assert rows(some) == [r for r in WANT if r[2] > 6 and r[0] in (1, 2, 3, 5, 8, 13, 21, 34, 55) and r[3] >= 2]
    fetched = lambda df: df.agg(F.sum("fetched")).first()[0] or 0
    assert fetched(some) < 0.5 * fetched(every)
    assert rows(read(spark, folder).where("length(data) > 100 AND height = 8")) == [r for r in WANT if len(r[4]) > 100 and r[1] == 8]


def test_filters_that_headers_cannot_answer_stay_with_spark(folder):
    reader = shards.ShardReader(folder, 1 << 20)
    left = list(reader.pushFilters([EqualTo(("id",), 4), GreaterThan(("height",), 2), In(("width",), (1, 2)), StringContains(("data",), "x"), EqualTo(("note",), 1)]))
    assert len(left) == 2 and reader.filters == [("id", "=", 4), ("height", ">", 2), ("width", "in", [1, 2])]


def test_overwrite_append_empty_and_abort(spark, tmp_path):
    shards.register(spark)
    path = str(tmp_path / "s")
    few = spark.createDataFrame(images(5), SCHEMA)
    few.write.format("image_shards").mode("append").save(path)
    few.where("id < 2").write.format("image_shards").mode("append").save(path)
    assert len(rows(read(spark, path))) == 7
    few.where("id = 3").write.format("image_shards").mode("overwrite").save(path)
    assert [r[0] for r in rows(read(spark, path))] == [3]
    few.limit(0).write.format("image_shards").mode("overwrite").save(path)
    assert read(spark, path).count() == 0
    few.write.format("image_shards").mode("append").save(path)
    broken = few.withColumn("data", F.when(F.col("id") == 4, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("image_shards").mode("append").save(path)
    assert len(rows(read(spark, path))) == 5 and not [f for f in os.listdir(path) if f.startswith("_aside")]


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "one.shard")
    shards.write_shard(path, iter([(1, 1, 2, 1, b"ab"), (2, 1, 2, 1, b"cd")]))
    assert [r[:1] + r[4:5] for r in shards.read_range(path, 0, 1 << 20, [])] == [(1, b"ab"), (2, b"cd")]
    body = bytearray(open(path, "rb").read())
    body[3] ^= 1
    open(path, "wb").write(body)
    with pytest.raises(ValueError):
        list(shards.read_range(path, 0, 1 << 20, []))


def test_nothing_is_written_while_the_query_is_built(spark, monkeypatch):
    asked = []
    monkeypatch.setattr("galleon.plans.retrieval.shared_folder", lambda s, name: asked.append(f"/tmp/galleon-{os.getpid()}-{name}") or asked[-1])
    found = entry.queries()["read_images"](spark, "/root/testdata/sf0.001")
    assert not os.path.exists(asked[0])
    assert found.count() == 500 and 0 < len(os.listdir(asked[0])) < 20
