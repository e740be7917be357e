"""Standing queries over a stream, against the same search over all rows at once."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleon.operators import search
from galleon.streaming.search import STORE, windowed_topk

#: Seconds: a first watermark of zero lets no row of the epoch's start pass.
BASE = 100_000
SCHEMA = "vec_id long, embedding array<float>, ts timestamp, score string"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STORE)
    yield
    spark.conf.unset(key)


def rows(n, seconds, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6))
    v[5] = v[4]
    return [(k, [float(np.float32(x)) for x in v[k]], k * seconds / n) for k in range(n)]


def frame(spark, part):
    return spark.createDataFrame([(i, v, t, "s") for i, v, t in part], "vec_id long, embedding array<float>, t double, score string").select("vec_id", "embedding", F.timestamp_micros(((F.col("t") + BASE) * 1_000_000).cast("long")).alias("ts"), "score")


def run(spark, queries, folder, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = windowed_topk(queries, stream, 3, 10, **options)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def result(spark, tmp_path):
    return sorted((int(r.window_start.timestamp()) - BASE, r.query_id, r.item_id, r.score, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def batch(spark, queries, part, before):
    """The search over each window that ends by then, all of its rows at once."""
    out = []
    for start in range(0, before, 10):
        own = [r for r in part if start <= r[2] < start + 10]
        if own and start + 10 <= before:
            out += [(start, r.query_id, r.item_id, r.score, r["rank"]) for r in search.topk(queries, frame(spark, own), 3).collect()]
    return sorted(out)


def write(spark, part, folder, name):
    frame(spark, part).coalesce(1).write.parquet(f"{folder}/{name}")


def test_any_order_and_a_restart_give_the_rows_of_a_batch(spark, tmp_path):
    part = rows(300, 60)
    queries = frame(spark, [r for r in part if r[0] % 20 == 0] + [(900, None, 0.0), (901, [0.0] * 6, 0.0)])
    folder = str(tmp_path / "in")
    random.Random(3).shuffle(part)
    write(spark, [*part[:150], (None, [1.0] * 6, 5.0), (902, None, 5.0), (903, [0.0] * 6, 5.0)], folder, "a")
    run(spark, queries, f"{folder}/*", tmp_path, late_seconds=70, block=4)
    assert result(spark, tmp_path) == []  # no window is closed
    write(spark, part[150:], folder, "b")
    run(spark, queries, f"{folder}/*", tmp_path, late_seconds=70, block=4)  # goes on from the checkpoint
    write(spark, [(999, [1.0] * 6, 131.0)], folder, "c")
    run(spark, queries, f"{folder}/*", tmp_path, late_seconds=70, block=4)
    found = result(spark, tmp_path)
    assert found == batch(spark, queries, part, 60) and len(found) == 6 * 15 * 3
    assert os.listdir(tmp_path / "check" / "state")


def test_rows_behind_the_watermark_are_too_late(spark, tmp_path):
    part = rows(80, 40, 2)
    queries = frame(spark, part[:2])
    folder = str(tmp_path / "in")
    early, late = [r for r in part if r[0] % 2 or r[2] >= 20], [r for r in part if not (r[0] % 2 or r[2] >= 20)]
    for name, some in (("a", early), ("b", late), ("c", [(999, [1.0] * 6, 60.0)])):
        write(spark, some, folder, name)
        run(spark, queries, f"{folder}/*", tmp_path)
    assert result(spark, tmp_path) == batch(spark, queries, early, 60)


def test_a_row_is_sent_to_few_blocks_in_its_own_type(spark, tmp_path):
    write(spark, rows(900, 60), str(tmp_path / "in"), "a")
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in") + "/*")
    plan = windowed_topk(frame(spark, rows(900, 60)), stream, 3, 10)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"explode\(sequence\(0, 0[,)]", plan) and "transform(" not in plan
