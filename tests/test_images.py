from pyspark.sql import functions as F

from galleon.functions.images import average_hash, color_histogram, hash_distance, histogram_intersection
from galleon.sources.images import grey_images, read_images, write_png


def gallery(spark):
    return spark.createDataFrame([(1, [-1.0] * 32 + [1.0] * 32), (2, [0.0] * 64), (3, None)], "vec_id long, embedding array<float>")


def test_png_round_trip_and_invalid_files(spark, tmp_path):
    images = grey_images(gallery(spark))
    write_png(images, f"file://{tmp_path}")
    (tmp_path / "9.png").write_bytes(b"\x89PNG broken")
    found = {r.origin.rpartition("/")[2]: bytes(r.data) for r in read_images(spark, str(tmp_path)).select("image.*").collect()}
    assert found == {"1.png": bytes([0] * 32 + [255] * 32), "2.png": bytes([127] * 64)}
    assert read_images(spark, str(tmp_path), drop_invalid=False).count() == 3


def test_descriptors(spark):
    h = grey_images(gallery(spark)).select("vec_id", color_histogram(F.col("image"), 4).alias("h"), average_hash(F.col("image")).alias("code"))
    one, two = h.orderBy("vec_id").collect()
    assert one.h[0] == one.h[63] == 0.5 and sum(one.h) == 1
    assert two.h[21] == 1 and two.code == 0
    assert one.code == -(1 << 32)
    pair = h.where("vec_id = 1").select(F.col("h").alias("a"), F.col("code").alias("c")).join(h.where("vec_id = 2").select(F.col("h").alias("b"), F.col("code").alias("d")))
    assert tuple(pair.select(histogram_intersection(F.col("a"), F.col("b")), hash_distance(F.col("c"), F.col("d"))).first()) == (0.0, 32)


def test_invalid_image_gives_null(spark):
    bad = spark.createDataFrame([("x", -1, -1, -1, -1, b"")], "origin string, height int, width int, nChannels int, mode int, data binary").select(F.struct("*").alias("image"))
    assert tuple(bad.select(color_histogram(F.col("image")), average_hash(F.col("image"))).first()) == (None, None)
