"""What the small vector operators give for nulls, empty vectors, repeated rows and empty tables."""

import pytest

from galleon.operators.expansion import centroids, sign_bucket, vector_norms

ROWS = [(1, [3.0, 4.0], 1, "x"), (1, [3.0, 4.0], 1, "x"), (2, None, 1, "x"), (3, [], 1, "x"), (4, [1.0, None], 1, "x"), (None, [-1.0, -2.0], None, "x")]


@pytest.fixture(scope="module")
def gallery(spark):
    return spark.createDataFrame(ROWS, "vec_id long, embedding array<float>, label int, norm string")


def test_norms(gallery):
    found = sorted((tuple(r) for r in vector_norms(gallery).collect()), key=str)
    assert found == sorted([(1, 5.0), (1, 5.0), (2, None), (3, 0.0), (4, None), (None, 2.236068)], key=str)
    assert vector_norms(gallery.limit(0)).count() == 0


def test_centroids(gallery):
    found = {(r.label, r.pos): r["mean"] for r in centroids(gallery).collect()}
    assert found == {(1, 0): 2.333333, (1, 1): 4.0, (None, 0): -1.0, (None, 1): -2.0}
    assert centroids(gallery.limit(0)).count() == 0


def test_sign_buckets(gallery):
    found = {r.bucket: (r.n, r.first_id) for r in sign_bucket(gallery, 2).collect()}
    assert found == {3: (2, 1), 1: (1, 4), 0: (2, 3)}
    assert sign_bucket(gallery.where("vec_id IS NULL"), 2).first().first_id is None
    assert sign_bucket(gallery.limit(0), 2).count() == 0
