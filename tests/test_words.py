"""Tiles and visual words, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleon.functions.tiles import image_tiles, tiles_of
from galleon.operators import words
from galleon.operators.words import visual_words, weighted, word_search

IMAGE = "vec_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, level int, samples string"


def test_tiles_of_an_image_by_hand():
    a = np.arange(64).reshape(8, 8)
    found = list(tiles_of(a, 4, 2))
    assert [t[:3] for t in found] == [(0, y, x) for y in (0, 2, 4) for x in (0, 2, 4)] + [(1, 0, 0)]
    assert found[4][3] == a[2:6, 2:6].astype(np.uint8).tobytes()
    assert found[9][3] == bytes((int(a[y, x]) + int(a[y, x + 1]) + int(a[y + 1, x]) + int(a[y + 1, x + 1])) // 4 for y in range(0, 8, 2) for x in range(0, 8, 2))


def test_the_table_function_has_a_row_for_each_tile(spark):
    rng = np.random.default_rng(1)
    shapes = {1: (8, 8, 1), 2: (5, 9, 3), 3: (4, 4, 4), 4: (3, 30, 1)}
    pixels = {i: rng.integers(0, 256, s).astype(np.uint8) for i, s in shapes.items()}
    rows = [(i, ("o", *pixels[i].shape, 0, bytearray(pixels[i].tobytes())), 1, "s") for i in shapes]
    rows += [(5, ("bad", -1, -1, -1, -1, bytearray()), 1, "s"), (6, None, 1, "s"), (None, rows[0][1], 1, "s"), rows[0]]
    found = sorted(((r.vec_id, r.level, r.top, r.left, bytes(r.samples)) for r in image_tiles(spark.createDataFrame(rows, IMAGE)).collect()), key=str)
    want = []
    for i in (1, 1, None, 2, 3, 4):
        p = pixels[1 if i is None else i].astype(int)
        want += [(i, *t) for t in tiles_of(p[:, :, :3].sum(2) // min(3, p.shape[2]), 4, 2)]
    assert found == sorted(want, key=str)
    assert image_tiles(spark.createDataFrame([], IMAGE)).count() == 0


def test_words_are_the_nearest_with_ties_to_the_smaller(spark):
    rng = random.Random(2)
    vocabulary = [(w, bytes(rng.randrange(4) for _ in range(3))) for w in range(9)] + [(20, b"\1\1\1"), (11, b"\1\1\1")]
    tiles = [(k, bytes(rng.randrange(4) for _ in range(3))) for k in range(60)] + [(70, b"ab"), (71, None), (None, b"abc")]
    found = visual_words(spark.createDataFrame(tiles, "vec_id long, samples binary"), spark.createDataFrame(vocabulary, "word int, samples binary"))
    want = [(k, min((sum((x - y) ** 2 for x, y in zip(t, v, strict=True)), w) for w, v in vocabulary)[1]) for k, t in tiles[:60]]
    assert sorted(map(tuple, found.collect())) == want
    assert visual_words(spark.createDataFrame(tiles, "vec_id long, samples binary"), spark.createDataFrame([], "word int, samples binary")).count() == 0


def plain_weights(rows):
    tf = Counter(rows)
    images = {i for i, _ in tf}
    df = Counter(w for _, w in tf)
    raw = {(i, w): n * math.log(len(images) / df[w]) for (i, w), n in tf.items() if df[w] < len(images)}
    norm = Counter()
    for (i, _), x in raw.items():
        norm[i] += x * x
    return {(i, w): x / math.sqrt(norm[i]) for (i, w), x in raw.items()}


def plain_search(weights, asked, k):
    out = []
    for q in asked:
        scores = Counter()
        for (i, w), x in weights.items():
            if i != q and (q, w) in weights:
                scores[i] += x * weights[q, w]
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 64])
def test_search_equals_scoring_everything_and_reads_less(spark, monkeypatch, block):
    rng = random.Random(3)
    rows = [(i, 10 * (i % 20) + min(9, int(rng.expovariate(0.5))) if rng.random() < 0.8 else rng.randrange(200)) for i in range(400) for _ in range(12)]
    rows += [(i, 300 + w) for i in range(400) for w in range(6) if rng.random() < 0.6]  # in many images, so of little weight
    rows += [(i, 999) for i in range(400)]  # in every image
    monkeypatch.setattr(words, "BLOCK", block)
    index = weighted(spark.createDataFrame(rows, "vec_id long, word int"))
    weights = plain_weights(rows)
    got = {(r.vec_id, r.word): r.weight for r in index.collect()}
    assert got.keys() == weights.keys() and all(abs(got[x] - weights[x]) < 1e-12 for x in got)
    counted = []
    found = word_search(index.where("vec_id % 20 = 0"), index, 5, counted=counted)
    want = plain_search(weights, range(0, 400, 20), 5)
    assert [r[:2] + r[3:] for r in sorted(map(tuple, found.collect()))] == [r[:2] + r[3:] for r in want]
    assert 0 < counted[0] < 0.7 * counted[1]


def test_few_images_and_empty_tables(spark):
    index = weighted(spark.createDataFrame([(1, 5), (2, 5), (2, 6), (3, 7), (None, 7)], "vec_id long, word int"))
    assert sorted(r.item_id for r in word_search(index.where("vec_id = 1"), index, 5).collect()) == [2]
    none = index.limit(0)
    assert word_search(none, index, 5).count() == 0 and word_search(index, none, 5).count() == 0
    assert weighted(spark.createDataFrame([], "vec_id long, word int")).agg(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("dense", [0, 16])
def test_alike_images_in_many_groups_make_no_table_of_pairs(spark, monkeypatch, dense):
    rng = random.Random(4)
    rows = [(i, rng.randrange(64)) for i in range(400) for _ in range(10)]
    made = []
    monkeypatch.setattr(words, "stored", lambda df, name, f=words.stored: (out := f(df, name), made.append(out.count()))[0])
    index = weighted(spark.createDataFrame(rows, "vec_id long, word int"))
    for name, value in (("STRIPE", 100), ("ASKED", 40), ("DENSE", dense), ("WAITING", 500)):
        monkeypatch.setattr(words, name, value, raising=False)
    found = word_search(index.where("vec_id % 4 = 0"), index, 5)
    assert [r[:2] + r[3:] for r in sorted(map(tuple, found.collect()))] == [r[:2] + r[3:] for r in plain_search(plain_weights(rows), range(0, 400, 4), 5)]
    assert max(made) <= len(rows)  # there are 40,000 pairs, nearly all with a word in common
