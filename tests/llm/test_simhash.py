"""SimHash by the Gray-order index, against every pair."""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from galleon.llm import grayindex
from galleon.llm.grayindex import GrayTree, fingerprint, fingerprints, joined, near_links, simhash_duplicates

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, fp long, id long, component_id string, node int, least string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, "c", 9, "l") for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    """Bit by bit, from the definition."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    """Smallest id reachable, every pair compared."""
    x = np.array(fps, np.uint64)
    label = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if k in (a, b) else k for k in label]
    least = {}
    for k, i in zip(label, ids, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in label]


def result(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=str)


@given(st.text(alphabet="aAbB \t\n\x0b\x0c\r\x1c\xa0éÄ.", max_size=60))
@settings(max_examples=300, deadline=None)
def test_fingerprint_by_its_definition(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text_counts_every_shingle(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefg") for _ in range(5000))
    monkeypatch.setattr(grayindex, "CHUNK", 100)
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_is_that_of_the_built_in_hash(spark):
    got = spark.sql("select xxhash64('one two three') as h").first().h
    assert fingerprint(b"One two  THREE") == got & (1 << 64) - 1


@given(st.sets(st.integers(0, 2**12 - 1), min_size=1, max_size=200), st.integers(0, 3), st.sampled_from([0, 20, 52]))
@settings(max_examples=100, deadline=None)
def test_tree_finds_all_near_ones_and_no_other(values, most, shift):
    fps = np.array(sorted(values, key=lambda v: rank(v << shift)), np.uint64) << np.uint64(shift)
    found = {(i, j) for some, place in GrayTree(fps).near(fps, most) for i, j in zip(some.tolist(), place.tolist(), strict=True)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= most}


def rank(v):
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> s
    return v


def test_rank_is_the_place_in_gray_order(spark):
    values = [k ^ k >> 1 for k in (0, 1, 2, 3, 1 << 62, (1 << 63) - 1, 1 << 63, (1 << 64) - 1)]
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    ranks = [r[0] for r in rows.coalesce(1).select(grayindex.gray_rank(rows.fp)).collect()]
    assert ranks == sorted(ranks) and ranks[1] == ranks[0] + 1 and ranks[0] == -(1 << 63)


def test_a_group_is_pruned_at_its_top():
    far = np.arange(4096, dtype=np.uint64) | np.uint64(0xFFF << 52)
    tree = GrayTree(np.array(sorted(far.tolist(), key=rank), np.uint64))
    assert list(tree.near(np.zeros(1, np.uint64), 2))[0][0].size == 0
    assert tree.levels[0][0].size == 1 and tree.levels[0][1][0] == np.uint64(0xFFFFFFFFFFFFF000)
    assert not (tree.levels[1][1] & tree.levels[0][1]).any()  # what the root has is not held again below


def test_labels_join_what_is_connected():
    assert joined(np.arange(6), np.array([5, 3, 4]), np.array([3, 1, 0])).tolist() == [0, 1, 2, 1, 0, 1]


@pytest.mark.parametrize("block,wide", [(1, 2), (3, 4), (64, 64)])
def test_links_connect_all_near_pairs(spark, monkeypatch, block, wide):
    rng = random.Random(block)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(6)})
    monkeypatch.setattr(grayindex, "WIDE", wide)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in fps], "fp long")
    links = [(r.a, r.b) for r in near_links(rows, 2, block).collect()]
    mask = (1 << 64) - 1
    place = {v: k for k, v in enumerate(fps)}
    label = joined(np.arange(len(fps)), *(np.array([place[x & mask] for x in side]) for side in zip(*links, strict=True)))
    want = plain_components(fps, list(range(len(fps))))
    assert label.tolist() == want


def test_a_dense_group_makes_few_links(spark):
    fps = [sum(1 << b for b in pair) for pair in ((i, j) for i in range(40) for j in range(i))]
    links = near_links(spark.createDataFrame([(v,) for v in fps], "fp long")).count()
    assert links <= 2 * len(fps)


def test_edge_cases(spark):
    long = " ".join(f"w{k % 977}" for k in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d"), (5, "A  b c D"), (5, "quite another text stands here"), (5, "quite another text stands here"), (None, "a b c d"), (None, "nobody else has it"), (7, long), (8, long.upper()), (9, "x")]
    found = result(simhash_duplicates(frame(spark, rows)))
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, plain_components(fps, [i for i, _ in rows]), strict=True), key=str)
    assert found == want
    assert simhash_duplicates(frame(spark, [])).columns == ["doc_id", "fp", "component_id"] and simhash_duplicates(frame(spark, [])).count() == 0


def test_registered_query_against_every_pair(spark):
    from galleon.llm.queries import op12_simhash

    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    fps = [plain_fingerprint(t) for _, t in texts]
    want = plain_components(fps, [i for i, _ in texts])
    found = op12_simhash(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(texts, fps, want, strict=True))
    assert sum(i != c for (i, _), c in zip(texts, want, strict=True)) > 10
    assert fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).count() == len(texts)
