import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galleon.llm.media import from_png, media_columns, png_header, read_features, read_headers, to_png, write_shards
from galleon.llm.packing import OpenBins, _tokenizer, best_fit_packing, default_tokenizer, pack, token_bytes
from galleon.llm.sharding import balanced_bins, best_fit_decreasing, shard_by_bytes

SCHEMA = "doc_id long, text string, lang string, shard int, digest string, n_bytes long"
TEXTS = [None, "", "a", "a", "Ünï cödé " * 70, "x" * 576, "long word " * 40_000, "a", None]
ROWS = [(i if i != 8 else None, t, "en", 7, "clash", 1) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*ROWS, ROWS[2]]  # a repeated row, and extra columns with clashing names
    return spark.createDataFrame(rows, SCHEMA)


def padded(text):
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % 576 if data else 576)


@given(st.binary(min_size=1, max_size=3000))
@settings(max_examples=50, deadline=None)
def test_png_round_trip(data):
    data = data + b"\xff" * (-len(data) % 576)
    assert from_png(to_png(data)) == data and png_header(to_png(data)[:33]) == (576, len(data) // 576, 8)


def test_media_rows_are_read_back(docs):
    rows = media_columns(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    by_text = defaultdict(set)
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None else None
        want = padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        by_text[text or ""].add((r.media_sha256, r.feature, r.shard, r.offset))
    assert all(len(v) == 1 for v in by_text.values())


def test_one_object_a_digest_in_tar_members(spark, tmp_path):
    import tarfile

    data = [padded(t) for t in ["a", "b", "a", "c" * 700]]
    rows = spark.createDataFrame([(hashlib.sha256(d).digest(), d) for d in data], "digest binary, payload binary").coalesce(1)
    manifest = write_shards(rows, f"file://{tmp_path}", shard_bytes=1500)
    entries = manifest.collect()
    assert len(entries) == 3 and len({e.shard for e in entries}) > 1
    for e in entries:
        with tarfile.open(e.shard.removeprefix("file://")) as tar:
            assert from_png(tar.extractfile(e.digest.hex()).read()) in data
    assert {r.height for r in read_headers(manifest).collect()} == {1, 2}
    assert {r.payload_sha256 for r in read_features(manifest).collect()} == {hashlib.sha256(d).hexdigest() for d in data}


@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_bins(sizes, bins):
    where = balanced_bins(sizes, bins)
    assert len(where) == len(sizes) and all(0 <= b < bins for b in where)
    # By a plain scan of all bins.
    free, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = min(((space, b) for b, space in enumerate(free) if space >= sizes[i]), default=None)
        if fit is None:
            free.append(100)
            fit = 100, len(free) - 1
        want[i] = fit[1]
        free[fit[1]] -= sizes[i]
    assert best_fit_decreasing(sizes, 100) == want
    assert best_fit_decreasing([101], 100) is None and best_fit_decreasing([60, 60], 100, 1) is None


def test_balanced_bins_gives_a_giant_its_own_bin_and_levels_the_rest():
    sizes = [1000] + [1] * 390
    load = Counter()
    for s, b in zip(sizes, balanced_bins(sizes, 40), strict=True):
        load[b] += s
    assert sorted(load.values()) == [10] * 39 + [1000]


def test_sharding_keeps_groups_and_numbers_rows(spark, docs):
    more = docs.unionByName(spark.range(100, 900).selectExpr("id AS doc_id", "concat('text ', id % 400) AS text", "'en' AS lang", "1 AS shard", "'x' AS digest", "0L AS n_bytes"))
    rows = shard_by_bytes(more, 4).collect()
    assert len(rows) == more.count()
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert shard_by_bytes(more.limit(0), 4).count() == 0


def test_shards_are_near_equal(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(20 + pmod(hash(id), 900) AS INT)) || id AS text")
    loads = Counter()
    for r in shard_by_bytes(docs, 40).collect():
        loads[r.shard] += r.size
    mean = sum(loads.values()) / 40
    assert len(loads) == 40 and max(loads.values()) < 1.01 * mean and min(loads.values()) > 0.99 * mean


def test_token_ids_equal_the_tokenizer():
    tok = _tokenizer(default_tokenizer())
    for t in ["It's THE end., ok!", "a<|endoftext|>b", "É. x,. ,., 12.5 ΑΣ. İ", "", "日本語 текст\tтаб\x1cz\x85q", "don't.,can't,.'s", "a|b | || x| |y c.", "| .", "e \u0301x \u0301| \u00a0\u2003z"]:
        assert np.frombuffer(token_bytes(t.encode(), default_tokenizer()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_token_ids_equal_the_tokenizer_for_any_text(t):
    tok = _tokenizer(default_tokenizer())
    assert np.frombuffer(token_bytes(t.encode(), default_tokenizer()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_open_bins_never_overflow(sizes, limit):
    bins, used = OpenBins(64, limit), Counter()
    for n in sizes:
        b, offset = bins.put(n)
        assert offset == used[b]
        used[b] += n
        assert bins.open <= limit
    assert all(u <= 64 for u in used.values())


def test_best_fit_and_the_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.put(n)[0] for n in (6, 8, 2, 9)] == [0, 1, 1, 2]  # 2 fits tightest in bin 1, which fills up
    assert bins.put(7)[0] == 3 and bins.put(1)[0] == 3  # bin 2 was the fullest and closed


def test_few_sequences_are_made(spark):
    rng = np.random.default_rng(8)
    sizes = np.minimum(2048, np.exp(rng.normal(6.5, 0.9, 20_000))).astype(int) + 1
    sizes = np.minimum(sizes, 2048)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long")
    for per_task in (125_000, 6000):
        made = pack(rows, pieces_per_task=per_task).select("sequence_id").distinct().count()
        bound = -(-int(sizes.sum()) // 2048)
        assert bound <= made <= bound * 1.002 + 4


def test_packing_against_a_plain_scan_of_open_bins(spark):
    """Waves from long to short, the tightest open bin, the fullest closes: by lists, without a bitset."""
    rng = np.random.default_rng(3)
    sizes = [int(n) for n in np.minimum(100, np.exp(rng.normal(3.3, 0.9, 1500))).astype(int) + 1 if n <= 100] + [100, 100, 1]
    rows = spark.createDataFrame([(i if i % 50 else None, n) for i, n in enumerate(sizes)], "doc_id long, length long")
    closings = spark.sparkContext.accumulator(0)
    found = pack(rows, 100, open_bins=40, wave=200, closings=closings).collect()
    arrival = [r.length for r in rows.selectExpr("*", "xxhash64(doc_id, length) AS h").orderBy("h", "doc_id", "length").collect()]
    free, made, closed, want = {}, 0, 0, []
    for at in range(0, len(arrival), 200):
        for n in sorted(arrival[at : at + 200], reverse=True):
            fit = min((space for space in free.values() if space >= n), default=None)
            if fit is None:
                if len(free) >= 40:
                    free.pop(next(b for b, space in reversed(free.items()) if space == min(free.values())))
                    closed += 1
                b, space, made = made, 100, made + 1
            else:
                b, space = next(b for b, space in free.items() if space == fit), fit
            want.append((n, 100 - space))
            free.pop(b, None)
            if space > n:
                free[b] = space - n
    assert sorted((r.length, r.offset) for r in found) == sorted(want)
    assert len({r.sequence_id for r in found}) == made and closings.value == closed > 0


def test_the_limit_acts_and_costs_little(spark):
    rng = np.random.default_rng(9)
    sizes = np.minimum(2048, np.exp(rng.normal(6.5, 0.9, 60_000))).astype(int)
    closings = spark.sparkContext.accumulator(0)
    made = pack(spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long"), closings=closings).select("sequence_id").distinct().count()
    assert closings.value > 0 and made <= 1.001 * -(-int(sizes.sum()) // 2048)


def test_packing_covers_every_document(docs):
    tok = _tokenizer(default_tokenizer())
    rows = best_fit_packing(docs, length=256).collect()
    used, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append(r)
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    for i in (1, 4, 6):
        ids = np.array([*tok.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0], "<u4")
        for r in seen[i]:
            assert r.start == 256 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in seen[i]) == len(ids) and all(r.length == 256 for r in seen[i] if r.piece < len(seen[i]) - 1)
    assert sum(r.length for r in seen[2]) == 2 * (len(tok.encode("a", add_special_tokens=False).ids) + 1)  # the repeated row is packed twice
    assert best_fit_packing(docs.limit(0)).count() == 0
