import glob
import hashlib
import random
import tempfile
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galleon.llm import minhash, suffixes
from galleon.llm.common import RELEASE
from galleon.llm.components import connected_components
from galleon.llm import linededup
from galleon.llm.linededup import common_runs, line_dedup, patience_blocks, repeated_lines
from galleon.llm.minhash import MinHash, links_within, near_duplicates, shingles
from galleon.llm import suffixdedup
from galleon.llm.suffixdedup import remove_repeats
from galleon.llm.suffixes import Scratch, suffix_array
from galleon.llm.windows import ragged, window_runs

SCHEMA = "doc_id long, text string, key string, component_id long, node long, n_lines long, doc long, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 0, 0, 0, 0, "s") for i, t in rows], SCHEMA)


def common(a, b, most):
    return min(most, next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))


@given(st.lists(st.integers(0, 4), max_size=150), st.booleans(), st.sampled_from([None, 1, 2, 3, 7, 20]), st.sampled_from([4, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_suffix_array_carries_common_prefixes(text, small, need, base):
    before, suffixes.BASE = suffixes.BASE, base
    try:
        with Scratch(500 if small else 1 << 24) as scratch:
            order, prefix = suffix_array(np.array(text, np.int64), scratch, need)
    finally:
        suffixes.BASE = before
    assert sorted(order.tolist()) == list(range(len(text)))
    deep = need or len(text)
    if need is None:
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        assert a[:deep] <= b[:deep] and prefix[k] == common(a, b, deep)


def test_a_shard_beyond_its_budget_is_sorted_with_spilled_queues():
    rng = random.Random(29)
    passage = [rng.randrange(1, 200) for _ in range(3000)]
    text = np.array([x for _ in range(40) for x in [*passage[rng.randrange(2500) :], *(rng.randrange(1, 200) for _ in range(700)), 0]], np.int16)
    before, suffixes.BASE = suffixes.BASE, 1 << 10
    suffixes.done.clear()
    try:
        with Scratch(64 << 10) as scratch:
            order, prefix = suffix_array(text, scratch, 100)
            assert scratch.used <= 64 << 10 and scratch.made > 10
    finally:
        suffixes.BASE = before
    assert suffixes.done["inductions"] >= 8 and suffixes.done["spilled"] > len(text) * 24
    data = text.astype(np.uint8).tobytes()
    for k in range(1, len(order), 7):
        a, b = data[order[k - 1] : order[k - 1] + 100], data[order[k] : order[k] + 100]
        assert a <= b and prefix[k] == common(a, b, 100)


def test_equal_windows_have_equal_keys():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(2000))
    data = np.frombuffer(data + data[300:900], np.uint8)
    first, last, key, single = window_runs(data, 30, 8)
    key_of = np.repeat(key, last - first + 1)
    by = defaultdict(set)
    for s, k in enumerate(key_of.tolist()):
        by[data[s : s + 30].tobytes()].add(k)
    assert all(len(v) == 1 for v in by.values())
    for a, b, alone in zip(first, last, single, strict=True):
        windows = [data[s : s + 30].tobytes() for s in range(a, b + 1)]
        assert not alone or len(set(windows)) == len(windows)


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(dict(rows).items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=40))
    rows = [(0, None), (1, ""), (2, "a" * 700), (3, passage), (4, passage), (5, "x" * 99), (6, ("ab" * 100) + passage[:150] + "q" + passage[20:])]
    for i in range(7, 60):
        text = " ".join(rng.choices(words, k=rng.randrange(2, 60)))
        rows.append((i, text + (passage[rng.randrange(50) :] if i % 3 else "") + (rows[-1][1] or "")[:400]))
    rows.append((60, "z" * 300_000))
    docs = frame(spark, rows).repartition(3)
    docs = docs.union(frame(spark, [(4, passage), (None, passage)]))  # a repeated row and a null id
    found = remove_repeats(docs, 100).collect()
    want = removed(rows, 100)
    assert len(found) == len(rows) + 2
    for r in found:
        own = (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
        assert own == (want[r.doc_id] if r.doc_id is not None else (len(passage.encode()), 0, 0, hashlib.sha256(passage.encode()).hexdigest()))
    assert remove_repeats(docs.limit(0), 100).count() == 0


def test_induction_sorts_the_registered_table():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    parts = []
    for doc, text in zip(*(c.to_pylist() for c in table.columns), strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        if len(data) >= 100:
            first, last, key, single = window_runs(data, 100, suffixdedup.GRAM)
            size = last - first + 100
            parts.append(suffixdedup.Runs(np.full(len(first), doc), first, size, key, single, data[ragged(first, size)]))
    suffixes.done.clear()
    doc, low, high = suffixdedup.repeated_in_shard(suffixdedup.Runs.join(parts), 100, 1 << 20)
    assert suffixes.done["inductions"] >= 4 and suffixes.done["spilled"] > 0
    want = removed(list(zip(*(c.to_pylist() for c in table.columns), strict=True)), 100)
    assert {i: int((high - low)[doc == i].sum()) for i in want} == {i: w[1] for i, w in want.items()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_against_brute_force(spark, block):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(3000)]
    rows, base = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "a b"), (5, "word " * 50_000)], []
    for i in range(6, 160):
        if base and rng.random() < 0.7:
            own = list(rng.choice(base[-4:]))
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.randrange(40, 120))
        base.append(own)
        rows.append((i, " ".join(own)))
    docs = frame(spark, rows)
    docs = docs.union(frame(spark, [rows[10], (None, rows[10][1])]))
    want = components(rows, 3, 85)
    found = near_duplicates(docs, 3, 85, block=block).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len({c for _, c in want.values()}) < 120
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_rows_that_repeat_an_id_link_by_their_own_text(spark, block):
    text = lambda k: [f"t{k}w{j}" for j in range(120)]
    change = lambda words: " ".join([*words[:60], "other", *words[61:]])
    a, b, c = text(1), text(2), text(3)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, change(a)), (3, change(b)), (7, " ".join(c)), (5, " ".join(b)), (None, " ".join(c)), (8, change(c)), (5, "")]
    rows += [(10 + k, change(a[:-1] + [f"end{k}"])) for k in range(20)]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), 3, 85, block=block).collect()), key=str)
    want = [(5, 118, 2, False), (5, 118, 3, False), (2, 118, 2, True), (3, 118, 3, True), (7, 118, 7, True), (5, 118, 3, False), (None, 118, None, True), (8, 118, 7, False), (5, 0, 5, True)]
    want += [(10 + k, 118, 2, False) for k in range(20)]
    assert found == sorted(want, key=str)


def test_links_survive_buckets_led_by_unlike_documents(spark):
    rng = random.Random(11)
    base = ["b%d" % i for i in range(60)]
    rows = [(i, " ".join([*base, *("u%d_%d" % (i, k) for k in range(38))])) for i in range(120)]  # all share 58 of 96 shingles
    for i in range(100, 120):
        own = rows[i][1].split()
        own[rng.randrange(80, 98)] = "x%d" % i
        rows.append((i + 100, " ".join(own)))
    found = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert found == {i: c for i, (_, c) in components(rows, 3, 85).items()} and len(set(found.values())) == 120
    small = near_duplicates(frame(spark, rows), 3, 85, coarse=0.8, rounds=1, block=16)  # most edges come from the last step
    assert {r.doc_id: r.component_id for r in small.collect()} == found


def test_signatures_estimate_similarity():
    m = MinHash(40, 5)
    a, b = shingles(b" ".join(b"%d" % i for i in range(1000))), shingles(b" ".join(b"%d" % i for i in range(100, 1000)))
    same = (m.signature(a) == m.signature(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1
    assert links_within([a, a, b], 85) == [(0, 1), (0, 2)] and minhash.shingles(b"").size == 0


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=200, deadline=None)
def test_patience_blocks_are_common_and_in_order(a, b):
    i0 = j0 = 0
    for i, j, n in patience_blocks(a, b):
        assert a[i : i + n] == b[j : j + n] and i >= i0 and j >= j0 and n
        i0, j0 = i + n, j + n
    if a == b:
        assert sum(n for *_, n in patience_blocks(a, b)) == len(a)


def standing_in(earlier, own, sizes, least=60):
    """Every run of lines of both documents, longest first from each pair of starts, without any alignment."""
    gone = set()
    for i in range(len(earlier)):
        for j in range(len(own)):
            n = 0
            while i + n < len(earlier) and j + n < len(own) and earlier[i + n] == own[j + n]:
                n += 1
            if sum(sizes[j : j + n]) >= least:
                gone |= set(range(j, j + n))
    return gone


def lines_to_lose(rows):
    """The lines that each row loses to rows with smaller ids, every pair looked at."""
    lines = [(t or "").split("\n") for _, t in rows]
    out = []
    for (i, _), own in zip(rows, lines, strict=True):
        sizes = [len(x.strip(" ")) for x in own]
        out.append(set().union(*(standing_in(e, own, sizes) for (f, _), e in zip(rows, lines, strict=True) if i is not None and f is not None and f < i)))
    return out


def cut_by_hand(rows):
    """(id, text, n_lines, n_removed) of all rows, by the brute-force rule."""
    out = []
    for (i, text), gone in zip(rows, lines_to_lose(rows), strict=True):
        own = [] if text is None else text.split("\n")
        out.append((i, text if not gone else "\n".join(x for k, x in enumerate(own) if k not in gone), len(own), len(gone)))
    return sorted(out, key=str)


def cut_rows(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20), st.integers(1, 120))
@settings(max_examples=500, deadline=None)
def test_alignment_finds_every_common_run(a, b, least):
    sizes = [(0, 5, 17, 40, 70)[x] for x in b]
    want = standing_in(a, b, sizes, least)
    assert repeated_lines(a, b, sizes, least) == sorted(want)
    assert common_runs(a, b, sizes, least) == sorted(want)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    pool = [f"line {i} " + "word " * rng.randrange(1, 12) for i in range(80)]
    rows = [(0, None), (1, ""), (2, "short\n\nshort"), (3, "only\n" + pool[0])]
    rows += [(i, "\n".join([*rng.choices(pool, k=rng.randrange(1, 5)), *pool[5 * (i % 9) :][: rng.randrange(2, 6)]])) for i in range(4, 60)] + [(70, rows[3][1]), (71, "x" * 100_000), (72, "x" * 100_000)]
    rows += [(None, rows[3][1]), rows[3], (None, None)]
    found = cut_rows(line_dedup(frame(spark, rows)))
    assert found == cut_by_hand(rows) and sum(r[3] for r in found) > 20
    assert line_dedup(frame(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    shared, unique, more = "s" * 70, "u" * 70, "m" * 70
    rows = [(1, shared), (2, f"{shared}\ntail"), (2, f"{unique}\nsecond"), (2, f"{shared}\ntail"), (3, f"{more}\n{unique}"), (3, shared), (4, more)]
    found = cut_rows(line_dedup(frame(spark, rows)))
    assert found == cut_by_hand(rows)
    assert [r[1] for r in found if r[0] == 2] == ["tail", "tail", f"{unique}\nsecond"]


@pytest.mark.parametrize("rare", [0, 3, 10_000])
def test_a_line_repeated_in_many_documents_goes_with_few_pairs(spark, monkeypatch, rare):
    line = "notice " * 13
    own = lambda i, k: f"{i} {k} own words"
    rows = [(i, "\n".join([own(i, 0), line, own(i, 1), line, own(i, 2)])) for i in range(240)]
    pairs, plain = [], linededup.aligned

    def counted(found, *rest):
        pairs.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(linededup, "aligned", counted)
    monkeypatch.setattr(linededup, "RARE", rare)
    assert removed_lines(spark, rows) == {i: 2 if i else 0 for i in range(240)}
    assert sum(pairs) == 239


def test_moved_blocks_go(spark):
    blocks = [f"block {k} " + "b" * 60 for k in range(12)]
    rows = [(1, "\n".join(blocks)), (2, "\n".join(reversed(blocks))), (3, "\n".join(blocks[6:] + ["new"] + blocks[:6] + blocks[3:5]))]
    assert removed_lines(spark, rows) == {1: 0, 2: 12, 3: 14}


def removed_lines(spark, rows):
    return {r.doc_id: r.n_removed for r in line_dedup(frame(spark, rows)).collect()}


def test_blocks_of_short_or_repeated_lines_go(spark):
    p, q = "p" * 40, "q" * 40
    assert removed_lines(spark, [(1, p), (2, q), (3, f"{p}\n{q}"), (4, f"{p}\n{q}")]) == {1: 0, 2: 0, 3: 0, 4: 2}
    again = "\n".join(["r" * 30] * 5)
    assert removed_lines(spark, [(1, again), (2, again), (3, again + "\nend")]) == {1: 0, 2: 5, 3: 5}


def test_line_dedup_keeps_columns_with_the_names_of_its_helpers(spark):
    rows = [(1, "x" * 70, "a", "b", 1), (2, "x" * 70, "c", "d", 2)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, drop string, DROPPED_ID string, n_lines int")).orderBy("doc_id")
    assert [tuple(r) for r in out.collect()] == [(1, "x" * 70, "a", "b", 1, 0), (2, "", "c", "d", 1, 1)]


@pytest.mark.parametrize("rare", [0, 2, 64])
def test_line_dedup_looks_at_all_earlier_documents(spark, monkeypatch, rare):
    rng = random.Random(17)
    pool = [f"l{i} " + "w" * rng.randrange(1, 80) for i in range(25)] + ["", " "]
    rows = [(0, None), (1, "")] + [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(2, 250)]
    rows += [(i, rows[rng.randrange(250)][1]) for i in range(200, 270)]
    monkeypatch.setattr(linededup, "RARE", rare)
    found = cut_rows(line_dedup(frame(spark, rows).repartition(4)))
    assert found == cut_by_hand(rows) and sum(r[3] for r in found) > 200


def test_registered_line_dedup_equals_its_sql(spark):
    from galleon.llm.queries import op9_line_dedup, oracle_sql

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(oracle_sql()["op9_line_dedup"]).fetchall()
    names = [c[0] for c in con.description]
    found = op9_line_dedup(spark, "/root/testdata/sf0.01")
    assert found.columns == names and sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(r[2] for r in want) > 50


def test_lines_in_most_documents_go_at_every_size(spark):
    line = "licence " * 10
    few = [(i, line) for i in range(3)] + [(3, "other"), (4, "text")]
    more = few + [(i, f"own {i}") for i in range(5, 21)]
    footer = [(i, f"own {i}\n{line}") for i in range(20)] + [(i, f"none {i}") for i in range(20, 30)]
    for rows in (few, more):
        assert [i for i, n in removed_lines(spark, rows).items() if n] == [1, 2]
    assert sorted(i for i, n in removed_lines(spark, footer).items() if n) == list(range(1, 20))


def test_windows_of_one_minimizer_are_spread_over_shards(spark, monkeypatch):
    rng = random.Random(23)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = own(130)
    rows = [(i, own(150) + passage + own(150)) for i in range(300)]
    rows += [(300 + i, rows[i][1][100:350] + own(60)) for i in range(0, 300, 7)]
    docs = frame(spark, rows).selectExpr("doc_id AS doc", "encode(text, 'UTF-8') AS bytes")
    loads, plain = [], suffixdedup._routed

    def watched(*args):
        routed = plain(*args).cache()
        loads.append(Counter())
        for r in routed.where("runs IS NOT NULL").collect():
            loads[-1][r.shard] += len(suffixdedup.Runs.unpack(bytes(r.runs)).data)
        return routed

    monkeypatch.setattr(suffixdedup, "_routed", watched)
    found = defaultdict(set)
    for r in suffixdedup.repeated_spans(docs, 100, shard_bytes=40_000).collect():
        found[r.doc].update(range(r.low, r.high))
    want = removed(rows, 100)
    assert {i: len(found[i]) for i, _ in rows} == {i: w[1] for i, w in want.items()}
    assert max(loads[0].values()) < 40_000 * 1.5


def shard_of(rows, length=100):
    parts = []
    for doc, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        first, last, key, single = window_runs(data, length, suffixdedup.GRAM)
        size = last - first + length
        parts.append(suffixdedup.Runs(np.full(len(first), doc), first, size, key, single, data[ragged(first, size)]))
    return suffixdedup.Runs.join(parts)


def test_runs_that_share_their_minimizer_alone_are_not_sorted(monkeypatch):
    rng = random.Random(31)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = [own(50) for _ in range(30)], own(130)
    rows = [(i, "".join(own(60) + p for p in short) + own(60) + (long if i < 2 else "") + own(60)) for i in range(40)]
    lengths, plain = [], suffixdedup.suffix_array
    monkeypatch.setattr(suffixdedup, "suffix_array", lambda text, *more: lengths.append(len(text)) or plain(text, *more))
    doc, low, high = suffixdedup.repeated_in_shard(shard_of(rows), 100, 1 << 24)
    assert {i: int((high - low)[doc == i].sum()) for i, _ in rows} == {i: w[1] for i, w in removed(rows, 100).items()}
    assert int((high - low).sum()) >= 130 and sum(lengths) < 4000  # shared minimizers alone make over 100,000 bytes


@pytest.mark.parametrize("letters", ["ab", "abcdefgh "])
def test_passages_about_as_long_as_a_window_are_found(letters):
    rng = random.Random(37)
    own = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [own(n) for n in range(90, 125) for _ in range(6)] + ["xy" * 55, "x" * 104]
    rows = [(i, "".join(own(rng.randrange(0, 120)) + p for p in rng.sample(passages, len(passages)))) for i in range(3)]
    doc, low, high = suffixdedup.repeated_in_shard(shard_of(rows), 100, 1 << 24)
    assert {i: int((high - low)[doc == i].sum()) for i, _ in rows} == {i: w[1] for i, w in removed(rows, 100).items()}


def test_no_shuffle_of_the_search_is_left_when_its_spans_are_stored(spark, monkeypatch):
    left, plain = [], suffixdedup.stored

    def watched(df, name, **more):
        before = set(shuffles())
        out = plain(df, name, **more)
        left.append(set(shuffles()) - before)
        return out

    def shuffles():
        local = spark.conf.get("spark.local.dir", tempfile.gettempdir())
        return glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data")

    monkeypatch.setattr(suffixdedup, "stored", watched)
    rng = random.Random(41)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(400))) for i in range(20)]
    assert remove_repeats(frame(spark, [*rows, (20, rows[3][1])]), 100).where("n_removed > 0").count() == 1
    assert left == [set()] and shuffles() and spark.conf.get(RELEASE) == "false"
