"""The source audit, against its definition in plain Python and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from galleon.llm import divergence
from galleon.llm.divergence import source_divergence, terms

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, term int, n string, docs string, part int, rank string, v string, shard string"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, 1, "n", "d", 2, "r", "v", "s") for k, (t, lang, s) in enumerate(rows)], SCHEMA)


def plain_terms(text):
    return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, least=10, most=10):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = plain_terms(text)
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        own = {s: c for (g, s), c in count.items() if g == lang}
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        every = sum(own.values(), Counter())

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        rate, q = {s: p(c) for s, c in own.items()}, p(every)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(sum(f(rate[s][t], rate[o][t]) for t in kept), o) for o in own if o != s]
            mine = [(f(rate[s][t], q[t]), t) for t in kept if own[s][t] and rate[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", mine, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:last], 1)]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@given(st.text(alphabet="aZé中 .0@[`{\x7f\x00\n İ", max_size=40))
def test_terms_by_their_definition(text):
    assert [t.decode() for t in terms(text.encode()) if t] == plain_terms(text)


def sample():
    words = ["alpha", "beta", "Gamma", "délta", "中文", "x", "tail", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"]
    rows = []
    for k in range(120):
        text = " ".join(words[(k * j + j * j) % (len(words) - k % 3)] for j in range(1, 2 + k % 17))
        rows.append((text, ("en", "de", None)[k % 3 if k % 7 else 0], ("s1", "s2", None, "é", "Z")[k % 5]))
    return rows + rows[:9]  # repeated rows are documents of their own


@pytest.mark.parametrize("dense", [1, 40, 400_000])
def test_against_the_definition(spark, monkeypatch, dense):
    monkeypatch.setattr(divergence, "DENSE", dense)
    rows = sample()
    assert result(source_divergence(frame(spark, rows))) == plain(rows)
    assert result(source_divergence(frame(spark, rows), least=2, most=3)) == plain(rows, 2, 3)


def test_edge_cases(spark):
    rows = sample() + [("", "en", "empty"), (None, "en", "null"), ("12 34 --", "fr", "a"), (None, "fr", "b"), ("rare words", "fr", ""), ("alone " * 20, "it", "only"), ("long " * 60_000 + "w" * 300_000, "en", "s1")]
    assert result(source_divergence(frame(spark, rows))) == plain(rows)
    none = source_divergence(frame(spark, []))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0
    tied = [("same words here", "en", s) for s in ("b", "a", "c") for _ in range(10)]
    assert [(r.source, r.item, r.value) for r in source_divergence(frame(spark, tied)).orderBy("source", "rank").collect()] == [("a", "b", 0), ("a", "c", 0), ("b", "a", 0), ("b", "c", 0), ("c", "a", 0), ("c", "b", 0)]


def test_counts_are_handed_on_in_parts(spark):
    rows = sample()
    docs = frame(spark, rows).coalesce(1)
    counts = divergence.term_counts(docs.fillna("", ["lang", "source"]), 1).groupBy("lang", "source", "term").sum("n").collect()
    want = Counter()
    for t, lang, s in rows:
        want.update((lang or "", s or "", w) for w in plain_terms(t))
    assert {(r[0], r[1], r[2]): r[3] for r in counts} == want


def test_registered_query_equals_its_sql(spark):
    from galleon.llm.queries import op13_divergence, oracle_sql

    found = result(op13_divergence(spark, SF))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = con.execute(oracle_sql()["op13_divergence"])
    assert [d[0] for d in got.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(got.fetchall()) == found and {r[2] for r in found} == {"pair", "term"}
    assert found == plain(con.execute("select text, lang, source from documents").fetchall())
