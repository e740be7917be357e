import re
import zlib

import numpy as np
import pytest

from galleon.llm import decontamination, langid, quality, tokencount
from galleon.llm.vocabulary import WORD_START, default_vocabulary, pieces


def test_forward_sums_all_segmentations():
    index = langid.PieceIndex(default_vocabulary())
    known = {p: i for i, p in enumerate(pieces(default_vocabulary())) if p}
    prob = np.random.default_rng(0).random((index.size + 1, 2)) / 1000

    def total(text, lang):
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, len(text) + 1):
            i = known.get(text[:n], index.size if n == 1 else None)
            if i is not None:
                out += prob[i, lang] * total(text[n:], lang)
        return out

    words = ["the", "house", "ж", "ﷺq", "straße"]
    got = langid.forward(index, words, prob)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [np.log(total(WORD_START + w, k)) for k in (0, 1)])
    counts = langid.expected_counts(index, words[:2], np.array([2.0, 1.0]), prob[:, 0])
    assert counts.sum() > 3 and counts.min() >= 0


def test_long_words_are_summed_as_a_whole():
    """Against sums in logarithms, position by position."""
    index = langid.PieceIndex(default_vocabulary())
    known = {p: i for i, p in enumerate(pieces(default_vocabulary())) if p}
    prob = np.random.default_rng(0).random((index.size + 1, 2)) / 10_000

    def sums(text, lang, back):
        out = {len(text) if back else 0: 0.0}
        for at in range(len(text) - 1, -1, -1) if back else range(1, len(text) + 1):
            spans = [(at, e) for e in range(at + 1, min(len(text), at + index.longest) + 1)] if back else [(b, at) for b in range(max(0, at - index.longest), at)]
            parts = [out[e if back else b] + np.log(prob[i, lang]) for b, e in spans if (i := known.get(text[b:e], index.size if e - b == 1 else None)) is not None]
            out[at] = np.logaddexp.reduce(parts)
        return out

    words = ["the" * 334, "x" * 17, "жq" * 40]
    got = langid.forward(index, words, prob)
    for w, row in zip(words, got, strict=True):
        text = WORD_START + w
        assert np.allclose(row, [sums(text, k, False)[len(text)] for k in (0, 1)])
        up, down = sums(text, 0, False), sums(text, 0, True)
        want = np.zeros(len(prob))
        for b in range(len(text)):
            for e in range(b + 1, min(len(text), b + index.longest) + 1):
                i = known.get(text[b:e], index.size if e - b == 1 else None)
                if i is not None:
                    want[i] += 3 * np.exp(up[b] + np.log(prob[i, 0]) + down[e] - up[len(text)])
        assert np.allclose(langid.expected_counts(index, [w], np.array([3.0]), prob[:, 0]), want)


def test_held_out_accuracy_on_the_registered_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND text IS NOT NULL").collect()
    assert len(found) > 200 and np.mean([r.lang_pred == r.lang for r in found]) >= 0.98


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_id(spark):
    en, de = "the cat and the dog with that house of", "der hund und die katze mit dem haus von"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else de).split())), "en" if i % 2 else "de", "x", 0.5) for i in range(60)]
    rows += [(100, None, "en", "x", 0.0), (101, "", None, "x", 0.0), (102, "123 ... !!", None, "x", 0.0), (103, "the " * 30_000, None, "x", 0.0), (104, "²", None, "x", 0.0), (105, "½ ① ³ Ⅷ", None, "x", 0.0), (106, "dog" * 400, None, "x", 0.0), (None, "the dog and the cat", None, "x", 0.0), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0.5 < r.score <= 1
            assert r.held_out == (fold(r.doc_id, 4) == 2)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104, 105, None)] == ["und", "und", "und", "en", "und", "und", "en"]
    assert by[106].lang_pred in ("en", "de") and [by[i].score for i in (100, 104, 105)] == [0, 0, 0]
    none = langid.identify(docs.limit(0))
    assert none.count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def best_split(word, scores):
    """Plain Viterbi over the marked word: (log probability, tokens, pieces)."""
    text, longest, worst = WORD_START + word, max(map(len, scores)), min(scores.values())
    best = [(0.0, 0, 0, None)] + [(-np.inf, 0, 0, None)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            s, n = scores.get(piece), 1
            if s is None and len(piece) == 1:
                n = len(piece.encode())
                s = worst * n
            if s is not None:
                score, count = best[start][0] + s, best[start][1] + n
                if score > best[end][0] or (score == best[end][0] and count < best[end][1]):
                    best[end] = (score, count, start, piece if piece in scores else None)
    found, end = [], len(text)
    while end:
        found += [best[end][3]] * (best[end][3] is not None)
        end = best[end][2]
    return best[-1][0], best[-1][1], found


def by_piece(scores):
    return {p: s for p, s in zip(pieces(default_vocabulary()), scores, strict=True) if p}


TEXTS = ["the cathedral's naïve ﷺ", "", None, "abc " * 5000, "y" * 3000, "the cat\tthe catalogue", "\u2003ﷺﷺ\u00a0the ", "ж" * 200 + " don't!!! " + "catalogue" * 60]


@pytest.mark.parametrize("fitted", [False, True])
def test_token_counts_against_plain_viterbi(spark, monkeypatch, fitted):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "the", 1, 2), (0, TEXTS[0], 1, 2)], "doc_id long, text string, n_words long, n_tokens long")
    scores = tokencount.fit_scores(docs) if fitted else tokencount.rank_scores(default_vocabulary())
    found = tokencount.token_counts(docs, scores=None if fitted else scores).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = "the" if r.doc_id is None else TEXTS[r.doc_id] or ""
        each = {w: best_split(w, by_piece(scores)) for w in set(text.split())}
        want = [each[w] for w in text.split()]
        assert (r.n_words, r.n_tokens) == (len(want), sum(n for _, n, _ in want)) and np.isclose(r.log_prob, sum(s for s, _, _ in want), rtol=1e-9)
    counter = tokencount.TokenCounter(default_vocabulary(), scores)
    whole = counter.of(["the cathedral cat", "", "cat"])
    monkeypatch.setattr(tokencount, "STORE", 1)
    assert counter.of(["catalogue of the"]) and [x.tolist() for x in counter.of(["the cathedral cat", "", "cat"])] == [x.tolist() for x in whole]
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_piece_scores_are_frequencies_over_all_texts(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(tokencount, "STORE", 3)
    ranked = by_piece(tokencount.rank_scores(default_vocabulary()))
    want = Counter(p for t in TEXTS for w in (t or "").split() for p in best_split(w, ranked)[2])
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = by_piece(tokencount.fit_scores(docs))
    total = sum(want.values()) + 0.1 * len(found)
    assert all(np.isclose(np.exp(s), (want[p] + 0.1) / total) for p, s in found.items())
    assert len({round(s, 9) for s in by_piece(tokencount.fit_scores(docs.limit(0))).values()}) == 1


def test_quality_learns_from_positives_and_unlabelled_text(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(words) + "." if i % 5 else " ".join(w + "!!" for w in words).upper(), "x", 0.1))
    rows += [(900, None, "x", 0.0), (901, "", "x", 0.0), (902, "ok " * 50_000, "x", 0.0), (None, "some words", "x", 0.0), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 500, 2)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in found if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 5 > 0) for r in held]) > 0.95
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def auc(good, bad):
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_held_out_quality_on_the_registered_table(spark):
    """Labels of the held-out fold are read by the test alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert len(good) > 500 and len(bad) > 80 and auc(good, bad) >= 0.97
    assert np.mean([s >= 0.3 for s in good]) >= 0.97 and np.mean([s < 0.3 for s in bad]) >= 0.8


@pytest.mark.parametrize("share", [0.3, 0.85])
def test_prior_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(5)
    draw = lambda n, shift: rng.normal(shift, 1, (n, 6))
    n = int(4000 * share)
    found = quality.estimate_prior(draw(1500, 2), np.concatenate([draw(n, 2), draw(4000 - n, -2)]))
    assert abs(found - share) < 0.06 and quality.estimate_prior(draw(0, 0), draw(9, 0)) == 0.5


def test_negative_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, ("plain words here " if i % 3 else "## $$ ") * (i % 7 + 1)) for i in range(120)], "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(120)]
    both, trusted = (quality.classify(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect() for rows in (labels, [r for r in labels if r[1]]))
    assert sorted(both) == sorted(trusted)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items, length):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + length]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_decontamination_against_brute_force(spark, broadcast_bytes):
    import hashlib

    rng = np.random.default_rng(6)
    vocabulary = ["the", "of", "École", "école", "naïve", "x1", *(f"w{k}" for k in range(20))]
    items = [(k, " ".join(rng.choice(vocabulary, 12))) for k in range(8)] + [(8, "short item"), (9, ""), (None, "the of the of the"), (11, None), (12, "Absent words here"), (13, "the the the the the the the the the the the")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "SHORT--item, short item"), (4, "the " * 30_000)]
    for k in range(5, 40):
        item = items[rng.integers(8)][1].split()
        docs.append((k, " ".join([*rng.choice(vocabulary, 20), *item[: rng.integers(8, 13)], *rng.choice(vocabulary, 5), *item]).upper() if k % 2 else " ".join(rng.choice(vocabulary, 60))))
    docs += [(None, items[0][1])]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, word string, start int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    found = decontamination.contamination(frame, bench, 10, broadcast_bytes=broadcast_bytes).collect()
    want = contaminated([d for d in docs if d[0] != 4], items, 10)
    assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in found if r.doc_id != 4), key=str) == sorted(((i, n, h) for i, n, h, _ in want), key=str)
    by = {i: names for i, _, _, names in want}
    for r in found:
        if r.doc_id != 4:
            assert r.items_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest() and r.n_items == len([x for x in by[r.doc_id].split(",") if x]) and r.contaminated == (r.n_hit > 0)
        else:
            assert (r.n_words, r.n_hit, r.n_items) == (30_000, 30_000, 1)
    same = spark.createDataFrame([(None, "clean words"), (None, items[0][1]), (7, "clean"), (7, items[1][1])], "doc_id long, text string")
    own = [(r.n_words, r.n_hit) for r in decontamination.contamination(same, bench, 10, broadcast_bytes=broadcast_bytes).collect()]
    assert sorted(own) == [(1, 0), (2, 0), (12, 12), (12, 12)]
    assert decontamination.contamination(frame.limit(0), bench, 10).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(frame, bench.limit(0), 10).collect())
