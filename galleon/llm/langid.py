"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import crc_fold, small_batches, worker_store
from galleon.llm.vocabulary import WORD_START, default_vocabulary, pieces

#: Runs of letters with the marks on them, whole whatever their length. Numerals such as ² or ½ are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Words whose scores a worker keeps, and their numbers (one for each language); the store is emptied when full.
WORD_STORE, STORE_CELLS = 300_000, 1 << 21
#: Steps after which sums are scaled, so that they stay far above the smallest double.
SCALE = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class PieceIndex:
    """Finds which substrings of a batch of words are vocabulary pieces. Id ``size`` stands for a character without a piece."""

    def __init__(self, path: str):
        known = {p: i for i, p in enumerate(pieces(path)) if p and set(p) != {WORD_START} or p == WORD_START}
        self.size = len(pieces(path))
        self.longest = max(map(len, known))
        hashes = np.zeros(len(known), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(known):
                h = np.uint64(len(p))
                for c in p:
                    h = h * _BASE + np.uint64(ord(c))
                hashes[k] = h
            hashes = _mixed(hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(known.values()), np.int32)[order]

    def spans(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each piece length, the ids (or -1) of the spans that start at each place of (words, places)."""
        words, n = chars.shape
        codes = chars.astype(np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            h = np.full((words, n - length + 1), length, np.uint64)
            for k in range(length):
                h = h * _BASE + codes[:, k : n - length + 1 + k]
            h = _mixed(h)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.ids[at], -1)
            if length == 1:
                ids[ids < 0] = self.size
            yield length, ids


def _by_length(words: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points) of the words of each length, with the word mark before them; ``width`` numbers a row bound a batch."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        most = max(1, min(10_000, 250_000 // (n + 1), STORE_CELLS // (width * SCALE)))
        for part in np.array_split(rows, -(-len(rows) // most)):
            text = "".join(WORD_START + words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n + 1)


def forward(index: PieceIndex, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log probability of each word under each column of ``prob`` (pieces x languages), all segmentations summed.

    Only the sums of as many places as the longest piece has are held. They are
    scaled every few places, so a word of any length is summed as a whole.
    """
    out = np.zeros((len(words), prob.shape[1]))
    for rows, chars in _by_length(words, prob.shape[1]):
        n = chars.shape[1]
        spans = list(index.spans(chars))
        ring = len(spans) + 1
        alpha, scale = np.zeros((ring, len(rows), prob.shape[1])), 0.0
        alpha[0] = 1
        for end in range(1, n + 1):
            now = np.zeros(alpha.shape[1:])
            for length, ids in spans[:end]:
                own = ids[:, end - length]
                hit = np.flatnonzero(own >= 0)
                now[hit] += alpha[(end - length) % ring, hit] * prob[own[hit]]
            alpha[end % ring] = now
            if end % SCALE == 0 and end < n:
                top = alpha.max(0)
                alpha /= top
                scale = scale + np.log(top)
        out[rows] = np.log(alpha[n % ring]) + scale
    return out


def _scaled_sums(spans: list[tuple[int, np.ndarray]], n: int, words: int, prob: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations before (``back``: after) each place, and the logs of their scales."""
    sums, scales = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    place = (lambda k: n - k) if back else (lambda k: k)
    sums[place(0)] = 1
    for k in range(1, n + 1):
        near = range(max(0, k - len(spans)), k)
        if k % SCALE == 1 and k > 1:  # what the next places are summed from gets one new scale
            at = [place(i) for i in near]
            top = sums[at].max(0)
            held, offset = sums[at] / top, scales[at[-1]] + np.log(top)
        elif k == 1:
            held, offset = sums[[place(0)]], scales[place(0)]
        now = np.zeros(words)
        for length, ids in spans[:k]:
            own = ids[:, n - k if back else k - length]
            now += np.where(own >= 0, held[len(held) - length] * prob[own], 0)
        sums[place(k)], scales[place(k)] = now, offset
        held = np.concatenate([held, now[None]])[-len(spans) :]
    return sums, scales


def expected_counts(index: PieceIndex, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words seen ``counts`` times, under one column of probabilities."""
    out = np.zeros(len(prob))
    for rows, chars in _by_length(words, 1):
        n, w = chars.shape[1], len(rows)
        spans = list(index.spans(chars))
        (alpha, up), (beta, down) = (_scaled_sums(spans, n, w, prob, back) for back in (False, True))
        share = counts[rows] / alpha[n]
        for length, ids in spans:
            for start in range(n - length + 1):
                own = ids[:, start]
                hit = np.flatnonzero(own >= 0)
                mass = alpha[start, hit] * prob[own[hit]] * beta[start + length, hit] * share[hit]
                if n > SCALE:
                    mass = mass * np.exp(up[start, hit] + down[start + length, hit] - up[n, hit])
                out += np.bincount(own[hit], mass, len(prob))
    return out


class LanguageModel:
    """Piece probabilities for each language, and the languages' own shares."""

    def __init__(self, path: str, languages: list[str], prob: np.ndarray, prior: np.ndarray):
        self.path, self.languages, self.prob, self.prior = path, languages, prob, prior


_indexes: dict[str, PieceIndex] = {}


def _index(path: str) -> PieceIndex:
    if path not in _indexes:
        _indexes[path] = PieceIndex(path)
    return _indexes[path]


def fit(train: DataFrame, vocabulary: str | None = None, text_col: str = "text", lang_col: str = "lang", rounds: int = 2, smoothing: float = 0.1) -> LanguageModel:
    """Expectation-maximisation for each language over the rows given.

    Each round, tasks turn their texts into expected piece counts by language,
    Spark adds those up, and the sums, at most one number for each pair of
    language and piece, come to the driver. Rows with a null text or language
    are left out. Without any row the model knows no language.
    """
    small_batches(train.sparkSession)
    path = vocabulary or default_vocabulary()
    size = len(pieces(path)) + 1
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    # Before any count: by rank, as frequencies of words in text fall with their rank.
    start = 1 / np.arange(2, size + 2)
    prob: dict[str, np.ndarray] = {}
    prior: dict[str, float] = {}
    for _ in range(rounds):
        known = dict(prob)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, words, docs = _index(path), {}, Counter()
            total: dict[str, np.ndarray] = {}

            def add() -> None:
                for lang, seen in words.items():
                    total[lang] = total.get(lang, 0) + expected_counts(index, list(seen), np.fromiter(seen.values(), float, len(seen)), known.get(lang, start / start.sum()))
                words.clear()

            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                    docs[lang] += 1
                if sum(map(len, words.values())) > WORD_STORE:
                    add()
            add()
            for lang, sums in total.items():
                hit = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(hit) + 1)), pa.array([*hit, -1], pa.int32()), pa.array([*sums[hit], docs[lang]], pa.float64())], ["lang", "piece", "n"])

        sums: dict[str, np.ndarray] = {}
        for r in rows.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            sums.setdefault(r.lang, np.zeros(size + 1))[r.piece] = r.n  # the number of documents stands last
        prob = {lang: (s[:size] + smoothing) / (s[:size] + smoothing).sum() for lang, s in sums.items()}
        prior = {lang: s[-1] for lang, s in sums.items()}
    languages = sorted(prob)
    shares = np.array([prior[x] for x in languages])
    return LanguageModel(path, languages, np.stack([prob[x] for x in languages], 1) if languages else np.zeros((size, 0)), shares / max(1, shares.sum()))


#: Equally likely letters that a language is held against.
LETTERS = 32


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", with_gain: bool = False) -> DataFrame:
    """Add (lang_pred, score): the likeliest language and its posterior probability.

    The posterior says which of the learned languages fits best, not whether any of
    them fits. ``with_gain`` adds gain: the log likelihood of the letters in the best
    language, less that of drawing each from ``LETTERS`` equally likely ones; it is 0
    where nothing is predicted.

    A null text or one without a letter is ``und`` with score 0, as is every text
    if the model knows no language. All of a text counts, however long. Ties go
    to the language that sorts first. The rows keep their other columns, except
    ones with the names of those added, which are replaced; null ids and repeated
    rows are rows like others, and an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    added = ["lang_pred", "score", *(["gain"] if with_gain else [])]
    names = [c for c in docs.columns if c not in added]
    key = f"{hash(model.prob.tobytes())}"
    shared = docs.sparkSession.sparkContext.broadcast((model.path, model.languages, model.prob, np.log(np.maximum(model.prior, 1e-12))))
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add("gain", "double") if with_gain else schema
    at = names.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, languages, prob, prior = shared.value
        index = _index(path)
        most = max(1000, min(WORD_STORE, STORE_CELLS // max(1, len(languages))))
        store = worker_store(f"languages-{key}")
        if not store:
            store.update(rows={}, table=np.zeros((most, len(languages))))
        rows, table = store["rows"], store["table"]

        def sums(lists: list[list[str]]) -> list[np.ndarray]:
            """Log likelihoods of word lists; the words that are new to the worker are scored together."""
            new = set().union(*lists).difference(rows)
            if len(rows) + len(new) > most:
                rows.clear()
                new = set().union(*lists)
            if new:
                new = list(new)
                table[len(rows) : len(rows) + len(new)] = forward(index, new, prob)
                rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            return [table[np.fromiter(map(rows.__getitem__, w), np.int64, len(w))].sum(0) for w in lists]

        for batch in batches:
            found, sure, gain, waiting = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [0.0] * batch.num_rows, []
            total = {}

            def settle(waiting=waiting, total=total) -> None:
                for (row, _), s in zip(waiting, sums([w for _, w in waiting]), strict=True):
                    total[row] = total.get(row, prior) + s
                waiting.clear()

            held = 0
            for row, text in enumerate(batch.column(at)):
                words = WORD.findall((text.as_py() or "").lower()) if languages else []
                gain[row] = sum(map(len, words)) * float(np.log(LETTERS))
                for k in range(0, len(words), most // 4):
                    part = words[k : k + most // 4]
                    waiting.append((row, part))
                    held += len(part)
                    if held > most // 2:
                        settle()
                        held = 0
            settle()
            for row, t in total.items():
                best = int(t.argmax())
                found[row], sure[row] = languages[best], float(1 / np.exp(t - t[best]).sum())
                gain[row] += float((t - prior)[best])
            results = [pa.array(found, pa.string()), pa.array(sure, pa.float64()), pa.array(gain, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *results[: len(added)]], [*names, *added])

    return docs.select(*names).mapInArrow(score, schema)


def training_rows(docs: DataFrame, learn: Column, bound: int, id_col: str = "doc_id") -> DataFrame:
    """The rows that ``learn`` marks, thinned by a hash of the id to about ``bound``."""
    every = max(1, -(-docs.where(learn).count() // bound))
    return docs.where(learn & (F.pmod(F.xxhash64(id_col), F.lit(every)) == 0))


def identify(docs: DataFrame, vocabulary: str | None = None, fit_rows: int = 10_000, id_col: str = "doc_id") -> DataFrame:
    """Learn from rows outside the held-out fold, then predict every row.

    The model is fitted on at most about ``fit_rows`` rows with a language, from
    folds of crc32(id) mod 4 other than 2; every row is then scored in whole.
    Returns (id, text, held_out, lang_pred, score), a row for each input row: a
    null id counts as the text ``null`` in the fold, a null, empty or letterless
    text is ``und`` with score 0, repeated rows get equal results, and an empty
    table gives no row. Input columns of other names are left out.
    """
    train = training_rows(docs, (crc_fold(id_col, 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull(), fit_rows, id_col)
    model = fit(train.select("text", "lang"), vocabulary)
    return predict(docs.select(id_col, "text").withColumn("held_out", crc_fold(id_col, 4) == 2), model)
