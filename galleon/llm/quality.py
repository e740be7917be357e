"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import crc_fold, small_batches, text_or_empty

STYLE = ["log_words", "word_length", "distinct_words", "top_word", "repeats", "symbols", "upper", "digits", "punctuation", "spaces", "line_words", "log_lines", "repeated_lines", "top_byte", "entropy"]
_SYMBOLS = np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:?'\"()-", np.uint8)
#: Buckets that the byte trigrams of a text are hashed into, and features in all.
GRAMS = 256
WIDTH = len(STYLE) + GRAMS
#: The trigrams together weigh half as much as the style features. Of 0.5, 1 and 2 times, and rates of 0.01, 0.02
#: and 0.04, this weight and the rate of ``fit_pu`` did best on one training fold (crc32 mod 5 = 1) after fitting on the others.
WEIGHTS = np.concatenate([np.ones(len(STYLE)), np.full(GRAMS, 0.5 * math.sqrt(len(STYLE) / GRAMS))])


def trigram_shares(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the hashed byte trigrams; A-Z count as a-z."""
    if len(data) < 3:
        return np.zeros(GRAMS, np.float32)
    b = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(24)
    return np.sqrt(np.bincount(h, minlength=GRAMS) / len(h)).astype(np.float32)


def style(data: bytes) -> list[float]:
    """Style of a whole UTF-8 text: shares of kinds of bytes, repetition of words and lines, lengths."""
    if not data:
        return [0.0] * len(STYLE)
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()))
    share = hist[hist > 0] / n
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / m), len(seen) / m, max(seen.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m, hist[_SYMBOLS].sum() / n, hist[65:91].sum() / letters, hist[48:58].sum() / n,
        hist[_PUNCTUATION].sum() / n, (hist[9:14].sum() + hist[32]) / n,
        math.log1p(m / max(1, len(lines))), math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), hist.max() / n, float(-(share * np.log(share)).sum()),
    ]


def features(data: bytes) -> np.ndarray:
    """Style and hashed byte trigrams of a whole UTF-8 text, ``WIDTH`` numbers."""
    return np.concatenate([np.array(style(data), np.float32), trigram_shares(np.frombuffer(data, np.uint8))])


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


class QualityModel:
    """One hidden layer over standardised features; ``score`` is the probability of good quality."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], prior: float):
        self.mean, self.scale, self.layers, self.prior = mean, scale, layers, prior

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(_expand(x, self.mean, self.scale) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


class _Adam:
    """Steps of a layer list along given gradients."""

    def __init__(self, layers: list[np.ndarray], rate: float):
        self.layers, self.rate, self.step = layers, rate, 0
        self.first, self.second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]

    def move(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for k, g in enumerate(grads):
            g = g + 1e-3 * self.layers[k]
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            self.layers[k] -= self.rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)


def _kept_ratio(p_score: np.ndarray, u_score: np.ndarray) -> float:
    """Least share of unlabelled over positive rows that a threshold keeps, thresholds chosen by upper confidence limits."""
    p_score, u_score = np.sort(p_score), np.sort(u_score)
    kept_p = np.arange(len(p_score), 0, -1) / len(p_score)
    kept_u = 1 - np.searchsorted(u_score, p_score) / len(u_score)
    slack = math.sqrt(math.log(40) / 2 / len(p_score)) + math.sqrt(math.log(40) / 2 / len(u_score))
    best = int(np.argmin((kept_u + slack) / kept_p))
    return float(min(1.0, kept_u[best] / kept_p[best]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray | float = 1.0, rounds: int = 2, seed: int = 7) -> float:
    """Share of positives in unlabelled rows, from positives and unlabelled rows alone.

    A threshold on any score that keeps the share p of all positives keeps at
    least prior * p of the unlabelled rows, so u / p bounds the prior from above,
    and the better a score separates, the closer. Half of the rows train a model
    under the bound so far, the other half give its bound, then the halves change
    places; the mean is the next round's prior. Without rows it is 0.5.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    p = np.array_split(rng.permutation(positive), 2)
    u = np.array_split(rng.permutation(unlabelled), 2)
    prior = 0.5
    for _ in range(rounds):
        models = [fit_pu(p[k], u[k], prior, weights, steps=300) for k in (0, 1)]
        prior = sum(_kept_ratio(m.logit(p[1 - k]), m.logit(u[1 - k])) for k, m in enumerate(models)) / 2
    return prior


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weights: np.ndarray | float = 1.0, hidden: int = 16, steps: int = 800, rate: float = 0.02, seed: int = 7) -> QualityModel:
    """Minimise the non-negative unbiased risk of positive-unlabelled data with logistic loss.

    The risk of a batch is ``prior * P[l(g)] + max(0, U[l(-g)] - prior * P[l(-g)])``.
    Where the second part is below zero, the step goes uphill on it, as the
    non-negative estimator asks. Without positives or unlabelled rows every
    score is the prior.
    """
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        odds = math.log(min(max(prior, 1e-6), 1 - 1e-6) / (1 - min(max(prior, 1e-6), 1 - 1e-6)))
        return QualityModel(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([odds])], prior)
    mean, scale = unlabelled.mean(0), (unlabelled.std(0) + 1e-3) / weights
    every_p, every_u = _expand(positive, mean, scale), _expand(unlabelled, mean, scale)
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / math.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.array([math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))])]
    adam = _Adam(layers, rate)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ layers[0] + layers[1])
        return h, h @ layers[2] + layers[3][0]

    def back(x: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(d, layers[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    for _ in range(steps):
        p, u = every_p[rng.integers(len(every_p), size=1024)], every_u[rng.integers(len(every_u), size=2048)]
        (hp, gp), (hu, gu) = run(p), run(u)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if negative >= 0:
            grads = [a + b for a, b in zip(back(p, hp, (prior * (sp - 1) - prior * sp) / len(p)), back(u, hu, su / len(u)), strict=True)]
        else:
            grads = [a + b for a, b in zip(back(p, hp, prior * sp / len(p)), back(u, hu, -su / len(u)), strict=True)]
        adam.rate = rate * (1 - adam.step / steps)
        adam.move(grads)
    return QualityModel(mean, scale, layers, prior)


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """The distinct features of texts, as bytes of 32-bit floats, with the flags of their rows (positive, sampled)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([features(t.as_py()).tobytes() for t in batch.column(3)], pa.binary())], ["key", "positive", "sampled", "features"])

    rows = docs.select("key", "positive", "sampled", F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(describe, "key long, positive boolean, sampled boolean, features binary").dropDuplicates()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on bounded samples by hash of the id: a third of ``fit_rows`` trusted positives, the rest unlabelled text.

    The trusted positives are documents labelled 1, thinned by their own number;
    no other label is read. Unlabelled text is thinned by the number of documents
    and holds all kinds. The class prior is estimated from the two. Null labels
    are left out; of repeated labels the largest holds. Rows that repeat an id and
    a text count once. Without positives the prior is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label")).where("label = 1").select(F.col(id_col).alias("trusted"))
    most = max(1, fit_rows // 3)
    every, every_p = max(1, -(-docs.count() // (fit_rows - most or 1))), max(1, -(-known.count() // most))
    key = F.xxhash64(F.lit(1), id_col)
    # About ``most`` distinct ids at any size, so they are broadcast and no text is shuffled.
    trusted = F.broadcast(known.where(F.pmod(F.xxhash64("trusted"), F.lit(every_p)) == 0))
    marked = docs.select(id_col, text_col).join(trusted, F.col(id_col) == F.col("trusted"), "left")
    marked = marked.select(key.alias("key"), F.col("trusted").isNotNull().alias("positive"), (F.pmod(key, F.lit(every)) == 0).alias("sampled"), F.col(text_col).alias("text"))
    rows = with_features(marked.where("positive OR sampled"), "text").collect()
    rows.sort(key=lambda r: (r.key, r.features))
    x = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, WIDTH)
    positive, unlabelled = (x[np.array([r[k] for r in rows], bool)] for k in ("positive", "sampled"))
    return fit_pu(positive, unlabelled, estimate_prior(positive, unlabelled, WEIGHTS), WEIGHTS)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: (id, score, predicted). A null text counts as empty; each row gives a row."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, F.encode(text_or_empty(text_col), "UTF-8").alias("text")).mapInArrow(rate, f"{id_col} {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 30_000) -> DataFrame:
    """Learn from folds of crc32(doc_id) mod 5 other than 0, documents and labels alike, then score every row of ``docs``.

    Returns (doc_id, score, predicted, held_out), a row for each input row: a null
    id counts as the text ``null`` in the fold, a null text counts as empty, of a
    long text all bytes count, repeated rows get equal scores, and an empty table
    gives no row. Other columns are left out.
    """
    learn = crc_fold("doc_id", 5) != 0
    model = fit(docs.where(learn), labels.where(learn), fit_rows)
    return score(docs, model, threshold).withColumn("held_out", crc_fold("doc_id", 5) == 0)
