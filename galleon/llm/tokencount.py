"""Token counts of texts by a unigram model over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import small_batches, worker_store
from galleon.llm.vocabulary import WORD_START, default_vocabulary, pieces

#: Pre-tokens that a worker keeps, and four times as many trie nodes; both are emptied when full.
STORE = 500_000
#: Characters of texts whose pre-tokens are looked up together; a longer text is looked up alone.
GROUP = 1 << 22


def rank_scores(path: str) -> list[float]:
    """Log probability of each piece by its rank in the public vocabulary: frequency falls as 1 / rank."""
    known = [i for i, p in enumerate(pieces(path)) if p]
    total = math.log(sum(1 / (k + 2) for k in range(len(known))))
    scores = [-math.inf] * len(pieces(path))
    for k, i in enumerate(known):
        scores[i] = -math.log(k + 2) - total
    return scores


class PieceStates:
    """States of a text read from the left: the longest suffix that some piece starts with.

    ``ends`` gives the pieces that end there. ``moves`` keeps the steps taken, so
    only what texts use is held.
    """

    def __init__(self, path: str):
        self.ids = {p: i for i, p in enumerate(pieces(path)) if p}
        self.names = [""]
        self.known = {"": 0}
        for p in self.ids:
            for n in range(1, len(p) + 1):
                if p[:n] not in self.known:
                    self.known[p[:n]] = len(self.names)
                    self.names.append(p[:n])
        self.moves: list[dict[str, int]] = [{} for _ in self.names]
        self.found: dict[int, list[tuple[int, int]]] = {}

    def step(self, state: int, c: str) -> int:
        name = self.names[state] + c
        while name not in self.known:
            name = name[1:]
        to = self.moves[state][c] = self.known[name]
        return to

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that end in a state, the longest first."""
        found = self.found.get(state)
        if found is None:
            name = self.names[state]
            found = self.found[state] = [(len(name) - k, self.ids[name[k:]]) for k in range(len(name)) if name[k:] in self.ids]
        return found


@lru_cache(maxsize=2)
def _states(path: str) -> PieceStates:
    return PieceStates(path)


class TokenCounter:
    """Best unigram segmentation of pre-tokens; shared prefixes are computed once.

    A node of the trie is a prefix of some pre-token. It holds the forward score:
    the best log probability over all segmentations of the prefix, with the
    number of tokens there (fewer on ties), the last piece and the node before
    it. The nodes of one pre-token lie on a path, so a new pre-token costs only
    the nodes it adds, and each of those only the pieces that end there. A
    character without a piece counts as one token for each UTF-8 byte.
    """

    def __init__(self, path: str, scores: list[float]):
        self.states, self.scores = _states(path), scores
        self.worst = min(s for s in scores if s > -math.inf)
        self.scored: dict[int, list[tuple[int, int, float]]] = {}
        self.clear()

    def clear(self) -> None:
        self.terminal: dict[str, int] = {}
        self.below: dict[int, int] = {}
        self.forward, self.tokens, self.state = [0.0], [0], [0]
        self.last, self.before, self.depth = array("i", [-1]), array("i", [0]), array("i", [0])

    def _ends(self, state: int) -> list[tuple[int, int, float]]:
        found = self.scored[state] = [(length, piece, self.scores[piece]) for length, piece in self.states.ends(state)]
        return found

    def _grow(self, path: list[int], c: str) -> int:
        """Add the node that ``c`` leads to from the end of a path of nodes."""
        forward, tokens = self.forward, self.tokens
        start = path[-1]
        state = self.state[start]
        to = self.states.moves[state].get(c)
        if to is None:
            to = self.states.step(state, c)
        ends = self.scored.get(to)
        if ends is None:
            ends = self._ends(to)
        best, count, last = -math.inf, 0, -1
        if not ends or ends[-1][0] > 1:
            size = len(c.encode("utf-8", "surrogatepass"))
            best, count = forward[start] + self.worst * size, tokens[start] + size
        for length, piece, s in ends:
            node = path[-length]
            s += forward[node]
            if s > best or s == best and tokens[node] + 1 < count:
                best, count, last, start = s, tokens[node] + 1, piece, node
        forward.append(best), tokens.append(count), self.state.append(to)
        self.last.append(last), self.before.append(start), self.depth.append(len(path))
        return len(forward) - 1

    def add(self, words: Iterable[str]) -> None:
        below, terminal, grow = self.below, self.terminal, self._grow
        for word in words:
            node, path = 0, [0]
            for c in WORD_START + word:
                key = node << 21 | ord(c)
                node = below.get(key)
                if node is None:
                    node = below[key] = grow(path, c)
                path.append(node)
            terminal[word] = node

    def full(self) -> bool:
        return len(self.terminal) > STORE or len(self.forward) > 4 * STORE

    def nodes(self, words: list[str]) -> list[int]:
        """The last nodes of distinct pre-tokens."""
        self.add([w for w in words if w not in self.terminal])
        return list(map(self.terminal.__getitem__, words))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and log probability of each whole text."""
        sizes, words, rows = _distinct(texts)
        if self.full():
            self.clear()
        nodes = self.nodes(words)
        owner = np.repeat(np.arange(len(texts)), sizes)
        tokens = np.fromiter(map(self.tokens.__getitem__, nodes), np.int64, len(nodes))
        score = np.fromiter(map(self.forward.__getitem__, nodes), float, len(nodes))
        return sizes, np.bincount(owner, tokens[rows], len(texts)).astype(np.int64), np.bincount(owner, score[rows], len(texts))

    def piece_counts(self, seen: np.ndarray) -> np.ndarray:
        """How often each piece is in the best segmentations of nodes met ``seen`` times.

        What was met at a node was met at the node before its last piece, so the
        trie is emptied from its deepest level upwards.
        """
        last, before, depth = (np.array(a, np.int32) for a in (self.last, self.before, self.depth))
        seen = seen.copy()
        order = np.argsort(depth, kind="stable")
        levels = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for level in range(len(levels) - 2, 0, -1):
            own = order[levels[level] : levels[level + 1]]
            np.add.at(seen, before[own], seen[own])
        hit = last >= 0
        return np.bincount(last[hit], seen[hit], len(self.scores)).astype(np.int64)


def _distinct(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Pre-tokens of each text, the distinct ones of all, and where each one stands among those."""
    split = [t.split() for t in texts]
    coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
    return np.fromiter(map(len, split), np.int64, len(split)), coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in groups of about ``GROUP`` characters."""
    group, held = [], 0
    for value in column:
        text = value.as_py()
        group.append(text)
        held += len(text)
        if held > GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def fit_scores(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", smoothing: float = 0.1) -> list[float]:
    """Log probability of each piece of the public vocabulary, estimated over all texts.

    The vocabulary stays as it is. Spark counts the distinct pre-tokens; tasks
    segment those with scores by rank and count the pieces; the sums, one for each
    piece at most, come to the driver. Null and empty texts count nothing; without
    any text all pieces are equally likely.
    """
    path = vocabulary or default_vocabulary()
    words = docs.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), r"(?U)\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, rank_scores(path))
        total = np.zeros(len(counter.scores), np.int64)
        met: list[tuple[list[int], np.ndarray]] = []

        def settle() -> None:
            seen = np.zeros(len(counter.forward), np.int64)
            for nodes, n in met:
                np.add.at(seen, nodes, n)
            total[:] += counter.piece_counts(seen)
            counter.clear(), met.clear()

        for batch in batches:
            met.append((counter.nodes(batch.column(0).to_pylist()), batch.column(1).to_numpy()))
            if counter.full():
                settle()
        settle()
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["piece", "n"])

    found = words.mapInArrow(count, "piece int, n long")
    n = np.zeros(len(pieces(path)))
    for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        n[r.piece] = r.n
    known = np.array([bool(p) for p in pieces(path)])
    n = np.where(known, n + smoothing, 0)
    return [math.log(x) if x else -math.inf for x in (n / n.sum()).tolist()]


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", scores: list[float] | None = None) -> DataFrame:
    """Tokens of each whole text; returns (id, n_words, n_tokens, log_prob).

    Pre-tokens are runs between white space. ``scores`` are those of the pieces,
    in the order of the vocabulary; where none are given, ``fit_scores`` takes
    them from all of ``docs``. No text is shuffled: each worker has its own trie
    over the pre-tokens it meets. A null or empty text has no tokens; null ids and
    repeated rows each give a row; other columns are ignored; an empty table gives
    no row.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(fit_scores(docs, path, text_col) if scores is None else list(scores))
    key = hash((path, *shared.value))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(f"trie-{key}")
        if not store:
            store["counter"] = TokenCounter(path, shared.value)
        counter = store["counter"]
        for batch in batches:
            found = [counter.of(group) for group in _groups(batch.column(1))]
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], [id_col, "n_words", "n_tokens", "log_prob"])

    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(count, f"{id_col} {kind}, n_words long, n_tokens long, log_prob double")
