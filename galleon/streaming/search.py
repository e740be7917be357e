"""Standing queries over a stream of gallery rows: the best k of each time window, kept in state."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from galleon.operators.search import METRICS, scores

RESULT = "window_start timestamp, query_id long, item_id long, score double, rank int"
#: The state store that this operator needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class BestInWindows(StatefulProcessor):
    """For one block of queries: their vectors, and for each open window the best k items of each.

    A heap holds (score, item) with ``NaN`` in places that are not filled. A timer at a
    window's end hands its ranking out and forgets it.
    """

    def __init__(self, k: int, metric: str, window_ms: int):
        self.k, self.metric, self.window_ms, self.larger = k, metric, window_ms, METRICS[metric][1]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queries = handle.getValueState("queries", "data binary")
        self.heaps = handle.getMapState("heaps", "start long", "data binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ids, vectors = np.array(initialState["item_id"], np.int64), np.array(initialState["v"].tolist(), np.float64)
        old = self._queries()
        if old:  # a block's queries can come in parts
            ids, vectors = np.concatenate([old[0], ids]), np.concatenate([old[1], vectors])
        self.queries.update((_packed(ids=ids, vectors=vectors),))

    def _queries(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.queries.exists():
            return None
        held = np.load(io.BytesIO(bytes(self.queries.get()[0])))
        return held["ids"], held["vectors"]

    def _heap(self, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.heaps.containsKey((start,)):
            held = np.load(io.BytesIO(bytes(self.heaps.getValue((start,))[0])))
            return held["score"], held["item"]
        return np.full((n, self.k), np.nan), np.zeros((n, self.k), np.int64)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._queries()
        for batch in rows if known else ():
            ids, vectors = known
            for start, part in batch.groupby(batch["ms"] // self.window_ms * self.window_ms):
                start = int(start)
                new = not self.heaps.containsKey((start,))
                score, item = self._heap(start, len(ids))
                items = np.array(part["item_id"], np.int64)
                s = scores(vectors, np.array(part["v"].tolist(), np.float64), self.metric)
                s[ids[:, None] == items[None, :]] = np.nan
                score, item = np.concatenate([score, s], 1), np.concatenate([item, np.broadcast_to(items, s.shape)], 1)
                key_ = np.where(np.isnan(score), np.inf, -score if self.larger else score)
                order = np.lexsort((item, key_), axis=1)[:, : self.k]
                score, item = np.take_along_axis(score, order, 1), np.take_along_axis(item, order, 1)
                self.heaps.updateValue((start,), (_packed(score=score, item=item),))
                if new:
                    self.handle.registerTimer(start + self.window_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.window_ms
        ids, _ = self._queries()
        score, item = self._heap(start, len(ids))
        self.heaps.removeKey((start,))
        row, place = np.nonzero(~np.isnan(score))
        yield pd.DataFrame({"window_start": pd.to_datetime(np.full(len(row), start), unit="ms"), "query_id": ids[row], "item_id": item[row, place], "score": score[row, place], "rank": (place + 1).astype(np.int32)})

    def close(self) -> None:
        pass


def windowed_topk(queries: DataFrame, items: DataFrame, k: int, window_seconds: int, late_seconds: int = 0, metric: str = "cosine", block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", time_col: str = "ts") -> DataFrame:
    """The k streamed rows of each window nearest to each standing query: (window_start, query_id, item_id, score, rank).

    ``items`` is a stream with an event time. Queries are dealt by hash into blocks of
    about ``block``; a block's vectors are its first state, and each streamed row goes
    once to each block, in its own type: what is shuffled are the rows times the blocks, so blocks are large. A window's state is k rows for each query, however many rows it
    gets, and in whatever order. When the watermark, ``late_seconds`` behind the latest
    row, passes its end, its ranking is handed out once (output mode append) and the
    state is dropped; rows that come later are too late. The state survives a restart
    from the query's checkpoint.

    Needs the RocksDB state store, ``STORE``, in ``spark.sql.streaming.stateStore.providerClass``.
    Null ids, vectors and times, and for cosine vectors of length zero, are left out; a row
    never finds its own id; ties go to the smaller item; of rows that repeat an id each
    counts; a window without rows gives none.
    """
    known = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(vector_col).alias("v")).dropna()
    blocks = max(1, -(-known.count() // block))
    held = known.withColumn("q", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    rows = items.withWatermark(time_col, f"{late_seconds} seconds").select(
        F.col(id_col).cast("long").alias("item_id"), F.col(vector_col).alias("v"), F.col(time_col), F.unix_millis(time_col).alias("ms")
    )
    sent = rows.dropna().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = BestInWindows(k, metric, 1000 * window_seconds)
    return sent.groupBy("q").transformWithStateInPandas(best, RESULT, "append", "eventTime", held.groupBy("q"))
