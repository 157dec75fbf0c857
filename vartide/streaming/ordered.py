"""Online monitoring of rows that come late and in any order (an extension: the audits themselves are batch jobs).

State per (model, asset): the last `window` scores, the next position, the run length, and the rows that are ahead of it, by
position. A row that closes a gap releases those behind it. A gap that stays open until the watermark has passed the waiting
row by `patience` is given up: a timer goes on at the least waiting position. State is bounded by the window and by the rows
that wait, whatever the stream's length. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "model string, asset string, pos long, q_v double, var_corr double, violation int, run long, skipped long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Monitor(StatefulProcessor):
    def __init__(self, alpha: float, window: int, patience_ms: int):
        self.alpha, self.window, self.patience = alpha, window, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getListState("scores", "score double")
        self.place = handle.getValueState("place", "next long, run long")
        self.waiting = handle.getMapState("waiting", "pos long", "r double, q double, ms long")

    def _move(self, key: tuple, skip: bool = False) -> pd.DataFrame:
        """Take rows in order while the next one is there; with `skip` first go on at the least one that waits."""
        next_, run = self.place.get() if self.place.exists() else (0, 0)
        skipped, rows = 0, []
        ahead = {p[0]: v for p, v in self.waiting.iterator()}
        for p in [p for p in ahead if p < next_]:  # given up before it came, or a repeated row
            self.waiting.removeKey((p,))
            del ahead[p]
        if skip and ahead:
            skipped, next_ = min(ahead) - next_, min(ahead)
        if next_ in ahead:
            scores = [s[0] for s in self.scores.get()]
            while next_ in ahead:
                r, q, _ = ahead.pop(next_)
                self.waiting.removeKey((next_,))
                if len(scores) == self.window:
                    q_v = float(np.quantile(scores, 1 - self.alpha))
                    run = run + 1 if abs(q_v) / (abs(q) + 1e-12) > 1 else 0
                    rows.append((*key, next_, q_v, q_v - q, int(r < q - q_v), run, skipped))
                    skipped = 0
                scores = [*scores, q - r][-self.window :]
                next_ += 1
            self.scores.put([(s,) for s in scores])
        self.place.update((next_, run))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ahead:
            self.handle.registerTimer(max(1, int(ahead[min(ahead)][2]) + self.patience))
        return pd.DataFrame(rows, columns=["model", "asset", "pos", "q_v", "var_corr", "violation", "run", "skipped"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for pos, r, q, ms in frame[["pos", "r", "q", "ms"]].itertuples(index=False):
                self.waiting.updateValue((int(pos),), (float(r), float(q), int(ms)))
        yield self._move(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._move(key, skip=True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        past = initialState.sort_values("pos")
        self.scores.put([(float(s),) for s in (past.q - past.r).to_numpy()[-self.window :]])
        self.place.update((int(past.pos.max()) + 1, int(past.run.iloc[-1]) if "run" in past else 0))

    def close(self) -> None:
        pass


def with_history(paths: DataFrame, window: int) -> DataFrame:
    """The rows of a batch table (model, asset, pos, r, q) that a monitor starts from: the last `window` of each pair."""
    last = paths.groupBy("model", "asset").agg(F.max("pos").alias("_last"))
    return paths.join(last, ["model", "asset"]).filter(F.col("pos") > F.col("_last") - window).select("model", "asset", F.col("pos").cast("long"), "r", "q")


def monitor(paths: DataFrame, alpha: float = 0.01, window: int = 250, lateness: str = "1 day", patience_ms: int = 0, history: DataFrame | None = None) -> DataFrame:
    """Streaming rows (model, asset, pos, r, q, ts) to OUTPUT, each corrected by the `window` scores before it, in the
    order of pos; `skipped` counts positions given up before a row. history: a batch table that the stream continues."""
    rows = paths.withWatermark("ts", lateness).select("model", "asset", F.col("pos").cast("long").alias("pos"), "r", "q", F.unix_millis("ts").alias("ms"), "ts")
    start = None if history is None else with_history(history, window).groupBy("model", "asset")
    return rows.groupBy("model", "asset").transformWithStateInPandas(Monitor(alpha, window, patience_ms), OUTPUT, "Append", "EventTime", start)


def joined(returns: DataFrame, forecasts: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streams of returns (asset, pos, ts, r) and forecasts (model, asset, pos, ts, q) as one of paths: a forecast waits for its
    return, and a return for its forecasts, until the watermark has passed both."""
    a = returns.withWatermark("ts", lateness).select("asset", "pos", "ts", "r")
    b = forecasts.withWatermark("ts", lateness).select("model", F.col("asset").alias("_asset"), F.col("pos").alias("_pos"), F.col("ts").alias("_ts"), "q")
    return a.join(b, F.expr("asset = _asset and pos = _pos and ts = _ts")).select("model", "asset", "pos", "r", "q", "ts")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
