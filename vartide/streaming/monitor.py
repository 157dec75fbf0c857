"""Online conformal monitoring with Structured Streaming (an extension: the audits themselves are batch jobs).

State per (model, asset) is a ring of the last `window` scores, the run length and the last position: bounded,
whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "model string, asset string, pos long, q_v double, var_corr double, violation int, run long"
STATE = "scores array<double>, run long"


def monitor(paths: DataFrame, alpha: float = 0.01, window: int = 250) -> DataFrame:
    """Streaming rows (model, asset, pos, r, q) to OUTPUT: each corrected by the `window` scores before it.

    Rows of a key have to arrive in order of pos across micro-batches (any order within one)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scores, run = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = []
        for pos, r, q in pd.concat(list(frames)).sort_values("pos")[["pos", "r", "q"]].itertuples(index=False):
            if len(scores) == window:
                q_v = float(np.quantile(scores, 1 - alpha))
                run = run + 1 if abs(q_v) / (abs(q) + 1e-12) > 1 else 0
                rows.append((*key, pos, q_v, q_v - q, int(r < q - q_v), run))
            scores = (scores + [q - r])[-window:]
        state.update((scores, run))
        yield pd.DataFrame(rows, columns=["model", "asset", "pos", "q_v", "var_corr", "violation", "run"])

    return paths.select("model", "asset", "pos", "r", "q").groupBy("model", "asset").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def daily_bars(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Tumbling daily sums per event type, late rows up to the watermark included, repeated event_ids once."""
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    bars = once.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return bars.select(F.col("w.start").cast("date").alias("date"), "event_type", "n", "total")
