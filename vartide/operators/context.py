"""Forecasters that take batches of contexts: every day of every asset, one matrix at a time.

A model says how long its contexts are and opens once in a worker process; after that it is given 32-bit matrices, a row for
each day with the returns before it (the last ones at the right, NaN to the left of short ones), and returns a matrix of
samples or of quantiles at its levels. Days come in chunks with the history they need, so a long series spreads over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import distributions, sliding
from vartide.operators.returns import exact

#: contexts (n, length) float32, lengths (n), seeds (n) -> outputs (n, k).
Inference = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class ContextModel:
    """Subclass and give `open`. `levels` says that outputs are quantiles; without it they are samples."""

    model_id: str = "context"
    revision: str = "1"
    context_length: int = 512
    n_samples: int = 1000
    seed: int = 2026
    levels: tuple[float, ...] | None = None

    def open(self) -> Inference:
        raise NotImplementedError

    def call_seed(self, asset: str, pos: int) -> int:
        """The same in every process and for every cut into batches."""
        return zlib.crc32(f"{self.seed}:{self.model_id}:{self.revision}:{asset}:{pos}".encode()) & 0x7FFFFFFF


_opened: dict[ContextModel, Inference] = {}


def opened(model: ContextModel) -> Inference:
    """The model of this worker process, opened the first time that it is asked for."""
    if model not in _opened:
        _opened[model] = model.open()
    return _opened[model]


def infer(returns: DataFrame, model: ContextModel, batch: int = 256, least: int = 1, chunk: int = 0) -> DataFrame:
    """asset, date, pos, r, model and output (array of doubles) for every day with at least `least` returns before it;
    returns: asset, date, pos (from 0 without gaps), r."""
    length = model.context_length
    size = max(chunk or sliding.CHUNK, length)
    dealt = sliding.with_history(returns.select("asset", "date", "pos", "r"), length, ("asset",), size)
    fields = [f for f in dealt.schema.fields if f.name != "_chunk"]
    schema = StructType([*fields, StructField("model", StringType()), StructField("output", ArrayType(DoubleType()))])

    types = to_arrow_schema(schema)

    def answers(past: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
        """rows: (asset, date, pos, r, place in past)."""
        n = len(rows)
        contexts, lengths = np.full((n, length), np.nan, np.float32), np.zeros(n, np.int64)
        for k, (*_, at) in enumerate(rows):
            own = past[max(0, at - length) : at]
            contexts[k, length - len(own) :], lengths[k] = own, len(own)
        seeds = np.array([model.call_seed(asset, pos) for asset, _, pos, _, _ in rows], np.int64)
        out = np.asarray(opened(model)(contexts, lengths, seeds), np.float64)
        columns = list(zip(*rows, strict=True))[:4]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, types, strict=False)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([model.model_id] * n), pa.array(list(out), pa.list_(pa.float64()))], names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, past, rows = None, [], []
        for b in batches:
            for asset, date, pos, r, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (asset, own) != of:
                    if rows:
                        yield answers(np.array(past, np.float32), rows)
                    of, past, rows = (asset, own), [], []
                if pos // size == own and len(past) >= least:
                    rows.append((asset, date, pos, r, len(past)))
                past.append(np.nan if r is None else r)
                if len(rows) >= batch:
                    yield answers(np.array(past, np.float32), rows)
                    past, rows = past[-length:], []
        if rows:
            yield answers(np.array(past, np.float32), rows)

    return dealt.select("asset", "date", "pos", "r", "_chunk").mapInArrow(run, schema)


def path(inferred: DataFrame, model: ContextModel, alpha: float = 0.01) -> DataFrame:
    """model, asset, date, pos, r, q and es at a level, from the samples or the grid of `infer`."""
    q, es = figures(F.col("output"), model, alpha)
    return inferred.select("model", "asset", "date", "pos", "r", exact(q).alias("q"), exact(es).alias("es"))


def figures(output: Column, model: ContextModel, alpha: float) -> tuple[Column, Column]:
    """Quantile and expected shortfall; a grid's shortfall is the mean of its quantiles at ten levels below alpha."""
    if model.levels is None:
        return distributions.sample_quantile(output, alpha), distributions.sample_shortfall(output, alpha)
    levels = F.array(*map(stats.d, model.levels))
    below = [distributions.grid_quantile(levels, output, alpha * (k + 0.5) / 10) for k in range(10)]
    return distributions.grid_quantile(levels, output, alpha), sum(below[1:], below[0]) / 10.0


@dataclass(frozen=True)
class Redrawn(ContextModel):
    """A seeded stand-in for a sampling model: draws from its own context, by arithmetic on the call's seed."""

    model_id: str = "redrawn"
    n_samples: int = 50

    def call_seed(self, asset: str, pos: int) -> int:
        return self.seed + pos

    def open(self) -> Inference:
        def draw(contexts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
            k = np.arange(self.n_samples)
            at = (seeds[:, None] * (2 * k + 1) * 7919 + 104_729 * k) % lengths[:, None]
            return np.take_along_axis(contexts, contexts.shape[1] - lengths[:, None] + at, axis=1)

        return draw


@dataclass(frozen=True)
class ContextGrid(ContextModel):
    """A stand-in for a model with a quantile head: the quantiles of its context."""

    model_id: str = "context_grid"
    levels: tuple[float, ...] = tuple(k / 10 for k in range(1, 10))

    def open(self) -> Inference:
        return lambda contexts, lengths, seeds: np.nanquantile(contexts.astype(np.float64), self.levels, axis=1).T


def contexts(returns: DataFrame, model: ContextModel, least: int = 1) -> DataFrame:
    """asset, date, pos, r and what the store's keys are made of (see `sources.store`) for every day that `infer` answers."""
    length, plain = model.context_length, lambda c: F.lit(getattr(model, c))
    past = Window.partitionBy("asset").orderBy("pos").rowsBetween(-length, -1)
    days = returns.select("asset", "date", "pos", "r").withColumn("context", F.collect_list("r").over(past)).filter(F.col("pos") >= least)
    return days.select("*", plain("model_id").alias("model"), plain("revision").alias("revision"), plain("n_samples").alias("n_samples"), plain("seed").cast("long").alias("seed"))
