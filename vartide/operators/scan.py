"""Recursions along ordered rows as associative scans.

A step of a recursion is a map of its state; where maps of a kind compose into maps of that kind, a history is cut
into chunks, each chunk reduced to one map, the chunks' maps applied one after the other (a row a chunk), and
each chunk filled from its first state. A long history spreads over tasks, and none holds more than a row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK = 8192


@dataclass(frozen=True)
class Affine:
    """state <- decay * state + (1 - decay) * x * x: exponentially weighted squares. Maps are (slope, shift)."""

    decay: float

    identity = (1.0, 0.0, 0.0)

    def step(self, state: float, x: float) -> float:
        return self.decay * state + (1 - self.decay) * x * x

    def then(self, m: tuple, x: float) -> tuple:
        return (m[0] * self.decay, self.decay * m[1] + (1 - self.decay) * x * x, 0.0)

    def apply(self, m: tuple, state: float) -> float:
        return m[0] * state + m[1]


@dataclass(frozen=True)
class ClippedShift:
    """state <- clip(state + rate * (target - x), low, high): an adaptive level. Maps are (low, high, shift): clip(state +
    shift, low, high) with bounds of its own, and a clip of a shifted clip is one again."""

    rate: float
    target: float
    low: float
    high: float

    identity = (float("-inf"), float("inf"), 0.0)

    def step(self, state: float, x: float) -> float:
        return max(self.low, min(self.high, state + self.rate * (self.target - x)))

    def then(self, m: tuple, x: float) -> tuple:
        s = self.rate * (self.target - x)
        clip = lambda v: max(self.low, min(self.high, v + s))
        return (clip(m[0]), clip(m[1]), m[2] + s)

    def apply(self, m: tuple, state: float) -> float:
        return max(m[0], min(m[1], state + m[2]))


def _dealt(rows: DataFrame, keys: tuple[str, ...], chunk: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col("pos") / chunk)).repartition(*keys, "_chunk")


def _maps(dealt: DataFrame, recursion, x: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, _chunk and the map (m0, m1, m2) of each chunk."""
    schema = StructType([*[dealt.schema[k] for k in (*keys, "_chunk")], *[StructField(m, DoubleType()) for m in ("m0", "m1", "m2")]])
    columns = [*keys, "_chunk", x]
    at = [dealt.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m, done = None, None, []
        for b in batches:
            for *group, value in zip(*(b.column(k).to_pylist() for k in at), strict=True):
                if group != of:
                    if of is not None:
                        done.append((*of, *m))
                    of, m = group, recursion.identity
                if value is not None:
                    m = recursion.then(m, value)
            yield _batch(done, schema)
            done = []
        if of is not None:
            yield _batch([(*of, *m)], schema)

    return dealt.sortWithinPartitions(*keys, "_chunk", "pos").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


def first_states(maps: DataFrame, recursion, starts: DataFrame, keys: tuple[str, ...], ends: bool = False) -> DataFrame:
    """keys, _chunk, _state: each chunk's state before its first row, from starts (keys, start); with `ends` one row a
    key instead, the state after its last chunk."""
    rows = maps.join(starts.select(*keys, "start"), list(keys)).select(*keys, "_chunk", "m0", "m1", "m2", "start")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_chunk")
    schema = StructType([*[maps.schema[k] for k in (*keys, "_chunk")], StructField("_state", DoubleType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, chunk = None, None, None
        for b in batches:
            done = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:n] != of:
                    if ends and of is not None:
                        done.append((*of, chunk, state))
                    of, state = r[:n], r[-1]
                chunk = r[n]
                if not ends:
                    done.append((*of, chunk, state))
                state = None if state is None else recursion.apply(r[n + 1 : n + 4], state)
            yield _batch(done, schema)
        if ends and of is not None:
            yield _batch([(*of, chunk, state)], schema)

    return rows.mapInArrow(run, schema)


def scan(rows: DataFrame, recursion, x: str, starts: DataFrame, keys: tuple[str, ...] = ("asset",), name: str = "state", chunk: int = CHUNK) -> DataFrame:
    """rows with `name`, the state before each row, and `name`_after, the state after it; starts: keys, start.

    pos orders the rows of a key, from 0. A null x leaves the state as it is; keys without a start have null states."""
    dealt = _dealt(rows, keys, chunk)
    first = first_states(_maps(dealt, recursion, x, keys), recursion, starts, keys)
    filled = dealt.join(first, [*keys, "_chunk"], "left").sortWithinPartitions(*keys, "_chunk", "pos")
    filled = filled.select(*rows.columns, "_chunk", "_state")
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType()), StructField(f"{name}_after", DoubleType())])
    at = [filled.columns.index(c) for c in (*keys, "_chunk", "_state", x)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for b in batches:
            before, after = [], []
            for *group, start, value in zip(*(b.column(k).to_pylist() for k in at), strict=True):
                if group != of:
                    of, state = group, start
                before.append(state)
                if state is not None and value is not None:
                    state = recursion.step(state, value)
                after.append(state)
            columns = [*b.columns[:-2], pa.array(before, pa.float64()), pa.array(after, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return filled.mapInArrow(run, schema)


def last_states(rows: DataFrame, recursion, x: str, starts: DataFrame, keys: tuple[str, ...] = ("asset",), name: str = "state", chunk: int = CHUNK) -> DataFrame:
    """keys and the state after all rows: the chunks' maps and their succession, no fill."""
    maps = _maps(_dealt(rows.select(*keys, "pos", x), keys, chunk), recursion, x, keys)
    return first_states(maps, recursion, starts, keys, ends=True).select(*keys, F.col("_state").alias(name))
