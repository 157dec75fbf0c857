"""Order statistics over sliding windows, in O(log w) a row.

Spark's own sliding frames build each row's window anew. Here a history is cut into chunks by position, each chunk
gets the `window` rows before it as well, and one pass over a sorted partition keeps the last values in an indexable
structure. Nothing of a history but its last `window` values is held, and one long history spreads over tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Values of one block of `Ranks`; a block is cut in two beyond twice as many.
BLOCK = 1024
#: Positions of a chunk, at least; with wide windows four windows, so that at most a quarter of the rows are read twice.
CHUNK = 8192


class Ranks:
    """Numbers in order, in blocks: add, remove and pick by rank. NaN stands above all numbers."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = [[]]
        self.tops: list[float] = []
        self.size = self.nans = 0

    def _block(self, x: float) -> int:
        return min(bisect_left(self.tops, x), len(self.blocks) - 1)

    def add(self, x: float) -> None:
        self.size += 1
        if x != x:
            self.nans += 1
            return
        k = self._block(x)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = block[:BLOCK], block[BLOCK:]
            self.tops[k : k + 1] = block[BLOCK - 1], block[-1]
        elif self.tops:
            self.tops[k] = block[-1]
        else:
            self.tops.append(x)

    def remove(self, x: float) -> None:
        self.size -= 1
        if x != x:
            self.nans -= 1
            return
        k = self._block(x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        if block:
            self.tops[k] = block[-1]
        else:
            del self.tops[k]
            if len(self.blocks) > 1:
                del self.blocks[k]

    def pick(self, rank: int) -> float:
        """The value of rank 0, 1, 2..."""
        if rank >= self.size - self.nans:
            return math.nan
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)

    def quantile(self, p: float) -> float:
        """The type-7 quantile, with the interpolation that Spark's percentile has."""
        at = (self.size - 1) * p
        low, high = math.floor(at), math.ceil(at)
        a, b = self.pick(low), self.pick(high)
        return a if low == high or a == b else (high - at) * a + (at - low) * b


def with_history(rows: DataFrame, window: int, keys: tuple[str, ...], size: int) -> DataFrame:
    """rows dealt and sorted by keys, `_chunk` (of `size` >= window positions each) and pos; the last `window` rows of a
    chunk are in the next one as well, where they only are history."""
    own, place = F.floor(F.col("pos") / size), F.pmod(F.col("pos"), F.lit(size))
    dealt = rows.withColumn("_chunk", F.explode(F.when(place >= size - window, F.array(own, own + 1)).otherwise(F.array(own))))
    return dealt.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "pos")


def sliding(rows: DataFrame, value: str, window: int, quantiles: tuple[float, ...] = (), ranks: tuple[int, ...] = (), keys: tuple[str, ...] = ("asset",), name: str = "qs", chunk: int = 0) -> DataFrame:
    """rows with the array column `name`: the quantiles, then the values of these ranks (from 1; null beyond the
    window's size), of `value` over the `window` rows before each; null where these hold no value.

    pos counts the rows of each key from 0 without gaps. Null values take a place in the window but do not count."""
    size = max(chunk or CHUNK, 4 * window)
    dealt = with_history(rows, window, keys, size)
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))])
    at = [dealt.columns.index(c) for c in (*keys, "_chunk", "pos", value)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, last = None, Ranks(), deque()
        for b in batches:
            *key, pos, values = (b.column(k).to_pylist() for k in at)
            out, keep = [], []
            for k, group in enumerate(zip(*key, strict=True)):
                if group != of:
                    of, held, last = group, Ranks(), deque()
                x = values[k]
                if pos[k] // size == group[-1]:
                    keep.append(k)
                    n = held.size
                    out.append([held.quantile(p) for p in quantiles] + [held.pick(r - 1) if r <= n else None for r in ranks] if n else None)
                last.append(x)
                if x is not None:
                    held.add(x)
                if len(last) > window:
                    gone = last.popleft()
                    if gone is not None:
                        held.remove(gone)
            mine = b.take(pa.array(keep, pa.int64()))
            columns = [c for k, c in enumerate(mine.columns) if b.schema.names[k] != "_chunk"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=[f.name for f in schema.fields])

    return dealt.mapInArrow(run, schema)
