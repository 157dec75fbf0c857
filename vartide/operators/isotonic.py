"""Isotonic regression of groups that no task can hold.

The least-squares non-decreasing fit of y over x is the slope of the greatest convex minorant of the points (cumulated
weight, cumulated y). The minorant of a union of ranges is that of their minorants' corners, so sorted ranges are
reduced to their corners where they lie, and only corners go on: for hits and misses a few for thousands of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from vartide.operators.distributions import interpolate
from vartide.operators.scan import _batch
from vartide.sources import scratch

#: Rows of a range that is reduced to corners in one go.
CHUNK = 65_536


def push(corners: list[tuple], w: float, t: float, low: float, high: float) -> None:
    """Add the point (w, t) to the right of a convex chain; corners are (w, t, low, high), the piece of the fit that ends
    there going from the x `low` to the x `high`. The first one is where the chain starts."""
    while len(corners) > 1:
        (w0, t0), (w1, t1, before, _) = corners[-2][:2], corners[-1]
        if (t1 - t0) * (w - w1) < (t - t1) * (w1 - w0):
            break
        low = before  # pooled with the piece before
        corners.pop()
    corners.append((w, t, low, high))


def _levels(rows: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, x, w, t: number and sum of y of each different x, in sorted ranges (_part) and their order (_at)."""
    pooled = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("t"))
    order = [*keys, "x"]
    return scratch.written(pooled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "levels").withColumn("_part", F.shiftright("_at", 33))


def fit(rows: DataFrame, x: str, y: str, keys: tuple[str, ...], chunk: int = CHUNK) -> DataFrame:
    """keys, low, high, level: the pieces of the fit, each from the x `low` to the x `high`; equal x count together.

    Each part of the sorted ranges gives the corners of its chunks, in weights and sums from the part's own start;
    the parts' totals place them, and a stream over a key's corners keeps those of the whole minorant."""
    levels = _levels(rows, x, y, keys)
    schema = StructType([*[levels.schema[k] for k in keys], StructField("_part", LongType()), StructField("seq", LongType()), *[StructField(c, DoubleType()) for c in ("w", "t", "low", "high")]])

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, chain, seen, seq, w, t = None, [], 0, 0, 0.0, 0.0
        for b in batches:
            done = []
            for *group, x, more, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != of or seen >= chunk:
                    done += [(*of, seq + k, *c) for k, c in enumerate(chain[1:])] if of is not None else []
                    seq += len(chain)
                    if group != of:
                        of, w, t = group, 0.0, 0.0
                    chain, seen = [(w, t, None, None)], 0
                w, t, seen = w + more, t + total, seen + 1
                push(chain, w, t, x, x)
            yield _batch(done, schema)
        if of is not None:
            yield _batch([(*of, seq + k, *c) for k, c in enumerate(chain[1:])], schema)

    first = levels.sortWithinPartitions(*keys, "_part", "_at").select(*keys, "_part", "x", "w", "t").mapInArrow(corners, schema)
    first = scratch.written(first, "corners")
    totals = levels.groupBy(*keys, "_part").agg(F.sum("w").alias("_w"), F.sum("t").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("_w", "_t")])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = first.join(totals, same).select(*keys, "_part", "seq", (F.col("w") + F.col("_w")).alias("w"), (F.col("t") + F.col("_t")).alias("t"), "low", "high")
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "_part", "seq").select(*keys, "w", "t", "low", "high")
    out = StructType([*[levels.schema[k] for k in keys], *[StructField(c, DoubleType()) for c in ("low", "high", "level")]])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, chain = None, []

        def pieces() -> list[tuple]:
            return [(*of, b[2], b[3], (b[1] - a[1]) / (b[0] - a[0])) for a, b in zip(chain, chain[1:], strict=False)]

        for b in batches:
            done = []
            for *group, w, t, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != of:
                    done += pieces() if of is not None else []
                    of, chain = group, [(0.0, 0.0, None, None)]
                push(chain, w, t, low, high)
            yield _batch(done, out)
        if of is not None:
            yield _batch(pieces(), out)

    return placed.mapInArrow(whole, out)


def knots(pieces: DataFrame, keys: tuple[str, ...], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """keys, xs, ys: both ends of every piece in order, levels held to [low, high]; as long as the fit has pieces."""
    level = F.greatest(F.lit(low), F.least(F.lit(high), F.col("level")))
    ends = F.when(F.col("low") < F.col("high"), F.array(F.struct(F.col("low").alias("x"), level.alias("y")), F.struct(F.col("high").alias("x"), level.alias("y"))))
    ends = ends.otherwise(F.array(F.struct(F.col("high").alias("x"), level.alias("y"))))
    all_ = F.array_sort(F.flatten(F.collect_list(ends)))
    return pieces.groupBy(*keys).agg(all_.alias("_p")).select(*keys, F.transform("_p", lambda p: p["x"]).alias("xs"), F.transform("_p", lambda p: p["y"]).alias("ys"))


def value(x: Column, xs: Column, ys: Column) -> Column:
    """The fit at x: linear between different x's of the data, constant outside."""
    return interpolate(x, xs, ys)
