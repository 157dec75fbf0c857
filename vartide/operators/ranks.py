"""Ranks and exact quantiles of groups that no task can hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.sources import scratch

#: Points of the sketch's grid, its accuracy (a tenth of a grid step), and values of a bracket that are picked from.
GRID, ACCURACY, FEW = 1000, 10_000, 1 << 16


def _same(a: str, b: str, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def ranked(rows: DataFrame, value: str, keys: tuple[str, ...], ties: str = "pos") -> DataFrame:
    """rows (whose `value` is not null) with rank 0, 1, 2... of value, then `ties`, in each key.

    Sorted by ranges of (keys, value, ties), a row's rank is its place in its part less the place of its key's first
    row there, and its key's rows in the parts before: a group spreads over parts."""
    order = [*keys, value, ties]
    part = F.shiftright("_at", 33)
    sorted_ = rows.filter(F.col(value).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.written(sorted_, "sorted").withColumn("_part", part)
    runs = sorted_.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before)
    joined = sorted_.alias("a").join(runs.alias("b"), _same("a", "b", keys) & (F.col("a._part") == F.col("b._part")))
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"))


def at_levels(rows: DataFrame, level: str, ranks: DataFrame, value: str, keys: tuple[str, ...], name: str) -> DataFrame:
    """rows with the type-7 quantile, at each row's own level, of its key's values; ranks as `ranked` gives them."""
    n = ranks.groupBy(*keys).agg((F.max("rank") + 1).alias("_n"))
    rows = rows.join(n, list(keys)).withColumn("_at", F.col(level) * (F.col("_n") - 1).cast("double")).withColumn("_low", F.floor("_at"))
    rows = rows.withColumn("_high", F.least(F.col("_low") + 1, F.col("_n") - 1))
    for end in ("low", "high"):
        rows = rows.join(ranks.select(*keys, F.col("rank").alias(f"_{end}"), F.col(value).alias(f"_v{end}")), [*keys, f"_{end}"])
    q = F.col("_vlow") + (F.col("_vhigh") - F.col("_vlow")) * (F.col("_at") - F.col("_low"))
    return rows.withColumn(name, q).drop("_n", "_at", "_low", "_high", "_vlow", "_vhigh")


def quantiles(rows: DataFrame, value: str, prob: float, keys: tuple[str, ...], few: int = FEW) -> DataFrame:
    """keys and `quantile`: the exact type-7 quantile, equal to percentile, by selection.

    Each pass sketches the rows that are left (a mergeable sketch, partial aggregates only), takes the two points of its
    grid between which both neighbouring order statistics must lie, and counts; only the rows between them go
    on, about 4 in 1000. When at most `few` of each group are left, or all that are left are equal, the values
    are picked. The counts check every bracket: one that missed is widened to the whole rest."""
    rest = scratch.written(rows.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()), "values")
    out, asked = None, None
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    while True:
        g = rest.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", grid, ACCURACY).alias("grid"))
        if asked is None:
            at = (F.col("n") - 1) * stats.d(prob)
            g = g.withColumns({"at": at, "low": F.floor(at), "high": F.ceil(at)})
        else:
            g = g.alias("g").join(asked.alias("a"), _same("g", "a", keys)).select(*[f"g.{k}" for k in keys], "n", "grid", "at", "low", "high")
        point = lambda c, by: F.floor(F.col(c) / F.col("n") * GRID).cast("int") + by
        g = g.withColumns({"from": F.when(point("low", -1) >= 1, F.get("grid", point("low", -1))), "to": F.when(point("high", 2) < GRID, F.get("grid", point("high", 2)))}).drop("grid")
        g = scratch.written(g, "brackets")
        marked = rest.alias("r").join(g.alias("g"), _same("r", "g", keys)).select(*[f"r.{k}" for k in keys], "v", "from", "to")
        below, above = F.coalesce(F.col("v") < F.col("from"), F.lit(False)), F.coalesce(F.col("v") > F.col("to"), F.lit(False))
        counts = marked.groupBy(*keys).agg(F.count_if(below).alias("below"), F.count_if(~below & ~above).alias("inside"), F.min(F.when(~below & ~above, F.col("v"))).alias("least"), F.max(F.when(~below & ~above, F.col("v"))).alias("most"))
        c = counts.alias("c").join(g.alias("g"), _same("c", "g", keys)).select(*[f"g.{k}" for k in keys], "at", "low", "high", "from", "to", "below", "inside", "least", "most", "n")
        hit = (F.col("low") >= F.col("below")) & (F.col("high") < F.col("below") + F.col("inside"))
        c = c.withColumn("hit", hit)
        c = scratch.written(c.withColumns({k: F.when(F.col("hit"), F.col(k)) for k in ("from", "to")} | {"below": F.when(F.col("hit"), F.col("below")).otherwise(F.lit(0)), "inside": F.when(F.col("hit"), F.col("inside")).otherwise(F.col("n"))}), "counts")
        flat = c.filter("hit and least = most").select(*keys, F.col("least").alias("quantile"))
        out = flat if out is None else out.unionByName(flat)
        asked = c.filter("not (hit and least = most)").select(*keys, "at", (F.col("low") - F.col("below")).alias("low"), (F.col("high") - F.col("below")).alias("high"), "from", "to", "inside")
        inside = rest.alias("r").join(asked.alias("a"), _same("r", "a", keys)).filter("(a.from is null or v >= a.from) and (a.to is null or v <= a.to)")
        rest = scratch.written(inside.select(*[f"r.{k}" for k in keys], "v"), "inside")
        if asked.filter(F.col("inside") > few).isEmpty():
            break
        asked = asked.drop("from", "to", "inside")
    held = rest.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("s"))  # at most `few` values
    both = held.alias("h").join(asked.alias("a"), _same("h", "a", keys))
    a, b = F.get("s", F.col("low").cast("int")), F.get("s", F.col("high").cast("int"))
    # the fractions of Spark's percentile, from the rank in the whole group
    up, down = F.ceil("at") - F.col("at"), F.col("at") - F.floor("at")
    picked = both.select(*[f"h.{k}" for k in keys], F.when((F.col("low") == F.col("high")) | (a == b), a).otherwise(up * a + down * b).alias("quantile"))
    return out.unionByName(picked)


def cumulated(rows: DataFrame, order: list[Column], value: str, name: str = "running") -> DataFrame:
    """rows with the sum of `value` over all rows up to each in this order (which tells rows apart), over the whole
    table: summed within sorted ranges, ahead of which go the totals of the ranges before."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.written(sorted_, "sorted").withColumn("_part", F.shiftright("_at", 33))
    totals = sorted_.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row a part
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = sorted_.join(totals.select("_part", ahead.alias("_ahead")), "_part")
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(name, F.col("_ahead") + own).drop("_at", "_part", "_ahead")
