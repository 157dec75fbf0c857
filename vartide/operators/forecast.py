"""Quantile forecasts that windows express: each adds rows (model, asset, date, pos, r, q[, es])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import scan, sliding
from vartide.operators.returns import by_asset, exact


def trailing(window: int):
    """The `window` returns before the current one."""
    return by_asset().rowsBetween(-window, -1)


def hist_sim(returns: DataFrame, alpha: float = 0.01, window: int = 250, scale: float = 1.0, model: str = "hist_sim") -> DataFrame:
    """Historical simulation: the trailing quantile (type 7), 0 before the first return."""
    slid = sliding.sliding(returns.select("asset", "date", "pos", "r"), "r", window, (float(alpha),))
    q = F.coalesce(F.get("qs", F.lit(0)), stats.d(0))
    return slid.select(F.lit(model).alias("model"), "asset", "date", "pos", "r", exact(scale * q).alias("q"))


def rolling_normal(returns: DataFrame, alpha: float = 0.01, window: int = 250) -> DataFrame:
    """Trailing mean plus standard deviation times the normal quantile, with its expected shortfall."""
    w, z = trailing(window), stats.z_value(alpha)
    mean, sd = F.avg("r").over(w), F.coalesce(F.stddev_samp("r").over(w), stats.d(0))
    phi = 0.3989422804014327 * 2.718281828459045 ** (-z * z / 2)
    return returns.select(
        F.lit("norm_roll").alias("model"), "asset", "date", "pos", "r",
        exact(F.coalesce(mean + sd * z, stats.d(0))).alias("q"), exact(F.coalesce(mean - sd * (phi / alpha), stats.d(0))).alias("es"),
    )


def ewma(returns: DataFrame, alpha: float = 0.01, window: int = 250, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted volatility over a finite window, weights normalised, zero mean."""
    sq = F.collect_list(F.col("r") * F.col("r")).over(trailing(window))
    # oldest first: s <- decay * s + x folds the weights decay^age without powers that overflow
    zero = F.struct(stats.d(0).alias("s"), stats.d(0).alias("w"))
    var = F.aggregate(sq, zero, lambda a, x: F.struct((a["s"] * decay + x).alias("s"), (a["w"] * decay + 1.0).alias("w")), lambda a: F.try_divide(a["s"], a["w"]))
    q = F.coalesce(F.sqrt(var) * stats.z_value(alpha), stats.d(0))
    return returns.select(F.lit("ewma").alias("model"), "asset", "date", "pos", "r", exact(q).alias("q"))


def constant(returns: DataFrame, value: float = 0.0, model: str = "const_zero") -> DataFrame:
    return returns.select(F.lit(model).alias("model"), "asset", "date", "pos", "r", stats.d(value).alias("q"))


def standard_set(returns: DataFrame, alpha: float = 0.01, window: int = 250) -> DataFrame:
    """Five native models side by side, in one long table, from one sliding pass."""
    return levels_set(returns, (alpha,), window).drop("alpha")


def levels_set(returns: DataFrame, alphas: tuple[float, ...], window: int = 250) -> DataFrame:
    """The models of `standard_set` at several levels, with a column alpha: one sliding pass gives all quantiles,
    mean and deviation; the variants are arithmetic on one row."""
    w = trailing(window)
    slid = sliding.sliding(returns.select("asset", "date", "pos", "r"), "r", window, tuple(map(float, alphas)))
    base = slid.select("asset", "date", "pos", "r", "qs", F.avg("r").over(w).alias("m"), F.coalesce(F.stddev_samp("r").over(w), stats.d(0)).alias("s"))
    cells = []
    for k, a in enumerate(alphas):
        h = exact(F.coalesce(F.get("qs", F.lit(k)), stats.d(0)))
        normal = exact(F.coalesce(F.col("m") + F.col("s") * stats.z_value(a), stats.d(0)))
        variants = (("hist_sim", h), ("scaled_05", exact(h * 0.5)), ("scaled_12", exact(h * 1.2)), ("const_zero", stats.d(0)), ("norm_roll", normal))
        cells += [F.struct(F.lit(name).alias("model"), stats.d(a).alias("alpha"), v.alias("q")) for name, v in variants]
    return base.select("asset", "date", "pos", "r", F.explode(F.array(*cells)).alias("v")).select("v.model", "v.alpha", "asset", "date", "pos", "r", "v.q")


def recursive_vol(series: DataFrame, decay: float = 0.94, keys: tuple[str, ...] = ("asset",), chunk: int = scan.CHUNK) -> DataFrame:
    """keys, pos, r and `sigma`, the recursive EWMA volatility before each day (start: variance of the first 20)."""
    start = series.filter("pos < 20").groupBy(*keys).agg(F.var_pop("r").alias("start"))
    rows = scan.scan(series.select(*keys, "pos", "r"), scan.Affine(decay), "r", start, keys, "_v", chunk)
    return rows.select(*keys, "pos", "r", F.sqrt(F.greatest("_v", stats.d(1e-20))).alias("sigma"))


def next_return(forecasts: DataFrame, returns: DataFrame, days: int = 256) -> DataFrame:
    """Forward as-of join: each forecast with the first return strictly after its date (null if none).

    Both sides meet in one window by asset and stretch of `days`, from late to early, so no pairs are made and one asset's
    history spreads over tasks. Where a stretch has no later return, the first one of the next stretch that has any is
    taken: one row a stretch, looked up over the stretches alone."""
    stretch = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days)
    a = forecasts.select("asset", F.col("date"), F.lit(1).alias("side"), F.struct(*forecasts.columns).alias("f"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("date").alias("r_date"))
    b = returns.select("asset", F.col("date"), F.lit(0).alias("side"), F.lit(None).cast(a.schema["f"].dataType).alias("f"), "r", F.col("date").alias("r_date"))
    both = a.unionByName(b).withColumn("_stretch", stretch)
    # latest first; on one date the forecast precedes the return, which is not strictly after it
    w = Window.partitionBy("asset", "_stretch").orderBy(F.col("date").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.last(F.when(F.col("side") == 0, F.struct("r_date", "r")), ignorenulls=True).over(w)
    firsts = both.groupBy("asset", "_stretch").agg(F.min(F.when(F.col("side") == 0, F.struct("r_date", "r"))).alias("_own"))
    after = Window.partitionBy("asset").orderBy("_stretch").rowsBetween(1, Window.unboundedFollowing)
    later = firsts.select(F.col("asset").alias("_asset"), F.col("_stretch").alias("_at"), F.first("_own", ignorenulls=True).over(after).alias("_later"))
    met = both.withColumn("_next", ahead).filter("side = 1").join(later, F.col("asset").eqNullSafe(F.col("_asset")) & F.col("_stretch").eqNullSafe(F.col("_at")), "left")
    found = F.coalesce("_next", "_later")
    return met.select("f.*", found["r_date"].alias("next_date"), found["r"].alias("next_r"))
