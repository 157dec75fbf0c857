"""Recalibration methods: fitted on the calibration part of each pair, applied to its test part.

Each `fit_*` returns a short table keyed by (model, asset); `apply` turns it into a corrected column. All of
these are native expressions; methods that need an optimiser live in `vartide.operators.fit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vartide.functions import stats
from vartide.operators import ranks, scan
from vartide.operators.conformal import PAIR, corrected, fit_static
from vartide.sources import scratch


def fit_shift(parts: DataFrame, alpha: float = 0.01) -> DataFrame:
    return fit_static(parts, alpha).select(*PAIR, F.lit("shift").alias("method"), F.col("q_v").alias("param"))


def fit_hist_quantile(parts: DataFrame, alpha: float = 0.01) -> DataFrame:
    """The unconditional quantile of calibration returns, as a constant forecast."""
    return parts.filter("role = 'cal'").groupBy(*PAIR).agg((-F.percentile("r", F.lit(float(alpha)))).alias("param")).select(*PAIR, F.lit("hist_quantile").alias("method"), "param")


def fit_scale(parts: DataFrame, alpha: float = 0.01) -> DataFrame:
    """alpha over the calibration violation rate; 1 where nothing was violated."""
    rate = F.avg(F.coalesce(F.col("r") < F.col("q"), F.lit(False)).cast("double"))
    g = parts.filter("role = 'cal'").groupBy(*PAIR).agg(rate.alias("_rate"))
    return g.select(*PAIR, F.lit("scale").alias("method"), F.when(F.col("_rate") > 0, alpha / F.when(F.col("_rate") > 0, F.col("_rate"))).otherwise(stats.d(1)).alias("param"))


def _adaptive(alpha: float, gamma: float) -> scan.ClippedShift:
    return scan.ClippedShift(gamma, alpha, 1e-6, 1 - 1e-6)


def _violations(parts: DataFrame, role: str) -> DataFrame:
    """model, asset, pos (from 0), score and v of one part."""
    rows = parts.filter(F.col("role") == role)
    return rows.select(*PAIR, "pos", "score", (F.col("r") < F.col("q")).cast("double").alias("v"))


def fit_aci(parts: DataFrame, alpha: float = 0.01, gamma: float = 0.05, chunk: int = scan.CHUNK) -> DataFrame:
    """Adaptive conformal inference: the level moves with each violation (a scan of clipped shifts), the correction is
    the score quantile at the last level."""
    cal = _violations(parts, "cal")
    start = cal.groupBy(*PAIR).agg(_start(alpha))
    last = scan.last_states(cal, _adaptive(alpha, gamma), "v", start, PAIR, "level", chunk)
    s = cal.groupBy(*PAIR).agg(F.array_sort(F.collect_list("score")).alias("s"))
    return s.join(last, list(PAIR)).select(*PAIR, F.lit("aci").alias("method"), stats.lerp_sorted(F.col("s"), 1.0 - F.col("level")).alias("param"))


def _start(alpha: float) -> Column:
    return F.first(stats.d(alpha)).alias("start")


def aci_path(parts: DataFrame, alpha: float = 0.01, gamma: float = 0.05, chunk: int = scan.CHUNK) -> DataFrame:
    """model, asset, pos, score, level and q_t of adaptive inference run over the test part: the level of a day
    follows the raw violations before it, q_t is that quantile of all test scores."""
    test = scratch.written(_violations(parts, "test"), "test")
    start = test.groupBy(*PAIR).agg(_start(alpha))
    rows = scan.scan(test, _adaptive(alpha, gamma), "v", start, PAIR, "level", chunk).withColumn("upper", 1.0 - F.col("level"))
    sorted_ = scratch.written(ranks.ranked(test.select(*PAIR, "pos", "score"), "score", PAIR), "ranks")
    return ranks.at_levels(rows, "upper", sorted_, "score", PAIR, "q_t").select(*PAIR, "pos", "score", "level", "q_t")


def fit_fhs(parts: DataFrame, alpha: float = 0.01, decay: float = 0.94, chunk: int = scan.CHUNK) -> DataFrame:
    """Filtered historical simulation: mean volatility times the quantile of standardised returns, relative to
    the mean size of the raw forecast."""
    from vartide.operators.forecast import recursive_vol

    cal = parts.filter("role = 'cal'")
    vol = recursive_vol(cal.select(*PAIR, "pos", "r"), decay, PAIR, chunk)
    std = vol.groupBy(*PAIR).agg(F.avg("sigma").alias("_sigma"), F.count("*").alias("_n"), F.percentile(F.col("r") / F.col("sigma"), F.lit(float(alpha))).alias("_z"))
    size = cal.groupBy(*PAIR).agg(F.avg(F.abs("q")).alias("_size"))
    factor = -F.col("_sigma") * F.col("_z") / F.when(F.col("_size") > 1e-12, F.col("_size"))
    return std.join(size, list(PAIR)).select(*PAIR, F.lit("fhs").alias("method"), F.when(F.col("_n") < 20, stats.d(1)).otherwise(F.coalesce(factor, stats.d(1))).alias("param"))


def fit_all(parts: DataFrame, alpha: float = 0.01) -> DataFrame:
    out = fit_shift(parts, alpha)
    for f in (fit_hist_quantile, fit_scale, fit_aci, fit_fhs):
        out = out.unionByName(f(parts, alpha))
    return out


def apply(parts: DataFrame, params: DataFrame) -> DataFrame:
    """Test rows by method with var_raw, var_corr and violations."""
    test = parts.filter("role = 'test'").join(params, list(PAIR)).withColumn("var_raw", -F.col("q"))
    kind, p, v = F.col("method"), F.col("param"), F.col("var_raw")
    value = F.when(kind.isin("shift", "aci"), v + p).when(kind == "hist_quantile", p).when(kind == "scale", v * p).when(kind == "fhs", F.abs(v) * p)
    return corrected(test.withColumn("var_corr", value))
