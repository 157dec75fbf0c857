"""The verbs of an audit: audit, classify_regime, compare, audit_panel. Each takes and returns DataFrames, all
pairs of model and asset at once; nothing runs before an action."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import conformal, fit, forecast, inference, recalibrate

#: Forecasters by name: returns, alpha, window -> path.
FORECASTERS: dict[str, Callable[[DataFrame, float, int], DataFrame]] = {
    "hist_sim": lambda r, a, w: forecast.hist_sim(r, a, w),
    "norm_roll": lambda r, a, w: forecast.rolling_normal(r, a, w),
    "ewma": lambda r, a, w: forecast.ewma(r, a, w),
    "gjr_garch": lambda r, a, w: fit.gjr_garch(r, a, w),
    "garch": lambda r, a, w: fit.gjr_garch(r, a, w, leverage=False),
    "gjr_skewed_t": lambda r, a, w: fit.gjr_garch(r, a, w, innovations="skewed_t"),
    "fhs_daily": lambda r, a, w: fit.tail_forecasts(r, a, w).filter("model = 'fhs'"),
    "evt_pot_daily": lambda r, a, w: fit.tail_forecasts(r, a, w).filter("model = 'evt_pot'"),
}


#: Recalibration methods by name. Closed forms are fitted as short tables, the others in grouped tasks.
CLOSED = {"shift": recalibrate.fit_shift, "hist_quantile": recalibrate.fit_hist_quantile, "scale": recalibrate.fit_scale, "aci": recalibrate.fit_aci, "fhs": recalibrate.fit_fhs}
FITTED = ("linear_qr", "isotonic", "evt_pot", "gbm_qr", "skew_t")
#: One of these names, or a function of parts (model, asset, pos, r, q, role) and alpha that returns the test rows
#: with var_raw and var_corr.
Recalibration = str | Callable[[DataFrame, float], DataFrame]


def recalibrated(parts: DataFrame, alpha: float, recalibration: Recalibration) -> DataFrame:
    """Test rows corrected by a method that was fitted on the calibration rows."""
    if callable(recalibration):
        rows = recalibration(parts, alpha)
    elif recalibration in CLOSED:
        rows = recalibrate.apply(parts, CLOSED[recalibration](parts, alpha))
    elif recalibration in FITTED:
        rows = fit.recalibrate(parts, alpha, (recalibration,))
    else:
        raise ValueError(f"unknown recalibration {recalibration!r}")
    # the size of the correction stands in for the shift, so that regimes compare alike
    shift = F.avg(F.col("var_corr") - F.col("var_raw")).over(Window.partitionBy(*conformal.PAIR))
    return conformal.corrected(rows.withColumn("q_v", shift))


def audit(
    returns: DataFrame, forecasts: DataFrame | None = None, forecaster: str | Callable | None = None, mode: str = "static", alpha: float = 0.01, split: float = 0.7, window: int = 250, warmup: int = 50,
    recalibration: Recalibration | None = None, interval: bool = False, seed: int = 2026,
) -> DataFrame:
    """One row per pair. Forecasts that carry a shortfall (es, negative) get Z2 and the joint loss before and after, the
    shortfall moving with the Value-at-Risk; `interval` adds the bootstrap interval of a static shift, from `seed`. Exactly one of `forecasts` (model, asset, date, q) and `forecaster` (a name, or a function
    of returns, alpha, window); mode is static or rolling. With a forecaster, `recalibration` replaces the
    conformal shift: fitted on the calibration part, in rolling mode on the first `window` days."""
    if (forecasts is None) == (forecaster is None):
        raise ValueError("give exactly one of forecasts and forecaster")
    if mode not in ("static", "rolling"):
        raise ValueError(f"unknown mode {mode!r}")
    if recalibration is not None and forecasts is not None:
        raise ValueError("recalibration needs a forecaster")
    if forecasts is not None:
        path, warmup = conformal.align(returns, forecasts), 0
    else:
        path = (FORECASTERS[forecaster] if isinstance(forecaster, str) else forecaster)(returns, alpha, window)
    if interval and (mode != "static" or recalibration is not None):
        raise ValueError("an interval belongs to the static shift")
    if recalibration is None and mode == "static":
        parts = conformal.split_paths(path, split, warmup)
        test = conformal.apply_shift(parts, conformal.fit_static(parts, alpha))
        if "es" in path.columns:
            out = conformal.backtest(conformal.carry_shortfall(test), alpha, more=conformal.shortfall_measures(alpha))
        else:
            out = conformal.backtest(test, alpha)
        return out.join(fit.bootstrap_ci(parts, alpha, seed=seed).select("model", "asset", "q_lo", "q_hi"), ["model", "asset"]) if interval else out
    if recalibration is None:
        return conformal.rolling_audit(path, alpha, window, warmup)
    if mode == "static":
        parts = conformal.split_paths(path, split, warmup)
    else:
        kept = path.filter(F.col("pos") >= warmup).withColumn("pos", F.col("pos") - warmup)
        parts = conformal.split_paths(kept).withColumns({"n_cal": F.lit(window), "role": F.when(F.col("pos") < window, "cal").otherwise("test")})
    return conformal.backtest(recalibrated(parts, alpha, recalibration), alpha)


def classify_regime(path: DataFrame, mode: str = "static", alpha: float = 0.01, window: int = 250, persistence: int = 20) -> DataFrame:
    """model, asset, regime, ratio, an interval and the zone after correction: a bootstrap interval of the
    correction in static mode, mean +- 1.96 deviations of it in rolling mode."""
    if mode == "static":
        ci = fit.bootstrap_ci(conformal.split_paths(path), alpha).select("model", "asset", "q_lo", "q_hi")
        return conformal.static_audit(path, alpha).select("model", "asset", "regime", "ratio", F.col("zone_corr").alias("zone")).join(ci, ["model", "asset"])
    rows = conformal.rolling_audit(path, alpha, window, 0, persistence)
    return rows.select(
        "model", "asset", "regime", F.col("r_mean").alias("ratio"), F.col("zone_corr").alias("zone"), (F.col("q_v_mean") - 1.96 * F.col("q_v_std")).alias("q_lo"), (F.col("q_v_mean") + 1.96 * F.col("q_v_std")).alias("q_hi"),
        F.col("max_run").alias("persistence_days"),
    )


def losses(path: DataFrame, alpha: float = 0.01, split: float = 0.7) -> DataFrame:
    """model, asset, pos (from the first test day), loss of the corrected forecasts."""
    parts = conformal.split_paths(path, split)
    test = conformal.apply_shift(parts, conformal.fit_static(parts, alpha))
    return test.select("model", "asset", (F.col("pos") - F.col("n_cal")).alias("pos"), stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(alpha)).alias("loss"))


def compare(path: DataFrame, alpha: float = 0.01, split: float = 0.7) -> DataFrame:
    """Diebold-Mariano tests of all pairs of models per asset, rows aligned from the first test day."""
    return inference.diebold_mariano(inference.loss_pairs(losses(path, alpha, split)))


def p_value_matrix(tests: DataFrame) -> DataFrame:
    """model_a by model_b."""
    return tests.groupBy("model_a").pivot("model_b").agg(F.first("p_value")).orderBy("model_a")


def audit_panel(returns: DataFrame, forecasters: list[str | Callable], alpha: float = 0.01, window: int = 250, split: float = 0.7) -> DataFrame:
    """The master table of every forecaster and asset."""
    path = None
    for f in forecasters:
        one = (FORECASTERS[f] if isinstance(f, str) else f)(returns, alpha, window)
        one = one.drop("es")
        path = one if path is None else path.unionByName(one, allowMissingColumns=True)
    return conformal.static_audit(path, alpha, split)


def with_benchmarks(path: DataFrame, returns: DataFrame, alpha: float = 0.01, window: int = 250) -> DataFrame:
    """Tests of a path beside historical simulation and GJR-GARCH, raw and under each closed-form recalibration
    (`model + method`)."""
    every = path.select("model", "asset", "date", "pos", "r", "q")
    for name in ("hist_sim", "gjr_garch"):
        every = every.unionByName(FORECASTERS[name](returns, alpha, window))
    parts = conformal.split_paths(every)
    rows = recalibrate.apply(parts, recalibrate.fit_all(parts, alpha)).withColumn("model", F.concat_ws(" + ", "model", "method"))
    return conformal.backtest(rows.withColumn("q_v", F.col("param")), alpha)


def regime_summary(master: DataFrame) -> DataFrame:
    """Per model: pairs by regime and zone, and the replaced share."""
    n = lambda c: F.sum(c.cast("int"))
    return master.groupBy("model").agg(
        F.count("*").alias("pairs"), n(F.col("regime") == "replacement").alias("replacement"), n(F.col("regime") == "signal-preserving").alias("preserving"),
        n(F.col("zone_corr") == "green").alias("green"), n(F.col("zone_corr") == "yellow").alias("yellow"), n(F.col("zone_corr") == "red").alias("red"), F.avg((F.col("regime") == "replacement").cast("double")).alias("replaced_share"),
    )
