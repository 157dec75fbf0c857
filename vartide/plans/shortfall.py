"""The static audit with expected shortfall, and backtests of shortfall by days and by its mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.functions import stats
from vartide.operators import conformal, inference
from vartide.plans import api, detail
from vartide.plans import report as R
from vartide.plans import sql as S
from vartide.plans.registry import ORACLE_SQL, Shape, query
from vartide.sources import panels

PAIR, ALPHA, W = conformal.PAIR, R.ALPHA, R.W
WARMUP = 50


def _z2(hit: str, es: str) -> str:
    return f"COALESCE(SUM(CASE WHEN {hit} THEN r + ABS({es}) END) / (SUM(CAST({hit} AS INT)) * (AVG(ABS({es})) + 1e-12::DOUBLE)), 0.0)"


def _fz(v: str, e: str) -> str:
    """The loss of the package form with v and e negative."""
    return f"AVG(CASE WHEN -{e} + 1e-12::DOUBLE > 0 THEN CAST(r < {v} AS DOUBLE) * ({v} - r) / ({ALPHA!r}::DOUBLE * {e}) + {v} / {e} - LN(-{e} + 1e-12::DOUBLE) - 1 END)"


_KEPT = f"nk AS (SELECT 'norm_roll' AS model, asset, date, pos - {W} AS pos, r, q, es FROM nr WHERE pos >= {W})"
_CARRIED = f"""{S.returns()},\n{S.rolling_normal(ALPHA, W)},\n{_KEPT},\n{S.parts(source="nk")},
{S.qv(where=f"pos < n_cal AND pos >= LEAST({WARMUP}, n_cal // 4)")},\n{S.TEST},
ct AS (SELECT *, es - (var_corr - var_raw) AS es2 FROM test),
cs AS (SELECT model, asset, {_z2("viol_raw = 1", "es")} AS z2_raw, {_z2("viol_corr = 1", "es2")} AS z2_corr, {_fz("q", "es")} AS fz_raw, {_fz("(-var_corr)", "es2")} AS fz_corr FROM ct GROUP BY ALL),
{S.backtest()}"""


@query(
    Shape("model asset regime zone_raw zone_corr", "n_test viol_raw viol_corr", "q_v ratio pi_raw pi_corr kupiec_p_corr cc_p_corr z2_raw z2_corr qs_raw qs_corr fz_raw fz_corr", 6),
    _CARRIED, "(SELECT * FROM bt JOIN cs USING (model, asset))",
)
def audit_with_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static audit of forecasts that carry a shortfall: it moves with the Value-at-Risk; Z2 and the joint loss of
    both, before and after."""
    returns = panels.panel(spark, sf_dir)
    return api.audit(returns, forecaster=_full_windows, alpha=ALPHA, window=W, warmup=WARMUP)


def _full_windows(returns: DataFrame, alpha: float, window: int) -> DataFrame:
    from vartide.operators import forecast

    rows = forecast.rolling_normal(returns, alpha, window).filter(F.col("pos") >= window)
    return rows.withColumn("pos", F.col("pos") - window)


@query(Shape("model asset regime", "n_test", "q_v q_lo q_hi z2_corr fz_corr", 6))
def audit_with_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the bootstrap interval of the correction, from a seed."""
    return api.audit(panels.panel(spark, sf_dir), forecaster=_full_windows, alpha=ALPHA, window=W, warmup=WARMUP, interval=True, seed=7)


#: Fixed values of the reports: a day-by-day Z2 passes above the first, one by mean shortfall from the second on.
PASS_DAILY, PASS_MEAN = -0.7, -1.96


def z2_forms(rows: DataFrame, es_level: float = detail._ES_LEVEL, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys and, before and after correction, Z2 with each day's own shortfall and with the mean one, 1 at best; and
    whether they pass. rows: r, q, es (negative), var_corr, es_corr (positive)."""
    out, n = [F.count("*").alias("n")], F.count("*") * stats.d(es_level)
    for name, v, e in (("raw", -F.col("q"), -F.col("es")), ("corr", F.col("var_corr"), F.col("es_corr"))):
        hit = F.coalesce(F.col("r") < -v, F.lit(False))
        daily = F.sum(F.when(hit, F.col("r") / F.when(e == 0, 1e-10).otherwise(e)).otherwise(0.0)) / n + 1
        mean = F.avg(-e)
        out += [daily.alias(f"z2_day_{name}"), F.when(mean != 0, F.sum(F.when(hit, F.col("r")).otherwise(0.0)) / (n * mean) + 1).alias(f"z2_mean_{name}")]
    g = rows.groupBy(*keys).agg(*out)
    passes = {f"pass_day_{s}": (F.col(f"z2_day_{s}") > PASS_DAILY).cast("int") for s in ("raw", "corr")}
    return g.withColumns(passes | {f"pass_mean_{s}": (F.col(f"z2_mean_{s}") >= PASS_MEAN).cast("int") for s in ("raw", "corr")})


def _forms(name: str, v: str, e: str) -> str:
    n = f"(COUNT(*) * {detail._ES_LEVEL!r}::DOUBLE)"
    return f"SUM(CASE WHEN r < -({v}) THEN r / CASE WHEN {e} = 0 THEN 1e-10::DOUBLE ELSE {e} END ELSE 0 END) / {n} + 1 AS z2_day_{name}, SUM(CASE WHEN r < -({v}) THEN r ELSE 0 END) / ({n} * AVG(-({e}))) + 1 AS z2_mean_{name}"


_DETAIL = ORACLE_SQL["var_es_detail"].split("WITH ", 1)[1].rsplit("\nSELECT ", 1)[0]


@query(
    Shape("asset", "n pass_day_raw pass_day_corr pass_mean_raw pass_mean_corr", "z2_day_raw z2_day_corr z2_mean_raw z2_mean_corr", 6),
    f"{_DETAIL}, zf AS (SELECT asset, COUNT(*) AS n, {_forms('raw', '-q', '(-es)')}, {_forms('corr', 'q_v - q', '(q_e - es)')} FROM parts JOIN qe USING (asset) WHERE pos >= parts.n_cal GROUP BY asset)",
    f"(SELECT *, z2_day_raw > {PASS_DAILY} AS pass_day_raw, z2_day_corr > {PASS_DAILY} AS pass_day_corr, z2_mean_raw >= {PASS_MEAN} AS pass_mean_raw, z2_mean_corr >= {PASS_MEAN} AS pass_mean_corr FROM zf)",
)
def shortfall_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z2 by days and by the mean, before and after the hybrid corrections, with the reports' limits."""
    return z2_forms(conformal.var_es_correction(R._es_parts(spark, sf_dir), ALPHA, detail._ES_LEVEL), keys=("asset",))


@query(Shape("model_a model_b", "n lags", "dm p_normal p_student", 6))
def panel_dm_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel comparison under Student's law with one degree less than days, beside the normal one."""
    pairs = inference.loss_pairs(R._losses(R._test_rows(spark, sf_dir, "c", R.WC)))
    rows = inference.hac_dm(inference.tail_aligned(pairs), bandwidth="rule").withColumnRenamed("p_value", "p_normal").withColumn("dof", F.col("n") - 1.0)
    return inference.t_p_value(rows, "dm", "dof").withColumnRenamed("p_value", "p_student")


@query(Shape("asset", "n_before n_after", "t p_value welch_t welch_df welch_p", 6))
def before_after_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sample tests of `before_after` with their p-values."""
    rows = detail.before_after(spark, sf_dir).withColumn("dof", (F.col("n_before") + F.col("n_after") - 2).cast("double"))
    return inference.t_p_value(inference.t_p_value(rows, "t", "dof").drop("dof").withColumnRenamed("p_value", "p"), "welch_t", "welch_df").withColumnsRenamed({"p_value": "welch_p", "p": "p_value"})
