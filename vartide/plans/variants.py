"""Queries of further forms: gaps by correlation, longer horizons, rates side by side, carried shortfall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.operators import conformal, fit, inference
from vartide.plans import report as R
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.plans.report import ALPHA, PAIR, W

PARTS = f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}"


@query(
    Shape("model asset", "gap n_test viol_corr", "rho pi_corr", 7),
    f"""{PARTS},
lg AS (SELECT model, asset, n, score, LAG(score) OVER (PARTITION BY model, asset ORDER BY pos) AS before FROM parts WHERE pos < n_cal),
rh AS (SELECT model, asset, MAX(n) AS n, COALESCE(CORR(score, before), 0.0::DOUBLE) AS rho FROM lg GROUP BY ALL),
gp AS (SELECT model, asset, rho, CAST(CEIL(LN(n::DOUBLE) / ABS(LN(GREATEST(0.01::DOUBLE, LEAST(0.99::DOUBLE, ABS(rho)))))) AS INT) AS gap FROM rh)""",
    "(SELECT model, asset, ANY_VALUE(gap) AS gap, COUNT(*) AS n_test, SUM(viol_corr) AS viol_corr, ANY_VALUE(rho) AS rho, AVG(viol_corr) AS pi_corr FROM test JOIN gp USING (model, asset) WHERE pos >= n_cal + gap GROUP BY ALL)",
)
def gap_by_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap between calibration and test from each pair's own correlation of scores."""
    parts = conformal.split_paths(R.paths(spark, sf_dir))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA)).join(conformal.mixing_gap(parts), list(PAIR)).filter(F.col("pos") >= F.col("n_cal") + F.col("gap"))
    return test.groupBy(*PAIR).agg(F.first("gap").alias("gap"), F.first("rho").alias("rho"), F.count("*").alias("n_test"), F.sum("viol_corr").alias("viol_corr"), F.avg("viol_corr").alias("pi_corr"))


HORIZON = 5
_LAGS = ", ".join(f"AVG(e * LAG_{k}) AS g{k}" for k in range(1, HORIZON))
_LAGGED = ", ".join(f"LAG(e, {k}) OVER (PARTITION BY model_a, model_b, asset ORDER BY pos) AS LAG_{k}" for k in range(1, HORIZON))
_SPREAD = " + ".join(["g0", *(f"2.0::DOUBLE * {1 - k / HORIZON!r}::DOUBLE * COALESCE(g{k}, 0.0)" for k in range(1, HORIZON))])


@query(
    Shape("model_a model_b asset", "n", "mean_diff dm p_value", 6),
    f"""{PARTS}, {R.PAIRS_CTE},
ce AS (SELECT *, diff - AVG(diff) OVER (PARTITION BY model_a, model_b, asset) AS e FROM pr),
la AS (SELECT *, {_LAGGED} FROM ce),
ag AS (SELECT model_a, model_b, asset, COUNT(*) AS n, AVG(diff) AS mean_diff, AVG(e * e) AS g0, {_LAGS} FROM la GROUP BY ALL),
dm AS (SELECT *, mean_diff / SQRT(GREATEST({_SPREAD}, 1e-20::DOUBLE) / n) * SQRT(GREATEST(n + 1 - {2 * HORIZON} + {HORIZON * (HORIZON - 1)}::DOUBLE / n, 0.0::DOUBLE) / n) AS dm FROM ag)""",
    f"(SELECT *, {S.two_sided_p('dm')} AS p_value FROM dm)",
)
def dm_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of every pair as if forecasts reached HORIZON days ahead."""
    return inference.diebold_mariano_ahead(inference.loss_pairs(R._losses(R._test_rows(spark, sf_dir, "a", W))), HORIZON)


NAMES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low", "4-NOT SPECIFIED": "not_specified"}
_RATES = ", ".join(f"MAX(CASE WHEN asset = '{a}' THEN viol_corr::DOUBLE / n_test END) AS pi_{s}" for a, s in NAMES.items())


@query(
    Shape("model", "n_assets x n", "pi kupiec_p " + " ".join(f"pi_{s}" for s in NAMES.values()), 7),
    f"{R.AUDIT_CTES}, po AS {R._pooled_sql('model', 'bt')}, wi AS (SELECT model, {_RATES} FROM bt GROUP BY model)",
    "(SELECT * FROM po JOIN wi USING (model))",
)
def panel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled coverage test beside each asset's own rate."""
    facts = conformal.static_audit(R.paths(spark, sf_dir), ALPHA)
    return inference.pooled_kupiec(facts, ALPHA).join(inference.wide_rates(facts, NAMES), "model")


@query(
    Shape("asset", "n", "q_v var_raw var_corr es_raw es_corr", 7),
    f"""{S.returns()}, {S.rolling_normal(ALPHA, W)}, na AS (SELECT 'norm_roll' AS model, asset, date, r, q, es, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY date) - 1 AS pos FROM nr WHERE pos >= {W} AND es < 0),
{S.parts(source='na')}, {S.qv()}, {S.TEST}""",
    "(SELECT asset, COUNT(*) AS n, ANY_VALUE(q_v) AS q_v, AVG(var_raw) AS var_raw, AVG(var_corr) AS var_corr, AVG(-es) AS es_raw, AVG(-es + (var_corr - var_raw)) AS es_corr FROM test GROUP BY asset)",
)
def carried_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected shortfall moved along with the Value-at-Risk it belongs to."""
    parts = R._es_parts(spark, sf_dir)
    test = conformal.carry_shortfall(conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA)))
    return test.groupBy("asset").agg(
        F.count("*").alias("n"), F.first("q_v").alias("q_v"), F.avg("var_raw").alias("var_raw"), F.avg("var_corr").alias("var_corr"), F.avg(-F.col("es")).alias("es_raw"), F.avg("es_corr").alias("es_corr"),
    )


@query(Shape("model asset regime", "", "q_v q_lo q_hi q_se ratio", 6))
def bootstrap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of corrections from 1000 draws of blocks of 50 days on average; replaced where the ratio is over 1.5."""
    p = R.paths(spark, sf_dir)
    ci = fit.bootstrap_ci(conformal.split_paths(p), ALPHA, draws=1000, mean_block=50.0)
    ratio = conformal.static_audit(p, ALPHA).select(*PAIR, "ratio")
    return ci.join(ratio, list(PAIR)).withColumn("regime", F.when(F.col("ratio") > 1.5, "replacement").otherwise("signal-preserving"))
