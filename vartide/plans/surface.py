"""Queries that are SQL from end to end, with the functions of `functions.surface`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vartide.functions import surface
from vartide.plans import report as R
from vartide.plans.registry import Shape, query

ALPHA, W = R.ALPHA, R.W

#: Forecasts by historical simulation and their scores, from the table of orders.
PATHS = f"""
px AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS p FROM parquet.`{{folder}}/orders.parquet` GROUP BY ALL),
lr AS (SELECT asset, date, CAST(CAST(LN(p / LAG(p) OVER (PARTITION BY asset ORDER BY date)) AS DECIMAL(18,12)) AS DOUBLE) AS r FROM px),
ret AS (SELECT asset, date, r, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY date) - 1 AS pos FROM lr WHERE r IS NOT NULL),
path AS (SELECT 'hist_sim' AS model, *, CAST(CAST(COALESCE(PERCENTILE(r, {ALPHA}D) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING), 0.0D) AS DECIMAL(18,12)) AS DOUBLE) AS q FROM ret),
parts AS (SELECT *, q - r AS score, CAST(FLOOR(COUNT(*) OVER (PARTITION BY asset) * 0.7D) AS INT) AS n_cal FROM path)"""


@query(
    Shape("model asset zone zone_report regime", "n x", "q_v lr p lr_ind p_ind p_cc qs", 7),
    f"{R.AUDIT_CTES}",
    "(SELECT model, asset, zone_corr AS zone, zone_report_corr AS zone_report, regime, n_test AS n, viol_corr AS x, q_v, kupiec_lr_corr AS lr, kupiec_p_corr AS p, lr_ind_corr AS lr_ind, ind_p_corr AS p_ind, cc_p_corr AS p_cc, qs_corr AS qs FROM bt WHERE model = 'hist_sim')",
)
def sql_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static audit of historical simulation, every step in SQL."""
    surface.register(spark)
    return spark.sql(f"""WITH {PATHS.format(folder=sf_dir)},
qv AS (SELECT model, asset, PERCENTILE(score, {1 - ALPHA}D) AS q_v FROM parts WHERE pos < n_cal GROUP BY ALL),
test AS (SELECT t.model, t.asset, t.pos, r, q_v, q, -q + q_v AS var_corr, CAST(r < q - q_v AS INT) AS v FROM parts t JOIN qv ON t.asset = qv.asset WHERE pos >= n_cal),
mk AS (SELECT *, LAG(v) OVER (PARTITION BY model, asset ORDER BY pos) AS before, ROW_NUMBER() OVER (PARTITION BY model, asset ORDER BY pos DESC) AS age FROM test),
ag AS (SELECT model, asset, COUNT(*) AS n, FIRST(q_v) AS q_v, SUM(v) AS x, SUM(CASE WHEN age <= 250 THEN v END) AS recent, AVG(ABS(q)) AS width, AVG(va_pinball(r, -var_corr, {ALPHA}D)) AS qs,
  COALESCE(COUNT_IF(before = 0 AND v = 0), 0) AS n00, COUNT_IF(before = 0 AND v = 1) AS n01, COUNT_IF(before = 1 AND v = 0) AS n10, COUNT_IF(before = 1 AND v = 1) AS n11 FROM mk GROUP BY model, asset),
te AS (SELECT *, va_kupiec_lr(x, n, {ALPHA}D) AS lr, va_transition_lr(n00, n01, n10, n11) AS lr_ind FROM ag)
SELECT model, asset, n, x, q_v, lr, va_kupiec_p(x, n, {ALPHA}D) AS p, lr_ind, va_chi2_sf1(lr_ind) AS p_ind, va_chi2_sf2(lr + lr_ind) AS p_cc, qs,
  va_basel_zone(recent, LEAST(n, 250)) AS zone, va_basel_zone_report(x, n) AS zone_report, va_regime(q_v, width) AS regime FROM te""")


@query(Shape("model asset", "", "q_v q_lo q_hi q_se", 6))
def sql_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of each asset's correction, by the table function over partitions."""
    surface.register(spark)
    return spark.sql(f"""WITH {PATHS.format(folder=sf_dir)}, cal AS (SELECT model, asset, pos, score FROM parts WHERE pos < n_cal)
SELECT * FROM va_bootstrap(TABLE(SELECT * FROM cal) PARTITION BY (model, asset) ORDER BY (pos), {ALPHA}D, 999, 20D, 2026)""")
