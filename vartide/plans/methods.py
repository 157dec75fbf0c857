"""Every baseline of the comparison of recalibration methods, pair by pair and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.functions import stats
from vartide.operators import conformal, fit, recalibrate
from vartide.plans import detail
from vartide.plans import report as R
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.sources import scratch

PAIR, ALPHA, W = conformal.PAIR, R.ALPHA, R.W
#: Methods in the order of the table.
NATIVE = ("raw", "conformal", "scale", "hist_quantile", "isotonic", "rolling", "aci", "fhs")
FITTED = ("linear_qr", "gbm_qr", "skew_t", "evt_pot")


def native_rows(paths: DataFrame, alpha: float = ALPHA, window: int = W) -> DataFrame:
    """Test rows (model, asset, pos, method, r, var_corr) of the eight methods that are Spark's alone; `conformal` takes the
    order statistic, `rolling` the scores of the `window` days before each test day."""
    paths = scratch.written(paths, "paths")  # read once for each method
    parts = scratch.written(conformal.split_paths(paths), "parts")
    rolled = conformal.rolling_qv(paths, alpha, window).join(parts.filter("role = 'test'").select(*PAIR, "pos"), [*PAIR, "pos"])
    names = [*PAIR, "pos", "method", "r", "var_corr"]
    closed = conformal.fit_static(parts, alpha, "order").select(*PAIR, F.lit("shift").alias("method"), F.col("q_v").alias("param"))
    for f in (recalibrate.fit_scale, recalibrate.fit_hist_quantile, recalibrate.fit_aci, recalibrate.fit_fhs):
        closed = closed.unionByName(f(parts, alpha))
    rows = recalibrate.apply(parts, scratch.written(closed, "params")).withColumn("method", F.when(F.col("method") == "shift", "conformal").otherwise(F.col("method"))).select(*names)
    raw = parts.filter("role = 'test'").select(*PAIR, "pos", F.lit("raw").alias("method"), "r", (-F.col("q")).alias("var_corr"))
    days = rolled.select(*PAIR, "pos", F.lit("rolling").alias("method"), "r", (F.col("q_v") - F.col("q")).alias("var_corr"))
    return rows.unionByName(raw).unionByName(days).unionByName(fit.isotonic_rows(parts, alpha).select(*names))


def fitted_rows(paths: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same of the four methods that are fitted in grouped tasks."""
    return fit.recalibrate(conformal.split_paths(paths), alpha, FITTED).select(*PAIR, "pos", "method", "r", "var_corr")


def table(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per pair and method: days, violations, rate, coverage test, zone, score and width."""
    hit, a = F.coalesce(F.col("r") < -F.col("var_corr"), F.lit(False)).cast("int"), stats.d(alpha)
    qs = stats.pinball(F.col("r"), -F.col("var_corr"), a)
    g = rows.groupBy(*PAIR, "method").agg(F.count("*").alias("n"), F.sum(hit).alias("x"), F.avg(F.abs("var_corr")).alias("width"), F.avg(qs).alias("qs"))
    x, n = F.col("x"), F.col("n")
    exact = F.when((x == 0) | (x == n), stats.binomial_two_sided(x, n, a)).otherwise(stats.chi2_sf1(stats.kupiec_lr(x, n, a)))
    yearly = x * 250.0 / n
    zone = F.when(yearly <= 4, "Green").when(yearly <= 9, "Yellow").otherwise("Red")
    return g.select("*", (x / n).alias("pi"), exact.alias("p"), zone.alias("zone"))


def summary(pairs: DataFrame) -> DataFrame:
    """One row a method: mean rate, rejected pairs, share in the green zone, mean score and width."""
    n = lambda c: F.sum(c.cast("int"))
    return pairs.groupBy("method").agg(
        F.count("*").alias("pairs"), n(F.col("p") <= 0.05).alias("rejected"), n(F.col("zone") == "Green").alias("green"),
        F.avg("pi").alias("mean_pi"), F.avg("qs").alias("qs"), F.avg("width").alias("width"), (100 * F.avg((F.col("zone") == "Green").cast("double"))).alias("green_pct"),
    )


def pivot(pairs: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Models by methods: the share of assets in the green zone, in percent."""
    return pairs.groupBy("model").pivot("method", list(methods)).agg(100 * F.avg((F.col("zone") == "Green").cast("double")))


_ISOTONIC = """il AS (SELECT model, asset, q AS x, COUNT(*)::DOUBLE AS w, SUM(CAST(r < q AS INT))::DOUBLE AS t FROM parts WHERE pos < n_cal GROUP BY ALL),
ic AS (SELECT *, SUM(w) OVER o AS cw, SUM(t) OVER o AS ct, ROW_NUMBER() OVER o AS k FROM il WINDOW o AS (PARTITION BY model, asset ORDER BY x)),
ip AS (SELECT a.model, a.asset, a.k AS a, b.k AS b, b.x, (b.ct - (a.ct - a.t)) / (b.cw - (a.cw - a.w)) AS v FROM ic a JOIN ic b ON a.model = b.model AND a.asset = b.asset AND b.k >= a.k),
im AS (SELECT model, asset, b, x, MIN(v) OVER (PARTITION BY model, asset, a ORDER BY b DESC) AS m FROM ip),
fi AS (SELECT model, asset, x, MAX(m) AS p FROM im GROUP BY ALL),
ib AS (SELECT t.*, f.x AS x0, f.p AS p0 FROM parts t ASOF LEFT JOIN fi f ON t.model = f.model AND t.asset = f.asset AND t.q >= f.x WHERE pos >= n_cal),
ie AS (SELECT t.*, f.x AS x1, f.p AS p1 FROM ib t ASOF LEFT JOIN fi f ON t.model = f.model AND t.asset = f.asset AND t.q <= f.x),
iv AS (SELECT *, CASE WHEN x0 IS NULL THEN p1 WHEN x1 IS NULL OR x1 = x0 THEN p0 ELSE p0 + (p1 - p0) * (q - x0) / (x1 - x0) END AS p FROM ie)"""
_ROWS = f"""{S.models()},
{S.parts()},
{detail._CLOSED},
{detail._VOL},
{detail._ACI},
{_ISOTONIC},
ro AS (SELECT model, asset, pos, quantile_cont(q - r, {1 - ALPHA!r}) OVER (PARTITION BY model, asset ORDER BY pos ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS c FROM paths),
mp AS (SELECT model, asset, CASE WHEN method = 'shift' THEN 'conformal' ELSE method END AS method, param FROM pm UNION ALL SELECT model, asset, 'fhs', param FROM fz UNION ALL SELECT model, asset, 'aci', param FROM ac),
mr AS (SELECT t.model, t.asset, method, r, CASE WHEN method IN ('conformal', 'aci') THEN -q + param WHEN method = 'hist_quantile' THEN param WHEN method = 'scale' THEN -q * param ELSE ABS(q) * param END AS v FROM parts t JOIN mp USING (model, asset) WHERE pos >= n_cal
UNION ALL SELECT model, asset, 'raw', r, -q FROM parts WHERE pos >= n_cal
UNION ALL SELECT t.model, t.asset, 'rolling', r, c - q FROM parts t JOIN ro USING (model, asset, pos) WHERE pos >= n_cal AND pos >= {W}
UNION ALL SELECT model, asset, 'isotonic', r, -q * CASE WHEN p > 1e-6 THEN 0.01::DOUBLE / p ELSE 1.0 END FROM iv),
ms AS (SELECT model, asset, method, COUNT(*) AS n, SUM(CAST(r < -v AS INT)) AS x, AVG(ABS(v)) AS width, AVG({S.pinball("r", "(-v)", "0.01::DOUBLE")}) AS qs FROM mr GROUP BY ALL),
ml AS (SELECT *, {S.kupiec_lr("x", "n", "0.01::DOUBLE")} AS lr FROM ms),
mz AS (SELECT *, x::DOUBLE / n AS pi, CASE WHEN x IN (0, n) THEN {S.binomial_two_sided("x", "n", "0.01::DOUBLE")} ELSE {S.chi2_sf1("lr")} END AS p, CASE WHEN x * 250.0::DOUBLE / n <= 4 THEN 'Green' WHEN x * 250.0::DOUBLE / n <= 9 THEN 'Yellow' ELSE 'Red' END AS zone FROM ml)"""
_ROWS = _ROWS.replace(f"{detail._CLOSED},", f"{S.qv(method='order')},\n{detail._CLOSED},")


@query(Shape("model asset method zone", "n x", "pi p width qs", 6), _ROWS, "mz")
def baseline_methods_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight of the twelve methods, every pair."""
    return table(native_rows(R.paths(spark, sf_dir)))


def _share(method: str) -> str:
    return f"100 * AVG(CASE WHEN method = '{method}' THEN CAST(zone = 'Green' AS DOUBLE) END) AS {method}"


@query(Shape("model", "", " ".join(NATIVE), 6), _ROWS, f"(SELECT model, {', '.join(map(_share, NATIVE))} FROM mz GROUP BY model)")
def baseline_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by methods: assets in the green zone, in percent."""
    return pivot(table(native_rows(R.paths(spark, sf_dir))), NATIVE)


@query(Shape("method", "pairs rejected green", "mean_pi qs width green_pct", 5))
def baseline_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve methods, a row each. Forecasts start when their first window is full, as fits need them to differ."""
    kept = R.paths(spark, sf_dir).filter(F.col("pos") >= W).withColumn("pos", F.col("pos") - W)
    kept = scratch.written(kept, "paths")
    return summary(table(native_rows(kept).unionByName(fitted_rows(kept))))
