"""Finer report queries: coverage variants, baselines side by side, drift bounds, closures, panel errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import conformal, fit, forecast, inference, ranks, recalibrate, simulate
from vartide.operators import distributions as D
from vartide.plans import report as R
from vartide.plans import sql as S
from vartide.plans.fitted import DAILY_SQL, LEVELS, _every_sample, _grids
from vartide.plans.registry import ORACLE_SQL, Shape, query
from vartide.plans.report import ALPHA, PAIR, WC, W
from vartide.sources import panels, scratch

ONE = f"CAST({ALPHA} AS DOUBLE)"

# --- coverage --------------------------------------------------------------------------------------------


@query(
    Shape("model asset", "n x", "p_exact p_floor p_distance upper_tail", 6),
    R.AUDIT_CTES,
    f"""(SELECT *, CASE WHEN x IN (0, n) THEN {S.binomial_two_sided('x', 'n', ONE)} ELSE {S.chi2_sf1('lr')} END AS p_exact,
CASE WHEN x = 0 THEN 1.0 WHEN x = n THEN 0.0 ELSE {S.chi2_sf1('lr')} END AS p_floor,
CASE WHEN x IN (0, n) THEN CASE WHEN ABS(x::DOUBLE / n - {ONE}) > 0.02 THEN 0.0 ELSE 1.0 END ELSE {S.chi2_sf1('ABS(lr)')} END AS p_distance,
{S.binomial_upper('x', 'n', ONE)} AS upper_tail FROM (SELECT model, asset, n_test AS n, viol_corr AS x, kupiec_lr_corr AS lr FROM bt))""",
)
def coverage_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage p-values by the treatment of the ends: exact binomial, one at zero, by distance from the level."""
    f = conformal.static_audit(R.paths(spark, sf_dir), ALPHA)
    return f.select(*PAIR, F.col("n_test").alias("n"), F.col("viol_corr").alias("x"), *stats.coverage_variants(F.col("viol_corr"), F.col("n_test"), F.col("kupiec_lr_corr"), stats.d(ALPHA)))


@query(
    Shape("model asset zone_binomial", "n x"),
    R.AUDIT_CTES,
    f"(SELECT model, asset, n_test AS n, viol_corr AS x, {S.binomial_zone('viol_corr', 'n_test', ONE)} AS zone_binomial FROM bt)",
)
def binomial_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic lights by the binomial tail: yellow from 95 %, red from 99.99 %."""
    f = conformal.static_audit(R.paths(spark, sf_dir), ALPHA)
    return f.select(*PAIR, F.col("n_test").alias("n"), F.col("viol_corr").alias("x"), stats.binomial_zone(F.col("viol_corr"), F.col("n_test"), stats.d(ALPHA)).alias("zone_binomial"))


@query(
    Shape("model asset", "n00 n01 n10 n11", "p_report", 7),
    R.AUDIT_CTES,
    f"(SELECT *, {S.transition_p_report('raw')} AS p_report, n00_raw AS n00, n01_raw AS n01, n10_raw AS n10, n11_raw AS n11 FROM bt)",
)
def transition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independence of violations in the reports' form, beside the counts of transitions."""
    f = conformal.static_audit(R.paths(spark, sf_dir), ALPHA)
    return f.select(*PAIR, *[F.coalesce(f"n{c}_raw", F.lit(0)).alias(f"n{c}") for c in ("00", "01", "10", "11")], F.col("ind_p_report_raw").alias("p_report"))


@query(
    Shape("model asset regime", "n_cal n_test", "q_v"),
    f"{R.AUDIT_CTES}, nc AS (SELECT DISTINCT model, asset, n_cal FROM parts)",
    "(SELECT * FROM bt JOIN nc USING (model, asset) WHERE n_cal >= 100 AND n_test >= 50)",
)
def guarded_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of the pairs with at least 100 days to fit on and 50 to test."""
    parts = conformal.at_least(conformal.split_paths(R.paths(spark, sf_dir)), 100, 50)
    n = parts.groupBy(*PAIR).agg(F.first("n_cal").alias("n_cal"))
    return conformal.backtest(conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA)), ALPHA).join(n, PAIR)


# --- baselines side by side ------------------------------------------------------------------------------

_VOL = """vs AS (SELECT asset, VAR_POP(r) AS v0 FROM parts WHERE model = 'hist_sim' AND pos < 20 GROUP BY asset),
vt AS (SELECT a.asset, a.pos, a.r, SQRT(GREATEST(POW(0.94::DOUBLE, a.pos) * ANY_VALUE(v0) + COALESCE(SUM(0.06::DOUBLE * b.r * b.r * POW(0.94::DOUBLE, a.pos - 1 - b.pos)), 0), 1e-20)) AS sigma
FROM parts a JOIN vs USING (asset) LEFT JOIN parts b ON a.asset = b.asset AND b.model = 'hist_sim' AND b.pos < a.pos AND b.pos >= a.pos - 2000 WHERE a.model = 'hist_sim' AND a.pos < a.n_cal GROUP BY a.asset, a.pos, a.r),
vz AS (SELECT asset, AVG(sigma) AS sg, quantile_cont(r / sigma, 0.01) AS z, COUNT(*) AS m FROM vt GROUP BY asset),
fz AS (SELECT model, asset, CASE WHEN m >= 20 AND AVG(ABS(q)) > 1e-12 THEN -sg * z / AVG(ABS(q)) ELSE 1.0 END AS param FROM parts JOIN vz USING (asset) WHERE pos < n_cal GROUP BY model, asset, sg, z, m)"""
_CLOSED = R.recalibration_sql()
_ACI = """ord AS (SELECT model, asset, list(CAST(r < q AS DOUBLE) ORDER BY pos) AS vs, list_sort(list(score)) AS s FROM parts WHERE pos < n_cal GROUP BY ALL),
lv AS (SELECT model, asset, s, (1.0::DOUBLE - list_reduce(list_prepend(0.01::DOUBLE, vs), lambda a, v: greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, a + 0.05::DOUBLE * (0.01::DOUBLE - v))))) * (len(s) - 1) AS pt FROM ord),
ac AS (SELECT model, asset, s[CAST(FLOOR(pt) AS INT) + 1] + (s[LEAST(CAST(FLOOR(pt) AS INT) + 2, len(s))] - s[CAST(FLOOR(pt) AS INT) + 1]) * (pt - FLOOR(pt)) AS param FROM lv)"""
_EVERY = f"""{S.models()},\n{S.parts()},\n{S.qv()},\n{_CLOSED},\n{_VOL},\n{_ACI},
pa AS (SELECT * FROM pm UNION ALL SELECT model, asset, 'fhs', param FROM fz UNION ALL SELECT model, asset, 'aci', param FROM ac),
ap AS (SELECT p.*, method, CASE WHEN method IN ('shift', 'aci') THEN -q + param WHEN method = 'hist_quantile' THEN param WHEN method = 'scale' THEN -q * param ELSE ABS(q) * param END AS v FROM parts p JOIN pa USING (model, asset) WHERE pos >= n_cal),
bs AS (SELECT model, asset, method, COUNT(*) AS n, SUM(CAST(r < -v AS INT)) AS x, AVG(ABS(v)) AS width, AVG({S.pinball('r', '(-v)', ONE)}) AS qs FROM ap GROUP BY ALL),
bl AS (SELECT *, {S.kupiec_lr('x', 'n', ONE)} AS lr FROM bs),
bz AS (SELECT *, x::DOUBLE / n AS pi, CASE WHEN x IN (0, n) THEN {S.binomial_two_sided('x', 'n', ONE)} ELSE {S.chi2_sf1('lr')} END AS p, {S.binomial_zone('x', 'n', ONE)} AS zone FROM bl)"""


def baselines(parts: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Each pair under each closed-form method: counts, exact-ended coverage test, binomial zone, score, width."""
    parts = scratch.written(parts, "parts")  # each method reads them
    rows = recalibrate.apply(parts, recalibrate.fit_all(parts, alpha))
    qs = stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(alpha))
    g = rows.groupBy(*PAIR, "method").agg(F.count("*").alias("n"), F.sum("viol_corr").alias("x"), F.avg(F.abs("var_corr")).alias("width"), F.avg(qs).alias("qs"))
    x, n, a = F.col("x"), F.col("n"), stats.d(alpha)
    exact = F.when((x == 0) | (x == n), stats.binomial_two_sided(x, n, a)).otherwise(stats.chi2_sf1(stats.kupiec_lr(x, n, a)))
    return g.select("*", (x / n).alias("pi"), exact.alias("p"), stats.binomial_zone(x, n, a).alias("zone"))


@query(Shape("model asset method zone", "n x", "pi p width qs", 6), _EVERY, "bz")
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines(conformal.split_paths(R.paths(spark, sf_dir)), ALPHA)


@query(
    Shape("model method", "pairs green yellow red passes", "green_pct pass_pct mean_pi", 6),
    _EVERY,
    "(SELECT model, method, COUNT(*) AS pairs, SUM(CAST(zone = 'Green' AS INT)) AS green, SUM(CAST(zone = 'Yellow' AS INT)) AS yellow, SUM(CAST(zone = 'Red' AS INT)) AS red, SUM(CAST(p >= 0.05 AS INT)) AS passes, AVG(CAST(zone = 'Green' AS DOUBLE)) * 100 AS green_pct, AVG(CAST(p >= 0.05 AS DOUBLE)) * 100 AS pass_pct, AVG(pi) AS mean_pi FROM bz GROUP BY ALL)",
)
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = baselines(conformal.split_paths(R.paths(spark, sf_dir)), ALPHA), lambda c: F.sum(c.cast("int"))
    passed = F.col("p") >= 0.05
    return b.groupBy("model", "method").agg(
        F.count("*").alias("pairs"), *[n(F.col("zone") == z).alias(z.lower()) for z in ("Green", "Yellow", "Red")], n(passed).alias("passes"),
        (100 * F.avg((F.col("zone") == "Green").cast("double"))).alias("green_pct"), (100 * F.avg(passed.cast("double"))).alias("pass_pct"), F.avg("pi").alias("mean_pi"),
    )


ORACLE_SQL["recalibration_fhs"] = Shape("model asset method", "n_test viol", "param qs", 6).sql(
    f"{S.models()},\n{S.parts()},\n{_VOL}", f"(SELECT model, asset, 'fhs' AS method, COUNT(*) AS n_test, SUM(CAST(r < -ABS(q) * param AS INT)) AS viol, ANY_VALUE(param) AS param, AVG({S.pinball('r', '(-(ABS(q) * param))', ONE)}) AS qs FROM parts JOIN fz USING (model, asset) WHERE pos >= n_cal GROUP BY model, asset)"
)


@query(
    Shape("model asset", "n viol", "mean_q last_level", 7),
    f"""{S.models()},\n{S.parts()},
ts AS (SELECT model, asset, list_sort(list(score)) AS s, list(CAST(r < q AS DOUBLE) ORDER BY pos) AS vs, list(score ORDER BY pos) AS os FROM parts WHERE pos >= n_cal GROUP BY ALL),
st AS (SELECT *, unnest(range(0, len(s))) AS t FROM ts),
lv AS (SELECT model, asset, s, os[t + 1] AS score, list_reduce(list_prepend(0.01::DOUBLE, vs[1:t]), lambda a, v: greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, a + 0.05::DOUBLE * (0.01::DOUBLE - v)))) AS a, t FROM st),
pt AS (SELECT *, (1.0::DOUBLE - a) * (len(s) - 1) AS pt FROM lv),
qq AS (SELECT *, s[CAST(FLOOR(pt) AS INT) + 1] + (s[LEAST(CAST(FLOOR(pt) AS INT) + 2, len(s))] - s[CAST(FLOOR(pt) AS INT) + 1]) * (pt - FLOOR(pt)) AS q_t FROM pt)""",
    "(SELECT model, asset, COUNT(*) AS n, SUM(CAST(score > q_t AS INT)) AS viol, AVG(q_t) AS mean_q, MAX_BY(a, t) AS last_level FROM qq GROUP BY model, asset)",
)
def aci_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive inference step by step over the test part: the level moves with each raw violation, the day's
    correction is a quantile of all test scores (as the method is defined, it looks ahead)."""
    path = recalibrate.aci_path(conformal.split_paths(R.paths(spark, sf_dir)), ALPHA)
    return path.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum((F.col("score") > F.col("q_t")).cast("int")).alias("viol"), F.avg("q_t").alias("mean_q"), F.max_by("level", "pos").alias("last_level"))


# --- drift and bounds ------------------------------------------------------------------------------------

_DRIFT10 = f"""{S.returns()},\n{S.hist_sim(ALPHA, W)}, sc AS (SELECT *, list(q - r) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS s FROM hs),
ed AS (SELECT asset, date, pos, s, list_min(s) AS lo, list_max(s) AS hi FROM sc WHERE pos >= {W}),
bn AS (SELECT asset, date, pos, lo, hi, list_transform(s, lambda x: CASE WHEN hi > lo THEN LEAST(FLOOR((x - lo) / (hi - lo) * 10), 9) ELSE 0 END) AS b FROM ed),
dr AS (SELECT asset, date, 0.5 * list_sum(list_transform(range(0, 10), lambda k: ABS(len(list_filter(b[1:{W // 2}], lambda x: x = k)) / {W // 2}::DOUBLE - len(list_filter(b[{W // 2 + 1}:{W}], lambda x: x = k)) / {W - W // 2}::DOUBLE))) AS tv FROM bn)"""


@query(
    Shape("asset period", "days", "mean_tv max_tv bound_mean bound_max", 7),
    f"{_DRIFT10}, pr AS (SELECT asset, tv, CASE WHEN year(date) <= 1995 THEN 'calm' WHEN year(date) = 1998 THEN 'stress' ELSE 'other' END AS period FROM dr)",
    f"(SELECT asset, period, COUNT(*) AS days, AVG(tv) AS mean_tv, MAX(tv) AS max_tv, 1 - {ONE} - AVG(tv) - SQRT(LN({W}::DOUBLE) / {W}) AS bound_mean, 1 - {ONE} - MAX(tv) - SQRT(LN({W}::DOUBLE) / {W}) AS bound_max FROM pr GROUP BY asset, period)",
)
def rolling_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift as the area between densities on ten bins, by period, and the coverage that it guarantees."""
    rows = conformal.drift(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W), W, 10)
    year = F.year("date")
    rows = rows.withColumn("period", F.when(year <= 1995, "calm").when(year == 1998, "stress").otherwise("other"))
    g = rows.groupBy("asset", "period").agg(F.count("*").alias("days"), F.avg("tv").alias("mean_tv"), F.max("tv").alias("max_tv"))
    return g.withColumns({f"bound_{k}": conformal.rolling_bound(F.col(f"{k}_tv"), W, ALPHA) for k in ("mean", "max")})


# --- shortfall detail ------------------------------------------------------------------------------------

_ES_LEVEL = 0.025


@query(
    Shape("asset regime", "n_cal n_test n_viol viol_corr", "q_v q_e mean_var mean_es ratio", 7),
    f"""{R.ES_CTES}, sv AS (SELECT asset, list_sort(list(score)) AS s FROM parts WHERE pos < n_cal GROUP BY asset),
ve AS (SELECT asset, list_sort(list(r - es)) AS s FROM parts WHERE pos < n_cal AND r < q GROUP BY asset),
aq AS (SELECT asset, len(sv.s) AS n_cal, sv.s AS a, ve.s AS b, LEAST(CEIL((len(sv.s) + 1.0::DOUBLE) * CAST({1 - ALPHA!r} AS DOUBLE)) / len(sv.s), 1.0) * (len(sv.s) - 1) AS pa, LEAST(CEIL((len(ve.s) + 1.0::DOUBLE) * CAST({1 - _ES_LEVEL!r} AS DOUBLE)) / len(ve.s), 1.0) * (len(ve.s) - 1) AS pb FROM sv LEFT JOIN ve USING (asset)),
qe AS (SELECT asset, n_cal, COALESCE(len(b), 0) AS n_viol, a[CAST(FLOOR(pa) AS INT) + 1] + (a[LEAST(CAST(FLOOR(pa) AS INT) + 2, len(a))] - a[CAST(FLOOR(pa) AS INT) + 1]) * (pa - FLOOR(pa)) AS q_v,
COALESCE(b[CAST(FLOOR(pb) AS INT) + 1] + (b[LEAST(CAST(FLOOR(pb) AS INT) + 2, len(b))] - b[CAST(FLOOR(pb) AS INT) + 1]) * (pb - FLOOR(pb)), 0.0) AS q_e FROM aq),
ev AS (SELECT asset, ANY_VALUE(qe.n_cal) AS n_cal, COUNT(*) AS n_test, ANY_VALUE(n_viol) AS n_viol, SUM(CAST(r < q - q_v AS INT)) AS viol_corr, ANY_VALUE(q_v) AS q_v, ANY_VALUE(q_e) AS q_e, AVG(-q + q_v) AS mean_var, AVG(-es + q_e) AS mean_es, ABS(ANY_VALUE(q_v)) / AVG(ABS(q)) AS ratio FROM parts JOIN qe USING (asset) WHERE pos >= parts.n_cal GROUP BY asset)""",
    "(SELECT *, CASE WHEN ratio > 1 THEN 'replacement' ELSE 'signal-preserving' END AS regime FROM ev)",
)
def var_es_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid corrections of value at risk (1 %) and of expected shortfall on violation days (2.5 %), as positive
    numbers, with the regime of each asset."""
    rows = conformal.var_es_correction(R._es_parts(spark, sf_dir), ALPHA, _ES_LEVEL)
    g = rows.groupBy("asset").agg(
        F.first("n_cal").alias("n_cal"), F.count("*").alias("n_test"), F.first("n_viol").alias("n_viol"), F.sum((F.col("r") < -F.col("var_corr")).cast("int")).alias("viol_corr"),
        F.first("q_v").alias("q_v"), F.first("q_e").alias("q_e"), F.avg("var_corr").alias("mean_var"), F.avg("es_corr").alias("mean_es"), F.avg(F.abs("q")).alias("_size"),
    )
    ratio, kind = conformal.regime(F.col("q_v"), F.col("_size"))
    return g.withColumns({"ratio": ratio, "regime": kind})


# --- tail closures ---------------------------------------------------------------------------------------

_Z = [stats.z_value(u) for u in LEVELS]
_GRID_SQL = ", ".join(f"s[CAST(FLOOR({u}::DOUBLE * 49) AS INT) + 1] + (s[CAST(FLOOR({u}::DOUBLE * 49) AS INT) + 2] - s[CAST(FLOOR({u}::DOUBLE * 49) AS INT) + 1]) * ({u}::DOUBLE * 49 - FLOOR({u}::DOUBLE * 49))" for u in LEVELS)


def _lsq(g: str, low: int, high: int) -> str:
    """The normal quantile of least squares over deciles low..high: they are symmetric, so the mean of z is 0."""
    zs = _Z[low - 1 : high]
    slope = " + ".join(f"({z!r})::DOUBLE * {g}[{low + k}]" for k, z in enumerate(zs))
    return f"(list_avg({g}[{low}:{high}]) + ({slope}) / ({sum(z * z for z in zs)!r})::DOUBLE * ({stats.z_value(ALPHA)!r})::DOUBLE)"


@query(
    Shape("closure asset zone regime", "n_cal n_test viol", "q_v ratio pi", 7),
    f"""{DAILY_SQL}, gr AS (SELECT asset, date, [{_GRID_SQL}] AS g FROM st),
cl AS (SELECT asset, date, unnest(['gaussian', 'inner7', 'linear']) AS closure, unnest([{_lsq('g', 1, 9)}, {_lsq('g', 2, 8)}, g[1] + (g[2] - g[1]) / (0.2::DOUBLE - 0.1::DOUBLE) * (0.01::DOUBLE - 0.1::DOUBLE)]) AS q FROM gr),
cr AS (SELECT closure AS model, cl.asset, cl.date, ROW_NUMBER() OVER (PARTITION BY closure, cl.asset ORDER BY cl.date) - 1 AS pos, r, CAST(CAST(q AS DECIMAL(18,12)) AS DOUBLE) AS q FROM cl JOIN ret ON cl.asset = ret.asset AND cl.date = ret.date),
{S.parts(0.7, 'cr')},\n{S.qv(ALPHA, 'order')},\n{S.TEST},\n{S.backtest()}, nc AS (SELECT DISTINCT model, asset, n_cal FROM parts)""",
    f"(SELECT model AS closure, asset, {S.binomial_zone('viol_corr', 'n_test', ONE)} AS zone, regime, n_cal, n_test, viol_corr AS viol, q_v, ratio, pi_corr AS pi FROM bt JOIN nc USING (model, asset))",
)
def tail_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways from deciles to the 1 % quantile (a normal law by least squares on nine or the inner seven
    deciles, a straight line), each corrected and audited. `tail_closures_student` has the Student law."""
    g = _grids(_every_sample(spark, sf_dir))
    u, q = F.col("levels"), F.col("quantiles")
    cells = [("gaussian", D.least_squares_normal(q, LEVELS, 1, 9, ALPHA)), ("inner7", D.least_squares_normal(q, LEVELS, 2, 8, ALPHA)), ("linear", D.grid_quantile(u, q, ALPHA))]
    rows = g.select("asset", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), forecast.exact(v).alias("q")) for k, v in cells])).alias("c")).select("c.model", "asset", "date", "c.q")
    return _closure_audit(conformal.align(panels.panel(spark, sf_dir), rows))


def _closure_audit(path: DataFrame) -> DataFrame:
    f = conformal.static_audit(path, ALPHA, method="order")
    n = conformal.split_paths(path).groupBy(*PAIR).agg(F.first("n_cal").alias("n_cal"))
    zone = stats.binomial_zone(F.col("viol_corr"), F.col("n_test"), stats.d(ALPHA))
    return f.join(n, PAIR).select(F.col("model").alias("closure"), "asset", zone.alias("zone"), "regime", "n_cal", "n_test", F.col("viol_corr").alias("viol"), "q_v", "ratio", F.col("pi_corr").alias("pi"))


@query(Shape("closure asset zone regime", "n_cal n_test viol", "q_v ratio pi", 5))
def tail_closures_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Student law fitted to all nine or the inner seven deciles, corrected and audited in the same way."""
    g = _grids(_every_sample(spark, sf_dir)).repartition(fit.TASKS, "asset", "date")
    cells = [F.struct(F.lit(k).alias("closure"), F.slice("levels", first, n).alias("levels"), F.slice("quantiles", first, n).alias("quantiles")) for k, first, n in (("student", 1, 9), ("inner7_student", 2, 7))]
    keyed = g.select("asset", "date", F.explode(F.array(*cells)).alias("c"))
    fitted = fit.complete_tail(keyed.select(F.to_json(F.struct("c.closure", "asset", F.col("date").cast("string").alias("date"))).alias("id"), "c.levels", "c.quantiles"), ALPHA)
    key = F.from_json("id", "closure string, asset string, date string")
    rows = fitted.select(key.alias("k"), "quantile").select(F.col("k.closure").alias("model"), "k.asset", F.to_date("k.date").alias("date"), forecast.exact(F.col("quantile")).alias("q"))
    return _closure_audit(conformal.align(panels.panel(spark, sf_dir), rows))


# --- panel errors ----------------------------------------------------------------------------------------


@query(
    Shape("model", "n days", "pi se_hac", 8),
    f"""{R.PANEL_CTES}, sd AS (SELECT model, date, SUM(viol_corr) AS s, COUNT(*) AS k FROM test GROUP BY ALL),
ce AS (SELECT *, s - AVG(s) OVER (PARTITION BY model) AS e, ROW_NUMBER() OVER (PARTITION BY model ORDER BY date) AS t, COUNT(*) OVER (PARTITION BY model) AS days FROM sd),
bw AS (SELECT model, ANY_VALUE(days) AS days, SUM(k) AS n, SUM(s) AS x, CAST(FLOOR(4.0::DOUBLE * POW(ANY_VALUE(days) / 100.0::DOUBLE, 2.0::DOUBLE / 9)) AS INT) AS lags, SUM(e * e) AS g0 FROM ce GROUP BY model),
gk AS (SELECT a.model, b.t - a.t AS k, SUM(a.e * b.e) AS g FROM ce a JOIN ce b ON a.model = b.model AND b.t > a.t AND b.t <= a.t + 30 GROUP BY ALL),
hv AS (SELECT bw.model, days, n, x, g0 + COALESCE(SUM(CASE WHEN k <= lags THEN 2.0::DOUBLE * (1 - k / (lags + 1.0::DOUBLE)) * g END), 0) AS v FROM bw JOIN gk USING (model) GROUP BY bw.model, days, n, x, g0, lags)""",
    "(SELECT model, n, days, x::DOUBLE / n AS pi, SQRT(v / (days::DOUBLE * (days - 1))) * days / n AS se_hac FROM hv)",
)
def panel_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled violation rates with a standard error that allows for dependence across assets and days."""
    return inference.pooled_hac(R._test_rows(spark, sf_dir, "c", WC))


_REG = """rg AS (SELECT asset, qs_raw - qs_corr AS y, q_v AS x1, pi_raw AS x2 FROM bt),
ms AS (SELECT COUNT(*)::DOUBLE AS n, COUNT(DISTINCT asset)::DOUBLE AS g, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2 FROM rg),
dv AS (SELECT asset, y - my AS y, x1 - m1 AS a, x2 - m2 AS b FROM rg, ms),
cs AS (SELECT SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(b * b) AS bb, SUM(a * y) AS ay, SUM(b * y) AS dy FROM dv),
be AS (SELECT *, (bb * ay - ab * dy) / (aa * bb - ab * ab) AS b1, (aa * dy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM cs),
rs AS (SELECT asset, y - b1 * a - b2 * b AS e, (bb * a - ab * b) / (aa * bb - ab * ab) AS p1, (aa * b - ab * a) / (aa * bb - ab * ab) AS p2 FROM dv, be),
sg AS (SELECT SUM(e * e) AS rss FROM rs),
cg AS (SELECT SUM(u1 * u1) AS v1, SUM(u2 * u2) AS v2 FROM (SELECT asset, SUM(p1 * e) AS u1, SUM(p2 * e) AS u2 FROM rs GROUP BY asset))"""


@query(
    Shape("", "n_obs", "se1 se2 se_cluster1 se_cluster2 partial_r2 p_cluster1 p_cluster2", 6),
    f"{R.PANEL_CTES}, {_REG}, fin AS (SELECT CAST(n AS BIGINT) AS n_obs, b1, b2, SQRT(rss / (n - 3) * bb / (aa * bb - ab * ab)) AS se1, SQRT(rss / (n - 3) * aa / (aa * bb - ab * ab)) AS se2, SQRT(g / (g - 1) * (n - 1) / (n - 3) * v1) AS se_cluster1, SQRT(g / (g - 1) * (n - 1) / (n - 3) * v2) AS se_cluster2, n FROM ms, be, sg, cg)",
    f"(SELECT *, POW(b1 / se1, 2) / (POW(b1 / se1, 2) + n - 3) AS partial_r2, {S.two_sided_p('(b1 / se_cluster1)')} AS p_cluster1, {S.two_sided_p('(b2 / se_cluster2)')} AS p_cluster2 FROM fin)",
)
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors, classical and by cluster, partial R2 and normal p-values of the diagnostic regression."""
    facts = R._panel_facts(spark, sf_dir).withColumn("gain", F.col("qs_raw") - F.col("qs_corr"))
    fit = inference.regress(facts, "gain", "q_v", "pi_raw", "asset")
    return fit.withColumns({f"p_cluster{k}": stats.two_sided_p(F.col(f"beta{k}") / F.col(f"se_cluster{k}")) for k in (1, 2)})


@query(
    Shape("asset", "n_before n_after", "t welch_t welch_df", 6),
    f"{S.returns('c')}, gp AS (SELECT asset, CAST(year(date) >= 1996 AS INT) AS late, COUNT(*)::DOUBLE AS n, AVG(ABS(r)) AS m, VAR_SAMP(ABS(r)) AS v FROM ret GROUP BY ALL), tw AS (SELECT a.asset, a.n AS n0, b.n AS n1, a.m - b.m AS d, a.v AS v0, b.v AS v1 FROM gp a JOIN gp b ON a.asset = b.asset AND a.late = 0 AND b.late = 1)",
    "(SELECT asset, n0 AS n_before, n1 AS n_after, d / SQRT(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t, d / SQRT(v0 / n0 + v1 / n1) AS welch_t, POW(v0 / n0 + v1 / n1, 2) / (POW(v0 / n0, 2) / (n0 - 1) + POW(v1 / n1, 2) / (n1 - 1)) AS welch_df FROM tw)",
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample tests of the size of returns before and after a date."""
    rows = panels.panel(spark, sf_dir, "c").select("asset", F.abs("r").alias("y"), (F.year("date") >= 1996).alias("late"))
    return inference.two_sample(rows, "y", "late", ("asset",))


@query(
    Shape("model_a model_b", "n", "t_orig p_boot", 6),
    f"""{S.models(ALPHA, WC, 'c')},\n{S.parts()},\n{S.qv()},\n{S.TEST}, {R.PAIRS_CTE},
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_a, model_b, asset ORDER BY pos DESC) AS rpos FROM pr),
mn AS (SELECT model_a, model_b, MIN(n) AS n_min FROM (SELECT model_a, model_b, asset, COUNT(*) AS n FROM pr GROUP BY ALL) GROUP BY ALL),
st AS (SELECT model_a, model_b, rpos, SUM(diff) AS s FROM rk JOIN mn USING (model_a, model_b) WHERE rpos <= n_min GROUP BY ALL),
tt AS (SELECT model_a, model_b, COUNT(*) AS n, ABS(AVG(s)) / SQRT(VAR_SAMP(s) / COUNT(*)) AS t_orig FROM st GROUP BY ALL)""",
    "(SELECT *, CAST(ROUND(t_orig, 9) <= 0 AS DOUBLE) AS p_boot FROM tt)",
)
def wild_cluster_dm_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap over centred series of daily sums."""
    pairs = inference.loss_pairs(R._losses(R._test_rows(spark, sf_dir, "c", WC)))
    return inference.wild_cluster_sums(inference.tail_aligned(pairs))


@query(
    Shape("model_a model_b", "n lags", "dm p_normal", 6),
    ORACLE_SQL["panel_dm_rule"].split("WITH ", 1)[1].rsplit("\nSELECT ", 1)[0]
    + """, sm AS (SELECT model_a, model_b, rpos, ANY_VALUE(n) AS n, SUM(diff) AS s FROM rk JOIN mn USING (model_a, model_b) WHERE rpos <= n GROUP BY ALL),
ce AS (SELECT *, n - rpos AS t, s - AVG(s) OVER (PARTITION BY model_a, model_b) AS e FROM sm),
bw AS (SELECT model_a, model_b, ANY_VALUE(n) AS n, AVG(s) AS m, SUM(e * e) / COUNT(*) AS g0, CAST(LEAST(FLOOR(4.0::DOUBLE * POW(ANY_VALUE(n) / 100.0::DOUBLE, 2.0::DOUBLE / 9)), ANY_VALUE(n) - 1) AS INT) AS lags FROM ce GROUP BY ALL),
gk AS (SELECT a.model_a, a.model_b, b.t - a.t AS k, SUM(a.e * b.e) AS g FROM ce a JOIN ce b ON a.model_a = b.model_a AND a.model_b = b.model_b AND b.t > a.t AND b.t <= a.t + 30 GROUP BY ALL),
lv AS (SELECT bw.model_a, bw.model_b, n, lags, m, GREATEST(g0 + COALESCE(SUM(CASE WHEN k <= lags THEN 2.0::DOUBLE * (1 - k / (lags + 1.0::DOUBLE)) * g / n END), 0), 1e-20) AS v FROM bw JOIN gk ON bw.model_a = gk.model_a AND bw.model_b = gk.model_b GROUP BY bw.model_a, bw.model_b, n, lags, m, g0),
dd AS (SELECT *, m / SQRT(v / n) * SQRT((n - 1)::DOUBLE / n) AS dm FROM lv)""",
    f"(SELECT *, {S.two_sided_p('dm')} AS p_normal FROM dd)",
)
def panel_dm_rule_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the panel comparison with the rule-of-thumb bandwidth."""
    pairs = inference.loss_pairs(R._losses(R._test_rows(spark, sf_dir, "c", WC)))
    return inference.hac_dm(inference.tail_aligned(pairs), bandwidth="rule").withColumnRenamed("p_value", "p_normal")


# --- overviews and stores --------------------------------------------------------------------------------


@query(
    Shape("class rank asset first_date last_date", "n_obs models"),
    f"{S.models(ALPHA, WC, 'c')}, cl AS (SELECT n_name AS asset, r_name AS class, r_regionkey AS rank FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "(SELECT class, rank, asset, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT date) AS n_obs, COUNT(DISTINCT model) AS models FROM paths JOIN cl USING (asset) GROUP BY class, rank, asset)",
)
def asset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets in the order of their classes (a dimension with an explicit rank), with days and models."""
    nation, region = panels.table(spark, sf_dir, "nation"), panels.table(spark, sf_dir, "region")
    order = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("asset"), F.col("r_name").alias("class"), F.col("r_regionkey").alias("rank"))
    rows = R.paths(spark, sf_dir, "c", ALPHA, WC).groupBy("asset").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("n_obs"), F.countDistinct("model").alias("models"))
    unmapped = F.raise_error(F.concat(F.lit("no class for asset "), "asset"))
    return rows.join(order, "asset", "left").withColumn("class", F.when(F.col("class").isNull(), unmapped).otherwise(F.col("class"))).orderBy("rank", "asset")


@query(
    Shape("asset", "weekdays traded held", "coverage"),
    f"{S.returns()}, sp AS (SELECT asset, MIN(date) AS a, MAX(date) AS b, COUNT(*) AS traded FROM ret GROUP BY asset), cd AS (SELECT asset, CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM sp)",
    "(SELECT sp.asset, COUNT(*) AS weekdays, ANY_VALUE(traded) AS traded, COUNT(ret.date) AS held, COUNT(ret.date)::DOUBLE / COUNT(*) AS coverage FROM sp JOIN cd USING (asset) LEFT JOIN ret ON ret.asset = cd.asset AND ret.date = cd.date WHERE isodow(cd.date) < 6 GROUP BY sp.asset)",
)
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays between an asset's first and last day, and how many of them have a return."""
    r = panels.panel(spark, sf_dir).select("asset", "date")
    span = r.groupBy("asset").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("traded"))
    days = span.select("asset", "traded", F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return days.join(r.withColumn("held", F.lit(1)), ["asset", "date"], "left").groupBy("asset").agg(F.count("*").alias("weekdays"), F.first("traded").alias("traded"), F.count("held").alias("held"), (F.count("held") / F.count("*")).alias("coverage"))


@query(
    Shape("model asset", "size running"),
    f"{S.models()}, en AS (SELECT model, asset, MAX(date) AS stamp, COUNT(*) AS size FROM paths GROUP BY ALL), ru AS (SELECT *, SUM(size) OVER (ORDER BY stamp DESC, model DESC, asset DESC) AS running, SUM(size) OVER () AS total FROM en)",
    "(SELECT * FROM ru WHERE running > total * 0.6)",
)
def evicted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a forecast store that go, oldest first, until it holds 60 % of its rows."""
    entries = R.paths(spark, sf_dir).groupBy(*PAIR).agg(F.max("date").alias("stamp"), F.count("*").alias("size"))  # a row per pair
    order = [F.col(c).desc() for c in ("stamp", "model", "asset")]
    total = entries.agg(F.sum("size")).first()[0] or 0
    return ranks.cumulated(entries, order, "size").filter(F.col("running") > F.lit(float(total)) * 0.6)


@query(
    Shape("wanted_a wanted_b asset", "turned", "dm", 7),
    ORACLE_SQL["dm_pairs"].split("WITH ", 1)[1].rsplit("\nSELECT ", 1)[0] + ", bw AS (SELECT model_a AS a, model_b AS b, asset, dm, 0 AS turned FROM dm UNION ALL SELECT model_b, model_a, asset, -dm, 1 FROM dm)",
    "(SELECT a AS wanted_a, b AS wanted_b, asset, turned, dm FROM bw WHERE b = 'hist_sim' OR (a = 'scaled_05' AND b = 'norm_roll'))",
)
def stored_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons looked up in either order: a stored pair (b, a) answers (a, b) with the other sign."""
    stored = inference.diebold_mariano(inference.loss_pairs(R._losses(R._test_rows(spark, sf_dir, "a", W))))
    other = stored.select(F.col("model_b").alias("a"), F.col("model_a").alias("b"), "asset", (-F.col("dm")).alias("dm"), F.lit(1).alias("turned"))
    both = stored.select(F.col("model_a").alias("a"), F.col("model_b").alias("b"), "asset", "dm", F.lit(0).alias("turned")).unionByName(other)
    wanted = (F.col("b") == "hist_sim") | ((F.col("a") == "scaled_05") & (F.col("b") == "norm_roll"))
    return both.filter(wanted).select(F.col("a").alias("wanted_a"), F.col("b").alias("wanted_b"), "asset", "turned", "dm")


# --- simulation ------------------------------------------------------------------------------------------


@query(Shape("study law length split", "reps", "mean_q_v std_q_v mean_pi_raw mean_pi_corr green_pct", 6))
def robustness_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small samples (five laws and lengths) and calibration shares (two laws, three lengths, five shares)."""
    return simulate.robustness_summary(simulate.robustness(spark))


@query(Shape("law", "reps", "before during after t_before_after", 6))
def regime_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling corrections around a stretch of tripled variance."""
    return simulate.regime_summary(simulate.regime_shift(spark))
