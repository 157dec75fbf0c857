"""Queries over distributions, fits, resampling and simulation. Those without SQL are held against closed
forms and plain versions in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.functions import stats
from vartide.operators import conformal, fit, forecast, inference, simulate
from vartide.operators import distributions as D
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.plans.report import ALPHA, PAIR, W, paths
from vartide.sources import panels

LEVELS = [k / 10 for k in range(1, 10)]


def _every_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 50 returns as samples, every day that has them all."""
    w = forecast.trailing(50)
    return panels.panel(spark, sf_dir).withColumn("samples", F.collect_list("r").over(w)).filter("pos >= 50")


SAMPLES_SQL = f"{S.returns()}, sm AS (SELECT asset, date, pos, list(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS xs FROM ret), st AS (SELECT asset, date, pos, list_sort(xs) AS s FROM sm WHERE pos >= 50), sq AS (SELECT *, s[3] + (s[4] - s[3]) * (0.05::DOUBLE * 49 - 2) AS q FROM st)"


DAILY_SQL = SAMPLES_SQL
SAMPLE_SHAPE = Shape("asset date", "", "quantile shortfall cdf0 tail10")
SAMPLE_ROWS = "(SELECT asset, date, q AS quantile, list_avg(list_filter(s, lambda x: x <= q)) AS shortfall, len(list_filter(s, lambda x: x <= 0)) / 50.0::DOUBLE AS cdf0, list_avg(s[1:10]) AS tail10 FROM sq)"


@query(SAMPLE_SHAPE, SAMPLES_SQL, SAMPLE_ROWS)
def sample_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day with a full window."""
    return _sample_facts(_every_sample(spark, sf_dir))


@query(SAMPLE_SHAPE, SAMPLES_SQL, SAMPLE_ROWS)
def sample_distribution_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return sample_distribution(spark, sf_dir)


def _sample_facts(samples: DataFrame) -> DataFrame:
    s = F.col("samples")
    return samples.select("asset", "date", D.sample_quantile(s, 0.05).alias("quantile"), D.sample_shortfall(s, 0.05).alias("shortfall"), D.sample_cdf(s, stats.d(0)).alias("cdf0"), D.tail_mean(s).alias("tail10"))


def _grids(samples: DataFrame) -> DataFrame:
    grid = F.array(*[D.sample_quantile(F.col("samples"), u) for u in LEVELS])
    return samples.select("asset", "date", "pos", F.array(*map(stats.d, LEVELS)).alias("levels"), grid.alias("quantiles"))


_GRID = ", ".join(f"s[CAST(FLOOR({u}::DOUBLE * 49) AS INT) + 1] + (s[CAST(FLOOR({u}::DOUBLE * 49) AS INT) + 2] - s[CAST(FLOOR({u}::DOUBLE * 49) AS INT) + 1]) * ({u}::DOUBLE * 49 - FLOOR({u}::DOUBLE * 49))" for u in LEVELS)


GRID_SHAPE = Shape("asset date", "", "own inside linear gaussian")
GRID_ROWS = f"(SELECT asset, date, g[2] AS own, g[2] + (g[3] - g[2]) * (0.25::DOUBLE - 0.2::DOUBLE) / (0.3::DOUBLE - 0.2::DOUBLE) AS inside, g[1] + (g[2] - g[1]) / (0.2::DOUBLE - 0.1::DOUBLE) * (0.01::DOUBLE - 0.1::DOUBLE) AS linear, list_avg(g) + list_stddev_pop(g) * ({stats.z_value(0.01)!r})::DOUBLE AS gaussian FROM gr)"


@query(GRID_SHAPE, f"{SAMPLES_SQL}, gr AS (SELECT asset, date, [{_GRID}] AS g FROM st)", GRID_ROWS)
def grid_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day with a full window."""
    return _grid_facts(_grids(_every_sample(spark, sf_dir)))


@query(GRID_SHAPE, f"{SAMPLES_SQL}, gr AS (SELECT asset, date, [{_GRID}] AS g FROM st)", GRID_ROWS)
def grid_distribution_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return grid_distribution(spark, sf_dir)


def _grid_facts(grids: DataFrame) -> DataFrame:
    u, q = F.col("levels"), F.col("quantiles")
    return grids.select("asset", "date", D.grid_quantile(u, q, 0.2).alias("own"), D.grid_quantile(u, q, 0.25).alias("inside"), D.grid_quantile(u, q, 0.01).alias("linear"), D.grid_quantile(u, q, 0.01, "gaussian").alias("gaussian"))


@query(Shape("id", "", "df location scale quantile shortfall", 4))
def tail_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Student tail for every day with a full window; days are dealt over tasks, as each is a fit."""
    g = _grids(_every_sample(spark, sf_dir)).repartition(fit.TASKS, "asset", "date")
    return fit.complete_tail(g.select(F.concat_ws(":", "asset", "date").alias("id"), "levels", "quantiles"), 0.01)


@query(Shape("id family", "", "quantile shortfall below", 6))
def parametric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal, Student and skewed Student laws with each asset's mean and deviation, at its least return."""
    moments = panels.panel(spark, sf_dir).groupBy("asset").agg(F.avg("r").alias("location"), F.stddev_pop("r").alias("scale"), F.min("r").alias("at"))
    laws = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(df).cast("double").alias("df"), F.lit(skew).cast("double").alias("skew")) for f, df, skew in (("normal", None, None), ("student_t", 5, None), ("skewed_t", 5, -0.5))))
    return fit.parametric(moments.select(F.col("asset").cast("string").alias("id"), "location", "scale", "at", F.inline(laws)), 0.01)


@query(Shape("model asset", "", "q_v q_lo q_hi q_se", 6))
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.bootstrap_ci(conformal.split_paths(paths(spark, sf_dir)), ALPHA)


@query(Shape("model asset method", "n_test viol", "qs width", 5))
def recalibration_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir).filter(F.col("pos") >= W)
    p = p.withColumn("pos", F.col("pos") - W)
    rows = conformal.corrected(fit.recalibrate(conformal.split_paths(p)))
    qs = stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(ALPHA))
    return rows.groupBy(*PAIR, "method").agg(F.count("*").alias("n_test"), F.sum("viol_corr").alias("viol"), F.avg(qs).alias("qs"), F.avg(F.abs("var_corr")).alias("width"))


@query(Shape("model asset regime", "n_test viol_raw viol_corr", "q_v pi_raw pi_corr", 5))
def garch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.static_audit(fit.gjr_garch(panels.panel(spark, sf_dir), ALPHA, W), ALPHA)


@query(Shape("model asset regime", "n_test viol_raw viol_corr", "q_v pi_raw pi_corr", 5))
def garch_skewed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under skewed Student innovations."""
    return conformal.static_audit(fit.gjr_garch(panels.panel(spark, sf_dir), ALPHA, W, innovations="skewed_t"), ALPHA)


@query(Shape("model asset zone", "n viol", "pi p_kupiec qs width", 5))
def daily_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily forecasts of filtered simulation and peaks over threshold, over the test part as they stand. Day
    totals move by more than their own size, so their Value-at-Risk has no cap."""
    returns, a = panels.panel(spark, sf_dir), stats.d(ALPHA)
    days = returns.groupBy("asset").agg(F.count("*").alias("days"))  # of the whole history, the window included
    test = fit.tail_forecasts(returns, ALPHA, W, cap=None).join(days, "asset").filter(F.col("pos") >= F.floor(F.col("days") * 0.7))
    g = test.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum((F.col("r") < F.col("q")).cast("int")).alias("viol"), F.avg(stats.pinball(F.col("r"), F.col("q"), a)).alias("qs"), F.avg(-F.col("q")).alias("width"))
    yearly = F.col("viol") / F.col("n") * 250
    return g.select(
        "*", (F.col("viol") / F.col("n")).alias("pi"), stats.chi2_sf1(stats.kupiec_lr(F.col("viol"), F.col("n"), a)).alias("p_kupiec"),
        F.when(yearly <= 4, "Green").when(yearly <= 9, "Yellow").otherwise("Red").alias("zone"),
    )


@query(Shape("model asset trees leaves rate kept", "n viol", "pi p_kupiec qs width", 5))
def boosted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight settings of the boosted quantile regression, every pair."""
    p = paths(spark, sf_dir).filter(F.col("pos") >= W).withColumn("pos", F.col("pos") - W)
    rows, a = fit.boosted_grid(conformal.split_paths(p), ALPHA), stats.d(ALPHA)
    broken, q = (F.col("r") < -F.col("var_corr")).cast("int"), -F.col("var_corr")
    g = rows.groupBy(*PAIR, "trees", "leaves", "rate", "kept").agg(F.count("*").alias("n"), F.sum(broken).alias("viol"), F.avg(stats.pinball(F.col("r"), q, a)).alias("qs"), F.avg(F.abs("var_corr")).alias("width"))
    return g.select("*", (F.col("viol") / F.col("n")).alias("pi"), stats.chi2_sf1(stats.kupiec_lr(F.col("viol"), F.col("n"), a)).alias("p_kupiec"))


@query(Shape("model asset", "n", "mean_ks share_rejected", 6))
def rolling_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fit.rolling_ks(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W), W)
    return rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.avg("ks").alias("mean_ks"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("share_rejected"))


@query(Shape("law length", "reps", "mean_q_v std_q_v cv mean_pi_raw mean_pi_corr green_pct", 6))
def simulation_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.summary(simulate.study(spark))


@query(
    Shape("model asset", "n x0", "p_lower", 7),
    f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}",
    "(SELECT model, asset, COUNT(*) AS n, SUM(viol_corr) AS x0, POW(0.99::DOUBLE, COUNT(*)) AS p_lower FROM test GROUP BY ALL)",
)
def exact_binomial_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(no violation) under the level, beside each pair's count: what the exact test compares at x = 0."""
    parts = conformal.split_paths(paths(spark, sf_dir))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA))
    return test.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("viol_corr").alias("x0"), F.pow(F.lit(0.99), F.count("*").cast("double")).alias("p_lower"))


@query(
    Shape("model", "missing"),
    f"{S.models()}",
    "(SELECT model, COUNT(*) AS missing FROM paths p WHERE pos % 3 = 0 AND NOT EXISTS (SELECT 1 FROM paths c WHERE c.model = p.model AND c.asset = p.asset AND c.date = p.date AND c.pos % 2 = 0) GROUP BY model)",
)
def forecast_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts that a store of computed ones lacks: an anti join on (model, asset, date)."""
    p = paths(spark, sf_dir)
    stored = p.filter("pos % 2 = 0").select("model", "asset", "date")
    return p.filter("pos % 3 = 0").join(stored, ["model", "asset", "date"], "left_anti").groupBy("model").agg(F.count("*").alias("missing"))


@query(
    Shape("asset", "year pre_days lag_days", "pre_std peak_r", 7),
    f"""{S.returns()}, sh AS (SELECT asset, year(date) AS year, MIN(date) AS d0, MAX_BY(date, (ABS(r), -pos)) AS peak FROM ret GROUP BY ALL)""",
    "(SELECT ret.asset, year, SUM(CAST(date < d0 AND date >= d0 - INTERVAL 365 DAY AS INT)) AS pre_days, STDDEV_SAMP(CASE WHEN date < d0 AND date >= d0 - INTERVAL 365 DAY THEN r END) AS pre_std, SUM(CAST(date > d0 AND date <= peak AS INT)) AS lag_days, MAX(CASE WHEN date = peak THEN ABS(r) END) AS peak_r FROM ret JOIN sh USING (asset) GROUP BY ret.asset, year)",
)
def shock_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the start of each year to its largest move (the first of equals), beside the calm year before."""
    r = panels.panel(spark, sf_dir)
    peak = F.max_by("date", F.struct(F.abs("r"), -F.col("pos")))
    shock = r.groupBy("asset", F.year("date").alias("year")).agg(F.min("date").alias("d0"), peak.alias("peak"))
    joined = r.join(shock, "asset")  # a row for each day and year of an asset
    before = (F.col("date") < F.col("d0")) & (F.col("date") >= F.date_sub("d0", 365))
    return joined.groupBy("asset", "year").agg(
        F.sum(before.cast("int")).alias("pre_days"), F.stddev_samp(F.when(before, F.col("r"))).alias("pre_std"),
        F.sum(((F.col("date") > F.col("d0")) & (F.col("date") <= F.col("peak"))).cast("int")).alias("lag_days"), F.max(F.when(F.col("date") == F.col("peak"), F.abs("r"))).alias("peak_r"),
    )


@query(
    Shape("asset", "positives n", "worst_q"),
    f"{S.models()}",
    "(SELECT asset, SUM(CAST(q > 0 AS INT)) AS positives, COUNT(*) AS n, MAX(q) AS worst_q FROM paths GROUP BY asset)",
)
def forecast_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the wrong sign, counted, not repaired."""
    return paths(spark, sf_dir).groupBy("asset").agg(F.sum((F.col("q") > 0).cast("int")).alias("positives"), F.count("*").alias("n"), F.max("q").alias("worst_q"))


@query(
    Shape("model_a model_b", "n lags", "mean_diff", 7),
    f"""{S.models(ALPHA, 100, 'c')},\n{S.parts()},\n{S.qv()},\n{S.TEST}, ls AS (SELECT model, asset, pos, {S.pinball('r', '(-var_corr)', '0.01::DOUBLE')} AS loss FROM test), pr AS (SELECT a.model AS model_a, b.model AS model_b, asset, pos, a.loss - b.loss AS diff FROM ls a JOIN ls b USING (asset, pos) WHERE a.model < b.model),
mn AS (SELECT model_a, model_b, MIN(n) AS n FROM (SELECT model_a, model_b, asset, COUNT(*) AS n FROM pr GROUP BY ALL) GROUP BY ALL),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_a, model_b, asset ORDER BY pos DESC) AS rpos FROM pr)""",
    "(SELECT model_a, model_b, ANY_VALUE(n) AS n, ANY_VALUE(CAST(LEAST(FLOOR(4.0::DOUBLE * POW(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)), n - 1) AS INT)) AS lags, SUM(diff) / ANY_VALUE(n) AS mean_diff FROM rk JOIN mn USING (model_a, model_b) WHERE rpos <= n GROUP BY model_a, model_b)",
)
def panel_dm_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel comparison with the rule-of-thumb bandwidth."""
    parts = conformal.split_paths(paths(spark, sf_dir, "c", ALPHA, 100))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA))
    losses = test.select("model", "asset", "pos", stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(ALPHA)).alias("loss"))
    return inference.hac_dm(inference.tail_aligned(inference.loss_pairs(losses)), bandwidth="rule")
