"""The report queries over the driver's tables, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import conformal, forecast, inference, recalibrate, returns
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.sources import panels, scratch

W, ALPHA = 250, 0.01
#: Panel C is shorter per asset.
WC = 100
PAIR = ["model", "asset"]


def paths(spark: SparkSession, sf_dir: str, kind: str = "a", alpha: float = ALPHA, window: int = W) -> DataFrame:
    return forecast.standard_set(panels.panel(spark, sf_dir, kind), alpha, window)


# --- returns and forecasts -------------------------------------------------------------------------------


def _returns_query(kind: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return panels.panel(spark, sf_dir, kind)

    f.__name__ = f"returns_panel_{kind}"
    return query(Shape("asset date", "pos", "r", 12), S.returns(kind), "ret")(f)


for _kind in "abc":
    _returns_query(_kind)


@query(Shape("asset", "n", "mean_r"), S.returns(), "(SELECT asset, COUNT(*) AS n, AVG(r) AS mean_r FROM ret WHERE ABS(r) <= 0.5 GROUP BY asset)")
def log_return_outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.without_outliers(panels.panel(spark, sf_dir)).groupBy("asset").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"))


@query(Shape("model asset date", "pos", "q", 9), S.models(), "paths")
def forecast_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir)


@query(
    Shape("asset date", "pos", "q", 6),
    f"{S.returns()}, age AS (SELECT a.asset, a.date, a.pos, SUM(b.r * b.r * POW(0.94::DOUBLE, a.pos - 1 - b.pos)) / SUM(POW(0.94::DOUBLE, a.pos - 1 - b.pos)) AS v FROM ret a LEFT JOIN ret b ON a.asset = b.asset AND b.pos BETWEEN a.pos - {W} AND a.pos - 1 GROUP BY ALL)",
    f"(SELECT asset, date, pos, COALESCE(SQRT(v) * ({stats.z_value(ALPHA)!r})::DOUBLE, 0.0) AS q FROM age)",
)
def forecast_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.ewma(panels.panel(spark, sf_dir), ALPHA, W).drop("model")


@query(
    Shape("asset date next_date", "", "next_r", 12),
    S.returns(),
    "(SELECT l.asset, l.date, r.date AS next_date, r.r AS next_r FROM ret l ASOF LEFT JOIN ret r ON l.asset = r.asset AND l.date < r.date)",
)
def asof_next_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's next return."""
    r = panels.panel(spark, sf_dir)
    return forecast.next_return(r.select("asset", "date"), r)


@query(
    Shape("asset date next_date", "", "next_r", 12),
    S.returns(),
    "(SELECT l.asset, l.date, r.date AS next_date, r.r AS next_r FROM ret l ASOF LEFT JOIN ret r ON l.asset = r.asset AND l.date < r.date)",
)
def asof_next_return_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return asof_next_return(spark, sf_dir)


# --- static audits ---------------------------------------------------------------------------------------

AUDIT = Shape(
    "model asset regime zone_raw zone_corr zone_report_raw zone_report_corr", "n_test viol_raw viol_corr",
    "q_v ratio pi_raw pi_corr qs_raw qs_corr width_raw width_corr kupiec_lr_raw kupiec_lr_corr kupiec_p_raw kupiec_p_corr ind_p_raw ind_p_corr cc_p_raw cc_p_corr",
)
AUDIT_CTES = f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST},\n{S.backtest()}"


def static_audit_summary(spark: SparkSession, sf_dir: str, window: int = W) -> DataFrame:
    """Historical simulation alone: what entry() runs."""
    path = forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, window)
    return AUDIT.of(conformal.static_audit(path, ALPHA))


query(None, sql=AUDIT.sql(AUDIT_CTES, "bt WHERE model = 'hist_sim'"))(static_audit_summary)


@query(AUDIT, AUDIT_CTES, "bt")
def static_audit_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.static_audit(paths(spark, sf_dir), ALPHA)


def _qv_query(method: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conformal.fit_static(conformal.split_paths(paths(spark, sf_dir)), ALPHA, method)

    f.__name__ = f"static_qv_{method}"
    return query(Shape("model asset", "", "q_v"), f"{S.models()},\n{S.parts()},\n{S.qv(ALPHA, method)}", "qv")(f)


for _method in ("linear", "order", "hybrid"):
    _qv_query(_method)

ALPHAS = (0.01, 0.025, 0.05, 0.1)


def full_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: order-statistic audits of every model, asset and level in one plan."""
    every = forecast.levels_set(panels.panel(spark, sf_dir), ALPHAS, W)
    return conformal.static_audit(every, F.col("alpha"), method="order", keys=("alpha", *PAIR))


def _facts_sql() -> str:
    """CTEs up to facts, the levels with suffixes of their own."""
    import re

    ctes, names = [S.returns()], []
    for k, a in enumerate(ALPHAS):
        body = f"{S.models(a)},\n{S.parts()},\n{S.qv(a, 'order')},\n{S.TEST},\n{S.backtest(a)}"[len(S.returns()) + 2 :]
        for cte in ("hs", "nr", "paths", "parts", "srt", "qv", "test", "mk", "ag", "bt0", "bt"):
            body = re.sub(rf"(?<=FROM ){cte}\b|(?<=JOIN ){cte}\b|\b{cte}(?= AS \()", f"{cte}_{k}", body)
        ctes.append(body)
        names.append(f"SELECT *, CAST({a} AS DOUBLE) AS alpha FROM bt_{k}")
    return ",\n".join(ctes) + ",\nfacts AS (" + " UNION ALL ".join(names) + ")"


FACTS_SQL = _facts_sql()


@query(Shape("model asset alpha regime zone_report_raw zone_report_corr", "n_test viol_raw viol_corr", "q_v pi_raw pi_corr qs_raw qs_corr width_corr kupiec_p_raw kupiec_p_corr"), FACTS_SQL, "facts")
def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_facts(spark, sf_dir)


@query(
    Shape("model alpha", "n_assets replacements", "mean_q_v std_q_v min_q_v max_q_v mean_pi green_share"),
    FACTS_SQL,
    "(SELECT model, alpha, COUNT(*) AS n_assets, SUM(CAST(regime = 'replacement' AS INT)) AS replacements, AVG(q_v) AS mean_q_v, STDDEV_SAMP(q_v) AS std_q_v, MIN(q_v) AS min_q_v, MAX(q_v) AS max_q_v, AVG(pi_corr) AS mean_pi, AVG(CAST(zone_report_corr = 'Green' AS DOUBLE)) AS green_share FROM facts GROUP BY ALL)",
)
def master_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_facts(spark, sf_dir).groupBy("model", "alpha").agg(
        F.count("*").alias("n_assets"), F.sum((F.col("regime") == "replacement").cast("int")).alias("replacements"), F.avg("q_v").alias("mean_q_v"), F.stddev_samp("q_v").alias("std_q_v"),
        F.min("q_v").alias("min_q_v"), F.max("q_v").alias("max_q_v"), F.avg("pi_corr").alias("mean_pi"), F.avg((F.col("zone_report_corr") == "Green").cast("double")).alias("green_share"),
    )


@query(
    Shape("model", "passes_raw passes_corr green", "width_ratio qs_corr"),
    FACTS_SQL,
    "(SELECT model, SUM(CAST(kupiec_p_raw >= 0.05 AS INT)) AS passes_raw, SUM(CAST(kupiec_p_corr >= 0.05 AS INT)) AS passes_corr, SUM(CAST(zone_report_corr = 'Green' AS INT)) AS green, AVG(width_corr) / (SELECT AVG(width_corr) FROM facts WHERE model = 'hist_sim' AND alpha = 0.01) AS width_ratio, AVG(qs_corr) * 10000 AS qs_corr FROM facts WHERE alpha = 0.01 GROUP BY model)",
)
def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = conformal.static_audit(paths(spark, sf_dir), ALPHA, method="order")
    by_model = f.groupBy("model").agg(
        F.sum((F.col("kupiec_p_raw") >= 0.05).cast("int")).alias("passes_raw"), F.sum((F.col("kupiec_p_corr") >= 0.05).cast("int")).alias("passes_corr"),
        F.sum((F.col("zone_report_corr") == "Green").cast("int")).alias("green"), F.avg("width_corr").alias("_w"), (F.avg("qs_corr") * 10000).alias("qs_corr"),
    )
    base = F.max(F.when(F.col("model") == "hist_sim", F.col("_w"))).over(Window.partitionBy(F.lit(1)))  # one row per model
    return by_model.withColumn("width_ratio", F.col("_w") / base)


@query(
    Shape("alpha model", "pairs rejected_raw rejected_corr"),
    FACTS_SQL,
    "(SELECT alpha, model, COUNT(*) AS pairs, SUM(CAST(kupiec_p_raw < 0.05 AS INT)) AS rejected_raw, SUM(CAST(kupiec_p_corr < 0.05 AS INT)) AS rejected_corr FROM facts GROUP BY ALL)",
)
def multi_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = full_facts(spark, sf_dir)
    rejected = lambda c: F.sum((F.col(c) < 0.05).cast("int"))
    return f.groupBy("alpha", "model").agg(F.count("*").alias("pairs"), rejected("kupiec_p_raw").alias("rejected_raw"), rejected("kupiec_p_corr").alias("rejected_corr"))


@query(
    Shape("model", "", "urgent high medium low not_specified"),
    AUDIT_CTES,
    "(SELECT model, MAX(CASE WHEN asset = '1-URGENT' THEN q_v END) AS urgent, MAX(CASE WHEN asset = '2-HIGH' THEN q_v END) AS high, MAX(CASE WHEN asset = '3-MEDIUM' THEN q_v END) AS medium, MAX(CASE WHEN asset = '5-LOW' THEN q_v END) AS low, MAX(CASE WHEN asset = '4-NOT SPECIFIED' THEN q_v END) AS not_specified FROM bt GROUP BY model)",
)
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low", "4-NOT SPECIFIED": "not_specified"}
    f = conformal.static_audit(paths(spark, sf_dir), ALPHA).groupBy("model").pivot("asset", list(names)).agg(F.first("q_v"))
    return f.withColumnsRenamed(names)


@query(
    Shape("asset", "n_cal", "delta guaranteed empirical"),
    f"{AUDIT_CTES}, nc AS (SELECT DISTINCT model, asset, n_cal FROM parts)",
    "(SELECT asset, n_cal, 2.5 * SQRT(LN(n_cal::DOUBLE) / n_cal) AS delta, (1 - 0.01::DOUBLE - 2.5::DOUBLE * SQRT(LN(n_cal::DOUBLE) / n_cal)) * 100 AS guaranteed, (1 - pi_corr) * 100 AS empirical FROM bt JOIN nc USING (model, asset) WHERE model = 'hist_sim')",
)
def coverage_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = conformal.split_paths(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W))
    n = parts.groupBy(*PAIR).agg(F.first("n_cal").alias("n_cal"))
    audit = conformal.backtest(conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA)), ALPHA).join(n, PAIR)
    nc = F.col("n_cal").cast("double")
    return audit.select("asset", "n_cal", (2.5 * F.sqrt(F.ln(nc) / nc)).alias("delta"), conformal.coverage_bound(F.col("n_cal")).alias("guaranteed"), ((1 - F.col("pi_corr")) * 100).alias("empirical"))


def _split_case(split: float) -> str:
    return f"SELECT '{split}' AS split, b.* FROM (WITH {S.parts(split)}, {S.qv()}, {S.TEST}, {S.backtest()} SELECT * FROM bt) b"


@query(
    Shape("split model asset", "n_test viol_corr", "q_v pi_corr"),
    f"{S.models()}, every AS ({' UNION ALL '.join(_split_case(s) for s in (0.5, 0.6, 0.7, 0.8))})",
    "every",
)
def calibration_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = paths(spark, sf_dir).withColumn("split", F.explode(F.array(*[F.lit(str(s)) for s in (0.5, 0.6, 0.7, 0.8)])))
    return conformal.static_audit(every, ALPHA, F.col("split").cast("double"), keys=("split", *PAIR))


@query(
    Shape("model asset", "gap n_test viol_corr", "pi_corr"),
    f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}",
    "(SELECT model, asset, ANY_VALUE(CAST(CEIL(2 * LN(n::DOUBLE)) AS INT)) AS gap, COUNT(*) AS n_test, SUM(viol_corr) AS viol_corr, AVG(viol_corr) AS pi_corr FROM test WHERE pos >= n_cal + CEIL(2 * LN(n::DOUBLE)) GROUP BY ALL)",
)
def gap_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = conformal.split_paths(paths(spark, sf_dir)).withColumn("gap", F.ceil(2 * F.ln(F.col("n").cast("double"))).cast("int"))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA)).filter(F.col("pos") >= F.col("n_cal") + F.col("gap"))
    return test.groupBy(*PAIR).agg(F.first("gap").alias("gap"), F.count("*").alias("n_test"), F.sum("viol_corr").alias("viol_corr"), F.avg("viol_corr").alias("pi_corr"))


def _weighted_case(decay: float) -> str:
    return f"SELECT '{decay}' AS decay, model, asset, COALESCE(MIN(CASE WHEN cw / (tw + 1) >= 0.99::DOUBLE THEN score END), MAX(score)) AS q_v, ANY_VALUE(tw) * ANY_VALUE(tw) / SUM(w * w) AS ess FROM (SELECT *, SUM(w) OVER (PARTITION BY model, asset ORDER BY score, pos ROWS UNBOUNDED PRECEDING) AS cw, SUM(w) OVER (PARTITION BY model, asset) AS tw FROM (SELECT *, EXP(-{decay}::DOUBLE * (n_cal - 1 - pos)) AS w FROM parts WHERE pos < n_cal)) GROUP BY model, asset"


@query(Shape("decay model asset", "", "q_v ess", 6), f"{S.models()},\n{S.parts()}, every AS ({' UNION ALL '.join(map(_weighted_case, (0.0005, 0.002, 0.01)))})", "every")
def weighted_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, out = conformal.split_paths(paths(spark, sf_dir)), None
    for decay in (0.0005, 0.002, 0.01):
        one = conformal.weighted_qv(parts, ALPHA, decay).withColumn("decay", F.lit(str(decay)))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    Shape("asset", "days", "total_raw total_corr saving_pct"),
    f"{S.models()},\n{S.parts()},\n{S.qv(ALPHA, 'order')},\n{S.TEST}",
    "(SELECT asset, COUNT(*) AS days, SUM(3.65::DOUBLE * ABS(var_raw)) AS total_raw, SUM(3.0::DOUBLE * ABS(var_corr)) AS total_corr, (1 - SUM(3.0::DOUBLE * ABS(var_corr)) / SUM(3.65::DOUBLE * ABS(var_raw))) * 100 AS saving_pct FROM test WHERE model = 'hist_sim' GROUP BY asset)",
)
def capital_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = conformal.split_paths(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA, "order"))
    raw, corr = 3.65 * F.abs("var_raw"), 3.0 * F.abs("var_corr")
    run = Window.partitionBy("asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = test.withColumns({"cum_raw": F.sum(raw).over(run), "cum_corr": F.sum(corr).over(run)})
    last = cumulated.groupBy("asset").agg(F.count("*").alias("days"), F.max_by("cum_raw", "pos").alias("total_raw"), F.max_by("cum_corr", "pos").alias("total_corr"))
    return last.withColumn("saving_pct", (1 - F.col("total_corr") / F.col("total_raw")) * 100)


# --- rolling family --------------------------------------------------------------------------------------

ROLL = f"OVER (PARTITION BY model, asset ORDER BY pos ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)"


def _rolling_query(method: str, expression: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conformal.rolling_qv(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W), ALPHA, W, method)

    f.__name__ = f"rolling_qv_{method}"
    ctes = f"{S.returns()},\n{S.hist_sim(ALPHA, W)}, sc AS (SELECT 'hist_sim' AS model, *, q - r AS score FROM hs), ro AS (SELECT *, {expression} AS q_v FROM sc)"
    return query(Shape("asset date", "pos", "q_v"), ctes, f"ro WHERE pos >= {W}")(f)


_rolling_query("linear", f"quantile_cont(score, 0.99) {ROLL}")
_rolling_query("order", f"list_sort(list(score) {ROLL})[249]")
_rolling_query("hybrid", f"quantile_cont(score, 0.996) {ROLL}")

ROLLING_CTES = f"""{S.models()},
kp AS (SELECT model, asset, date, pos - {W} AS pos, r, q, q - r AS score FROM paths WHERE pos >= {W}),
ro AS (SELECT *, quantile_cont(score, 0.99) {ROLL} AS q_v FROM kp),
test AS (SELECT *, -q AS var_raw, -q + q_v AS var_corr, CAST(r < q AS INT) AS viol_raw, CAST(r < -(-q + q_v) AS INT) AS viol_corr, ABS(q_v) / (ABS(q) + 1e-12::DOUBLE) AS r_t FROM ro WHERE pos >= {W}),
{S.backtest()},
isl AS (SELECT model, asset, r_t > 1 AS f, ROW_NUMBER() OVER (PARTITION BY model, asset ORDER BY pos) - ROW_NUMBER() OVER (PARTITION BY model, asset, r_t > 1 ORDER BY pos) AS i FROM test),
rn AS (SELECT model, asset, f, i, COUNT(*) AS run FROM isl GROUP BY ALL),
mr AS (SELECT model, asset, COALESCE(MAX(CASE WHEN f THEN run END), 0) AS max_run FROM rn GROUP BY ALL),
mm AS (SELECT model, asset, AVG(q_v) AS q_v_mean, STDDEV_POP(q_v) AS q_v_std, AVG(r_t) AS r_mean FROM test GROUP BY ALL),
ra AS (SELECT bt.* EXCLUDE (q_v, ratio, regime), q_v_mean, q_v_std, r_mean, max_run, CASE WHEN max_run >= 20 THEN 'replacement' ELSE 'signal-preserving' END AS regime FROM bt JOIN mr USING (model, asset) JOIN mm USING (model, asset))"""


def _rolling_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir)


@query(Shape("model asset regime zone_raw zone_corr", "n_test viol_raw viol_corr max_run", "q_v_mean q_v_std pi_raw pi_corr qs_corr kupiec_p_corr cc_p_corr", 7), ROLLING_CTES, "ra")
def rolling_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.rolling_audit(_rolling_paths(spark, sf_dir), ALPHA, W, W)


@query(
    Shape("model", "static_green rolling_green", "static_pi rolling_pi"),
    f"{ROLLING_CTES}, sa AS (WITH {S.parts()}, {S.qv()}, test AS (SELECT t.*, q_v, -q AS var_raw, -q + q_v AS var_corr, CAST(r < q AS INT) AS viol_raw, CAST(r < -(-q + q_v) AS INT) AS viol_corr FROM parts t JOIN qv USING (model, asset) WHERE t.pos >= n_cal), {S.backtest()} SELECT * FROM bt)",
    "(SELECT sa.model, SUM(CAST(sa.zone_corr = 'green' AS INT)) AS static_green, SUM(CAST(ra.zone_corr = 'green' AS INT)) AS rolling_green, AVG(sa.pi_corr) AS static_pi, AVG(ra.pi_corr) AS rolling_pi FROM sa JOIN ra USING (model, asset) GROUP BY sa.model)",
)
def rolling_vs_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rolling_paths(spark, sf_dir)
    a = conformal.static_audit(p, ALPHA).select(*PAIR, F.col("zone_corr").alias("static_zone"), F.col("pi_corr").alias("static_pi"))
    b = conformal.rolling_audit(p, ALPHA, W, W).select(*PAIR, "zone_corr", "pi_corr")
    green = lambda c: F.sum((F.col(c) == "green").cast("int"))
    return a.join(b, PAIR).groupBy("model").agg(green("static_zone").alias("static_green"), green("zone_corr").alias("rolling_green"), F.avg("static_pi").alias("static_pi"), F.avg("pi_corr").alias("rolling_pi"))


@query(
    Shape("asset date", "pos", "tv", 9),
    f"""{S.returns()},\n{S.hist_sim(ALPHA, W)}, sc AS (SELECT *, list(q - r) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS s FROM hs),
ed AS (SELECT asset, date, pos, s, list_min(s) AS lo, list_max(s) AS hi FROM sc WHERE pos >= {W}),
bn AS (SELECT asset, date, pos, list_transform(s, lambda x: CASE WHEN hi > lo THEN LEAST(FLOOR((x - lo) / (hi - lo) * 15), 14) ELSE 0 END) AS b FROM ed)""",
    f"(SELECT asset, date, pos, 0.5 * list_sum(list_transform(range(0, 15), lambda k: ABS(len(list_filter(b[1:{W // 2}], lambda x: x = k)) / {W // 2}::DOUBLE - len(list_filter(b[{W // 2 + 1}:{W}], lambda x: x = k)) / {W - W // 2}::DOUBLE))) AS tv FROM bn)",
)
def drift_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.drift(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W), W)


@query(
    Shape("limit_r run_days", "replacements pairs"),
    f"""{ROLLING_CTES}, gr AS (SELECT * FROM (VALUES (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) g(limit_r)),
i2 AS (SELECT limit_r, model, asset, r_t > limit_r AS f, ROW_NUMBER() OVER (PARTITION BY limit_r, model, asset ORDER BY pos) - ROW_NUMBER() OVER (PARTITION BY limit_r, model, asset, r_t > limit_r ORDER BY pos) AS i FROM test, gr),
r2 AS (SELECT limit_r, model, asset, COALESCE(MAX(CASE WHEN f THEN run END), 0) AS max_run FROM (SELECT limit_r, model, asset, f, i, COUNT(*) AS run FROM i2 GROUP BY ALL) GROUP BY ALL)""",
    "(SELECT limit_r, CAST(d AS INT) AS run_days, SUM(CAST(max_run >= d AS INT)) AS replacements, COUNT(*) AS pairs FROM r2, (VALUES (10), (20), (50)) g(d) GROUP BY ALL)",
)
def regime_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rolling_paths(spark, sf_dir).filter(F.col("pos") >= W).withColumn("pos", F.col("pos") - W)
    rolled = conformal.rolling_qv(p, ALPHA, W).withColumn("r_t", F.abs("q_v") / (F.abs("q") + 1e-12))
    grid = rolled.withColumn("limit_r", F.explode(F.array(F.lit(1.2), F.lit(1.5), F.lit(2.0))))
    runs = conformal.longest_run(grid, F.col("r_t") > F.col("limit_r"), "pos", ("limit_r", *PAIR))
    return runs.withColumn("run_days", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50)))).groupBy("limit_r", "run_days").agg(F.sum((F.col("max_run") >= F.col("run_days")).cast("int")).alias("replacements"), F.count("*").alias("pairs"))


# --- scores and expected shortfall -----------------------------------------------------------------------

ES_CTES = f"""{S.returns()},\n{S.rolling_normal(ALPHA, W)}, paths AS (SELECT 'norm_roll' AS model, * FROM nr WHERE pos >= {W} AND es < 0),
wp AS (SELECT * EXCLUDE (pos), ROW_NUMBER() OVER (PARTITION BY model, asset ORDER BY date) - 1 AS pos FROM paths),
{S.parts(0.7, "wp")}"""


def _es_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = forecast.rolling_normal(panels.panel(spark, sf_dir), ALPHA, W).filter((F.col("pos") >= W) & (F.col("es") < 0))
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy(*PAIR).orderBy("date")) - 1)
    return conformal.split_paths(p)


@query(
    Shape("asset", "n", "fz0_pkg fz0_report z2_pkg z2_unstable z2_report"),
    ES_CTES,
    """(SELECT asset, COUNT(*) AS n, AVG(CAST(r < q AS DOUBLE) * (q - r) / (0.01::DOUBLE * es) + q / es - LN(-es + 1e-12::DOUBLE) - 1) AS fz0_pkg,
AVG(CAST(r < q AS DOUBLE) * (r - q) / (0.01::DOUBLE * es) + q / es + LN(-es) - 1) AS fz0_report,
COALESCE(SUM(CASE WHEN r < q THEN r + ABS(es) END) / (SUM(CAST(r < q AS INT)) * (AVG(ABS(es)) + 1e-12::DOUBLE)), 0.0) AS z2_pkg,
COALESCE(AVG(CASE WHEN r < q THEN (r + ABS(es)) / (ABS(es) + 1e-12::DOUBLE) END), 0.0) AS z2_unstable,
SUM(CASE WHEN r < q THEN r ELSE 0 END) / (COUNT(*) * 0.01::DOUBLE * AVG(ABS(es))) + 1 AS z2_report FROM parts WHERE pos >= n_cal GROUP BY asset)""",
)
def shortfall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, q, es, a = F.col("r"), F.col("q"), F.col("es"), stats.d(ALPHA)
    test, hit = _es_parts(spark, sf_dir).filter("role = 'test'"), r < q
    return test.groupBy("asset").agg(
        F.count("*").alias("n"), F.avg(stats.fz0(r, q, es, a)).alias("fz0_pkg"), F.avg(stats.fz0_report(r, q, es, a)).alias("fz0_report"),
        F.coalesce(F.try_divide(F.sum(F.when(hit, r + F.abs(es))), F.sum(hit.cast("int")) * (F.avg(F.abs(es)) + 1e-12)), stats.d(0)).alias("z2_pkg"),
        F.coalesce(F.avg(F.when(hit, (r + F.abs(es)) / (F.abs(es) + 1e-12))), stats.d(0)).alias("z2_unstable"),
        (F.sum(F.when(hit, r).otherwise(0.0)) / (F.count("*") * a * F.avg(F.abs(es))) + 1).alias("z2_report"),
    )


@query(
    Shape("asset", "n_viol", "q_e shift fz0_before fz0_after"),
    f"""{ES_CTES}, cv AS (SELECT asset, list_sort(list(r - es)) AS s, MEDIAN(r - es) AS shift FROM parts WHERE pos < n_cal AND r < q GROUP BY asset),
ce AS (SELECT asset, len(s) AS n_viol, s[CAST(LEAST(CEIL((len(s) + 1.0::DOUBLE) * CAST({1 - ALPHA!r} AS DOUBLE)), len(s)) AS INT)] AS q_e, shift FROM cv),
tt AS (SELECT p.*, n_viol, q_e, shift, LEAST(es + shift, q) AS es2 FROM parts p JOIN ce USING (asset) WHERE pos >= n_cal)""",
    "(SELECT asset, ANY_VALUE(n_viol) AS n_viol, ANY_VALUE(q_e) AS q_e, ANY_VALUE(shift) AS shift, AVG(CAST(r < q AS DOUBLE) * (r - q) / (0.01::DOUBLE * LEAST(es, -1e-10::DOUBLE)) + q / LEAST(es, -1e-10::DOUBLE) + LN(-LEAST(es, -1e-10::DOUBLE)) - 1) AS fz0_before, AVG(CAST(r < q AS DOUBLE) * (r - q) / (0.01::DOUBLE * LEAST(es2, -1e-10::DOUBLE)) + q / LEAST(es2, -1e-10::DOUBLE) + LN(-LEAST(es2, -1e-10::DOUBLE)) - 1) AS fz0_after FROM tt GROUP BY asset)",
)
def shortfall_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _es_parts(spark, sf_dir)
    gap = F.col("r") - F.col("es")
    cal = parts.filter("role = 'cal' and r < q").groupBy("asset").agg(F.array_sort(F.collect_list(gap)).alias("s"), F.percentile(gap, F.lit(0.5)).alias("shift"))
    fit = cal.select("asset", F.size("s").alias("n_viol"), F.element_at("s", stats.order_rank(F.size("s"), stats.d(ALPHA))).alias("q_e"), "shift")
    test = parts.filter("role = 'test'").join(fit, "asset").withColumn("es2", F.least(F.col("es") + F.col("shift"), F.col("q")))
    r, q, a = F.col("r"), F.col("q"), stats.d(ALPHA)
    firsts = [F.first(c).alias(c) for c in ("n_viol", "q_e", "shift")]
    return test.groupBy("asset").agg(*firsts, F.avg(stats.fz0_report(r, q, F.col("es"), a)).alias("fz0_before"), F.avg(stats.fz0_report(r, q, F.col("es2"), a)).alias("fz0_after"))


# --- recalibration ---------------------------------------------------------------------------------------


def recalibration_sql() -> str:
    """CTEs up to pm: the parameters of the closed-form methods that need no recursion."""
    return """hq AS (SELECT model, asset, -quantile_cont(r, 0.01) AS param FROM parts WHERE pos < n_cal GROUP BY ALL),
sc AS (SELECT model, asset, CASE WHEN AVG(CAST(r < q AS DOUBLE)) > 0 THEN 0.01::DOUBLE / AVG(CAST(r < q AS DOUBLE)) ELSE 1 END AS param FROM parts WHERE pos < n_cal GROUP BY ALL),
pm AS (SELECT model, asset, 'shift' AS method, q_v AS param FROM qv UNION ALL SELECT model, asset, 'hist_quantile', param FROM hq UNION ALL SELECT model, asset, 'scale', param FROM sc)"""


@query(
    Shape("model asset method", "n_test viol", "param qs", 7),
    f"""{S.models()},\n{S.parts()},\n{S.qv()},
{recalibration_sql()},
ap AS (SELECT p.*, method, param, CASE method WHEN 'shift' THEN -q + param WHEN 'hist_quantile' THEN param ELSE -q * param END AS v FROM parts p JOIN pm USING (model, asset) WHERE pos >= n_cal)""",
    f"(SELECT model, asset, method, COUNT(*) AS n_test, SUM(CAST(r < -v AS INT)) AS viol, ANY_VALUE(param) AS param, AVG({S.pinball('r', '(-v)', '0.01::DOUBLE')}) AS qs FROM ap GROUP BY ALL)",
)
def recalibration_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = conformal.split_paths(paths(spark, sf_dir))
    params = recalibrate.fit_shift(parts).unionByName(recalibrate.fit_hist_quantile(parts)).unionByName(recalibrate.fit_scale(parts))
    return _by_method(recalibrate.apply(parts, params))


def _by_method(applied: DataFrame) -> DataFrame:
    qs = stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(ALPHA))
    return applied.groupBy(*PAIR, "method").agg(F.count("*").alias("n_test"), F.sum("viol_corr").alias("viol"), F.first("param").alias("param"), F.avg(qs).alias("qs"))


@query(
    Shape("model asset method", "n_test viol", "param qs", 7),
    f"""{S.models()},\n{S.parts()},
ord AS (SELECT model, asset, list(CAST(r < q AS DOUBLE) ORDER BY pos) AS vs, list_sort(list(score)) AS s FROM parts WHERE pos < n_cal GROUP BY ALL),
lv AS (SELECT model, asset, s, 1.0::DOUBLE - list_reduce(list_prepend(0.01::DOUBLE, vs), lambda a, v: greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, a + 0.05::DOUBLE * (0.01::DOUBLE - v)))) AS lvl FROM ord),
pt AS (SELECT model, asset, s, lvl * (len(s) - 1) AS pt_ FROM lv),
pm AS (SELECT model, asset, s[CAST(FLOOR(pt_) AS INT) + 1] + (s[LEAST(CAST(FLOOR(pt_) AS INT) + 2, len(s))] - s[CAST(FLOOR(pt_) AS INT) + 1]) * (pt_ - FLOOR(pt_)) AS param FROM pt),
ap AS (SELECT p.*, 'aci' AS method, param, -q + param AS v FROM parts p JOIN pm USING (model, asset) WHERE pos >= n_cal)""",
    f"(SELECT model, asset, method, COUNT(*) AS n_test, SUM(CAST(r < -v AS INT)) AS viol, ANY_VALUE(param) AS param, AVG({S.pinball('r', '(-v)', '0.01::DOUBLE')}) AS qs FROM ap GROUP BY ALL)",
)
def recalibration_aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = conformal.split_paths(paths(spark, sf_dir))
    return _by_method(recalibrate.apply(parts, recalibrate.fit_aci(parts)))


@query(Shape("model asset method", "n_test viol", "param qs", 6))
def recalibration_fhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = conformal.split_paths(paths(spark, sf_dir))
    return _by_method(recalibrate.apply(parts, recalibrate.fit_fhs(parts)))


# --- panel inference -------------------------------------------------------------------------------------

PANEL_CTES = f"{S.models(ALPHA, WC, 'c')},\n{S.parts()},\n{S.qv()},\n{S.TEST},\n{S.backtest()}"


def _panel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.static_audit(paths(spark, sf_dir, "c", ALPHA, WC), ALPHA)


def _pooled_sql(keys: str, source: str) -> str:
    lr = "(CASE WHEN x = 0 OR x = n THEN 0.0 ELSE greatest(0.0, " + S.kupiec_lr("x", "n", "0.01::DOUBLE") + ") END)"
    return f"(SELECT *, {S.chi2_sf1('kupiec_lr')} AS kupiec_p, CASE WHEN se_cluster > 0 THEN (pi - 0.01::DOUBLE) / se_cluster END AS z_cluster FROM (SELECT *, x::DOUBLE / n AS pi, {lr} AS kupiec_lr FROM (SELECT {keys}, COUNT(*) AS n_assets, SUM(viol_corr) AS x, SUM(n_test) AS n, SQRT(VAR_SAMP(viol_corr::DOUBLE / n_test) / COUNT(*)) AS se_cluster FROM {source} GROUP BY ALL)))"


POOLED = "pi kupiec_lr kupiec_p se_cluster z_cluster"


@query(Shape("model", "n_assets x n", POOLED, 7), PANEL_CTES, _pooled_sql("model", "bt"))
def panel_kupiec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.pooled_kupiec(_panel_facts(spark, sf_dir), ALPHA)


@query(
    Shape("model class", "n_assets x n", POOLED, 7),
    f"{PANEL_CTES}, cl AS (SELECT n_name AS asset, r_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey), bc AS (SELECT * FROM bt JOIN cl USING (asset))",
    _pooled_sql("model, class", "bc"),
)
def panel_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.pooled_kupiec(_panel_facts(spark, sf_dir).join(panels.classes(spark, sf_dir), "asset"), ALPHA, ("model", "class"))


def _losses(test: DataFrame) -> DataFrame:
    """model, asset, pos, loss; written, as comparisons read it several times."""
    return scratch.written(test.select("model", "asset", "pos", stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(ALPHA)).alias("loss")), "losses")


def _test_rows(spark: SparkSession, sf_dir: str, kind: str, window: int) -> DataFrame:
    parts = scratch.written(conformal.split_paths(paths(spark, sf_dir, kind, ALPHA, window)), "parts")
    return conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA))


PAIRS_CTE = f"ls AS (SELECT model, asset, pos, {S.pinball('r', '(-var_corr)', '0.01::DOUBLE')} AS loss FROM test), pr AS (SELECT a.model AS model_a, b.model AS model_b, asset, pos, a.loss - b.loss AS diff FROM ls a JOIN ls b USING (asset, pos) WHERE a.model < b.model)"


@query(
    Shape("model_a model_b asset", "n", "mean_diff dm p_value", 7),
    f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}, {PAIRS_CTE}, dm AS (SELECT model_a, model_b, asset, COUNT(*) AS n, AVG(diff) AS mean_diff, AVG(diff) / SQRT(GREATEST(VAR_POP(diff), 1e-20) / COUNT(*)) * SQRT((COUNT(*) - 1)::DOUBLE / COUNT(*)) AS dm FROM pr GROUP BY ALL)",
    f"(SELECT *, {S.two_sided_p('dm')} AS p_value FROM dm)",
)
def dm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.diebold_mariano(inference.loss_pairs(_losses(_test_rows(spark, sf_dir, "a", W))))


@query(
    Shape("model_a model_b", "n lags", "mean_diff dm p_value", 7),
    f"""{S.models(ALPHA, WC, 'c')},\n{S.parts()},\n{S.qv()},\n{S.TEST}, {PAIRS_CTE},
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_a, model_b, asset ORDER BY pos DESC) AS rpos FROM pr),
mn AS (SELECT model_a, model_b, MIN(n) AS n_min FROM (SELECT model_a, model_b, asset, COUNT(*) AS n FROM pr GROUP BY ALL) GROUP BY ALL),
st AS (SELECT model_a, model_b, n_min - rpos AS t, SUM(diff) AS s FROM rk JOIN mn USING (model_a, model_b) WHERE rpos <= n_min GROUP BY ALL),
lg AS (SELECT *, LAG(s) OVER (PARTITION BY model_a, model_b ORDER BY t) AS ps, s - AVG(s) OVER (PARTITION BY model_a, model_b) AS e FROM st),
bw AS (SELECT model_a, model_b, COUNT(*) AS n, AVG(s) AS mean_diff, SUM(e * e) / COUNT(*) AS g0, GREATEST(-0.99, LEAST(0.99, COALESCE(CORR(s, ps), 0))) AS rho FROM lg GROUP BY ALL),
bl AS (SELECT *, CAST(LEAST(CEIL(1.1447::DOUBLE * POW(4 * rho * rho / POW((1 - rho) * (1 + rho), 2) * n, 1.0::DOUBLE / 3)), n - 1) AS INT) AS lags FROM bw),
gk AS (SELECT a.model_a, a.model_b, a.t - b.t AS k, SUM(a.e * b.e) AS g FROM lg a JOIN lg b ON a.model_a = b.model_a AND a.model_b = b.model_b AND a.t > b.t AND a.t - b.t <= 200 GROUP BY ALL),
kw AS (SELECT bl.model_a, bl.model_b, SUM(2.0::DOUBLE * (1 - k / (lags + 1.0::DOUBLE)) * g / n) AS tail FROM bl JOIN gk ON bl.model_a = gk.model_a AND bl.model_b = gk.model_b AND k <= lags GROUP BY ALL),
lv AS (SELECT bl.*, g0 + COALESCE(tail, 0) AS long_run FROM bl LEFT JOIN kw USING (model_a, model_b)),
dm AS (SELECT *, mean_diff / SQRT(GREATEST(long_run, 1e-20) / n) * SQRT((n - 1)::DOUBLE / n) AS dm FROM lv)""",
    f"(SELECT *, {S.two_sided_p('dm')} AS p_value FROM dm)",
)
def panel_dm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.hac_dm(inference.tail_aligned(inference.loss_pairs(_losses(_test_rows(spark, sf_dir, "c", WC)))))


@query(Shape("model", "", "lr p_boot", 7), PANEL_CTES + f""", ax AS (SELECT model, asset, viol_corr AS x, n_test AS n FROM bt),
dr AS (SELECT model, d, SUM(CASE WHEN md5('42:' || d || ':' || asset)[1] < '8' THEN x ELSE 0 END) AS x, SUM(n) AS n FROM ax, range(1, 1000) g(d) GROUP BY ALL),
l1 AS (SELECT model, {S.kupiec_lr('x', 'n', '0.01::DOUBLE')} AS lr FROM dr), l0 AS (SELECT model, {S.kupiec_lr('SUM(x)', 'SUM(n)', '0.01::DOUBLE')} AS lr FROM ax GROUP BY model)""",
       "(SELECT model, l0.lr AS lr, AVG(CAST(ROUND(l1.lr, 9) >= ROUND(l0.lr, 9) AS DOUBLE)) AS p_boot FROM l1 JOIN l0 USING (model) GROUP BY ALL)")
def wild_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.wild_cluster_kupiec(_panel_facts(spark, sf_dir))


@query(
    Shape("", "n_obs", "beta0 beta1 beta2 r2", 6),
    f"{PANEL_CTES}, rg AS (SELECT qs_raw - qs_corr AS y, q_v AS x1, pi_raw AS x2 FROM bt), b AS (SELECT COUNT(*) AS n_obs, REGR_SLOPE(y, x1) AS s, COVAR_SAMP(x1, x1) AS c11, COVAR_SAMP(x2, x2) AS c22, COVAR_SAMP(x1, x2) AS c12, COVAR_SAMP(x1, y) AS c1y, COVAR_SAMP(x2, y) AS c2y, COVAR_SAMP(y, y) AS cyy, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2 FROM rg), bb AS (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS beta1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS beta2 FROM b)",
    "(SELECT *, my - beta1 * m1 - beta2 * m2 AS beta0, (beta1 * c1y + beta2 * c2y) / cyy AS r2 FROM bb)",
)
def diagnostic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _panel_facts(spark, sf_dir).withColumn("gain", F.col("qs_raw") - F.col("qs_corr"))
    return inference.regress(facts, "gain", "q_v", "pi_raw", "asset")


@query(
    Shape("asset", "n_obs", "annual_vol kurtosis_pop kurtosis_adj autocorr1 tail_one_sided tail_two_sided", 6),
    f"{S.returns('c')}, ml AS (SELECT *, LAG(r) OVER (PARTITION BY asset ORDER BY date) AS p, AVG(r) OVER (PARTITION BY asset) AS mu, STDDEV_SAMP(r) OVER (PARTITION BY asset) AS s1, STDDEV_POP(r) OVER (PARTITION BY asset) AS s0 FROM ret), kk AS (SELECT asset, COUNT(*) AS n_obs, STDDEV_SAMP(r) * SQRT(252.0::DOUBLE) AS annual_vol, KURTOSIS_POP(r) AS kurtosis_pop, CORR(r, p) AS autocorr1, AVG(CAST(r < mu - 3 * s1 AS DOUBLE)) AS tail_one_sided, AVG(CAST(ABS(r - mu) > 3 * s0 AS DOUBLE)) AS tail_two_sided FROM ml GROUP BY asset)",
    "(SELECT *, (n_obs - 1)::DOUBLE / ((n_obs - 2) * (n_obs - 3)) * ((n_obs + 1) * kurtosis_pop + 6) AS kurtosis_adj FROM kk)",
)
def asset_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.characteristics(panels.panel(spark, sf_dir, "c"))


@query(
    Shape("model", "n_assets", "corr_vol corr_kurt corr_auto", 6),
    f"{PANEL_CTES}, ml AS (SELECT *, LAG(r) OVER (PARTITION BY asset ORDER BY date) AS p FROM ret), kk AS (SELECT asset, STDDEV_SAMP(r) AS v, KURTOSIS_POP(r) AS k, CORR(r, p) AS a1 FROM ml GROUP BY asset)",
    "(SELECT model, COUNT(*) AS n_assets, CORR(q_v, v) AS corr_vol, CORR(q_v, k) AS corr_kurt, CORR(q_v, a1) AS corr_auto FROM bt JOIN kk USING (asset) WHERE model <> 'const_zero' GROUP BY model)",
)
def cross_sectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = returns.characteristics(panels.panel(spark, sf_dir, "c"))
    joined = _panel_facts(spark, sf_dir).filter("model <> 'const_zero'").join(about, "asset")
    return joined.groupBy("model").agg(F.count("*").alias("n_assets"), F.corr("q_v", "annual_vol").alias("corr_vol"), F.corr("q_v", "kurtosis_pop").alias("corr_kurt"), F.corr("q_v", "autocorr1").alias("corr_auto"))
