"""Datasets behind figures and smaller report tables, over the facts and paths of `report`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import conformal, forecast, inference
from vartide.plans import api
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.plans.report import ALPHA, AUDIT_CTES, PAIR, PAIRS_CTE, ROLL, W, full_facts, paths
from vartide.plans.report import FACTS_SQL as FACTS
from vartide.plans.report import PANEL_CTES, WC, _losses, _panel_facts, _test_rows
from vartide.sources import panels


@query(
    Shape("model", "pairs replacement preserving green yellow red", "replaced_share"),
    AUDIT_CTES,
    "(SELECT model, COUNT(*) AS pairs, SUM(CAST(regime = 'replacement' AS INT)) AS replacement, SUM(CAST(regime <> 'replacement' AS INT)) AS preserving, SUM(CAST(zone_corr = 'green' AS INT)) AS green, SUM(CAST(zone_corr = 'yellow' AS INT)) AS yellow, SUM(CAST(zone_corr = 'red' AS INT)) AS red, AVG(CAST(regime = 'replacement' AS DOUBLE)) AS replaced_share FROM bt GROUP BY model)",
)
def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.regime_summary(conformal.static_audit(paths(spark, sf_dir), ALPHA))


@query(
    Shape("model band", "rank", "mean_q_v"),
    AUDIT_CTES,
    "(SELECT model, CASE WHEN ABS(mean_q_v) < 0.5 THEN 'small' WHEN ABS(mean_q_v) < 2 THEN 'medium' ELSE 'large' END AS band, ROW_NUMBER() OVER (ORDER BY mean_q_v DESC, model) AS rank, mean_q_v FROM (SELECT model, AVG(q_v) AS mean_q_v FROM bt GROUP BY model))",
)
def qv_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_model = conformal.static_audit(paths(spark, sf_dir), ALPHA).groupBy("model").agg(F.avg("q_v").alias("mean_q_v"))
    size = F.abs("mean_q_v")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_q_v"), "model")  # one row per model
    return by_model.withColumns({"band": F.when(size < 0.5, "small").when(size < 2, "medium").otherwise("large"), "rank": F.row_number().over(order)})


@query(
    Shape("model asset zone_report_corr", "", "yearly"),
    AUDIT_CTES,
    "(SELECT model, asset, zone_report_corr, viol_corr * 250.0::DOUBLE / n_test AS yearly FROM bt)",
)
def yearly_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.static_audit(paths(spark, sf_dir), ALPHA).select("model", "asset", "zone_report_corr", (F.col("viol_corr") * 250.0 / F.col("n_test")).alias("yearly"))


@query(
    Shape("model", "", "pi weighted_pi calibration_gap width"),
    AUDIT_CTES,
    "(SELECT model, AVG(pi_corr) AS pi, SUM(pi_corr * n_test) / SUM(n_test) AS weighted_pi, AVG(ABS(pi_corr - 0.01::DOUBLE)) AS calibration_gap, AVG(width_corr) AS width FROM bt GROUP BY model)",
)
def efficiency_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pi, n = F.col("pi_corr"), F.col("n_test")
    return conformal.static_audit(paths(spark, sf_dir), ALPHA).groupBy("model").agg(F.avg(pi).alias("pi"), (F.sum(pi * n) / F.sum(n)).alias("weighted_pi"), F.avg(F.abs(pi - ALPHA)).alias("calibration_gap"), F.avg("width_corr").alias("width"))


@query(
    Shape("asset", "", "best_alpha qs"),
    FACTS,
    "(SELECT asset, ARG_MIN(alpha, qs_corr) AS best_alpha, MIN(qs_corr) AS qs FROM facts WHERE model = 'norm_roll' GROUP BY asset)",
)
def best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = full_facts(spark, sf_dir).filter("model = 'norm_roll'")
    return f.groupBy("asset").agg(F.min_by("alpha", "qs_corr").alias("best_alpha"), F.min("qs_corr").alias("qs"))


@query(
    Shape("asset", "bin n"),
    f"{S.returns()}, b AS (SELECT asset, r, MIN(r) OVER (PARTITION BY asset) AS lo, MAX(r) OVER (PARTITION BY asset) AS hi FROM ret)",
    "(SELECT asset, CAST(LEAST(FLOOR((r - lo) / (hi - lo) * 20), 19) AS INT) AS bin, COUNT(*) AS n FROM b GROUP BY ALL)",
)
def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("asset")
    r = panels.panel(spark, sf_dir).withColumns({"lo": F.min("r").over(w), "hi": F.max("r").over(w)})
    return r.groupBy("asset", F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    Shape("asset period", "days", "mean_q_v violations"),
    f"{S.returns()},\n{S.hist_sim(ALPHA, W)}, sc AS (SELECT 'hist_sim' AS model, *, q - r AS score FROM hs), ro AS (SELECT *, quantile_cont(score, 0.99) {ROLL} AS q_v FROM sc), pe AS (SELECT *, CASE WHEN date < DATE '1996-01-01' THEN 'early' WHEN date < DATE '1998-01-01' THEN 'middle' ELSE 'late' END AS period FROM ro WHERE pos >= {W})",
    "(SELECT asset, period, COUNT(*) AS days, AVG(q_v) AS mean_q_v, AVG(CAST(r < q - q_v AS DOUBLE)) AS violations FROM pe GROUP BY ALL)",
)
def rolling_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conformal.rolling_qv(forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W), ALPHA, W)
    period = F.when(F.col("date") < "1996-01-01", "early").when(F.col("date") < "1998-01-01", "middle").otherwise("late")
    return rows.groupBy("asset", period.alias("period")).agg(F.count("*").alias("days"), F.avg("q_v").alias("mean_q_v"), F.avg((F.col("r") < F.col("q") - F.col("q_v")).cast("double")).alias("violations"))


@query(
    Shape("asset first_alarm first_count_alarm", "lag_days"),
    f"""{S.returns()},\n{S.hist_sim(ALPHA, W)}, sc AS (SELECT 'hist_sim' AS model, *, q * 0.5::DOUBLE - r AS score FROM hs), ro AS (SELECT *, quantile_cont(score, 0.99) {ROLL} AS q_v, SUM(CAST(r < q * 0.5::DOUBLE AS INT)) OVER (PARTITION BY model, asset ORDER BY pos ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS x FROM sc),
al AS (SELECT asset, MIN(CASE WHEN ABS(q_v) > ABS(q * 0.5::DOUBLE) THEN date END) AS first_alarm, MIN(CASE WHEN x >= 10 THEN date END) AS first_count_alarm FROM ro WHERE pos >= {W} GROUP BY asset)""",
    "(SELECT *, date_diff('day', first_alarm, first_count_alarm) AS lag_days FROM al)",
)
def detection_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day on which the rolling correction outgrows the forecast, and on which violations pass the yellow
    zone, for a forecast of half size."""
    p = forecast.hist_sim(panels.panel(spark, sf_dir), ALPHA, W).withColumn("q", F.col("q") * 0.5)
    w = Window.partitionBy(*PAIR).orderBy("pos").rowsBetween(-W, -1)
    rolled = conformal.rolling_qv(p.withColumn("x", F.sum((F.col("r") < F.col("q")).cast("int")).over(w)), ALPHA, W)
    alarms = rolled.groupBy("asset").agg(F.min(F.when(F.abs("q_v") > F.abs("q"), F.col("date"))).alias("first_alarm"), F.min(F.when(F.col("x") >= 10, F.col("date"))).alias("first_count_alarm"))
    return alarms.withColumn("lag_days", F.date_diff("first_count_alarm", "first_alarm"))


@query(
    Shape("", "n_cal gap", "rho delta guaranteed"),
    "g AS (SELECT CAST(n AS BIGINT) AS n_cal, rho FROM (VALUES (250), (500), (1000), (2000), (4000)) a(n), (VALUES (0.05::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) b(rho))",
    "(SELECT n_cal, rho, CAST(CEIL(1.0::DOUBLE / ABS(LN(rho)) * LN(n_cal::DOUBLE)) AS INT) AS gap, 2.5 * SQRT(LN(n_cal::DOUBLE) / n_cal) AS delta, (1 - 0.01::DOUBLE - 2.5::DOUBLE * SQRT(LN(n_cal::DOUBLE) / n_cal)) * 100 AS guaranteed FROM g)",
)
def practitioner_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration sizes by dependence: the gap to leave and the coverage that the bound guarantees."""
    sizes, rhos = F.array(*map(F.lit, (250, 500, 1000, 2000, 4000))), F.array(*map(stats.d, (0.05, 0.2, 0.5)))
    grid = spark.range(1).select(F.explode(sizes).alias("n_cal")).withColumn("rho", F.explode(rhos))
    n = F.col("n_cal").cast("double")
    return grid.select("n_cal", "rho", F.ceil(1.0 / F.abs(F.ln("rho")) * F.ln(n)).alias("gap"), (2.5 * F.sqrt(F.ln(n) / n)).alias("delta"), conformal.coverage_bound(F.col("n_cal")).alias("guaranteed"))


@query(
    Shape("asset model_a", "", "hist_sim norm_roll scaled_05 scaled_12", 6),
    f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}, {PAIRS_CTE}, dm AS (SELECT asset, model_a, model_b, AVG(diff) / SQRT(GREATEST(VAR_POP(diff), 1e-20) / COUNT(*)) * SQRT((COUNT(*) - 1)::DOUBLE / COUNT(*)) AS dm FROM pr GROUP BY ALL), pv AS (SELECT asset, model_a, model_b, {S.two_sided_p('dm')} AS p FROM dm)",
    "(SELECT asset, model_a, MAX(CASE WHEN model_b = 'hist_sim' THEN p END) AS hist_sim, MAX(CASE WHEN model_b = 'norm_roll' THEN p END) AS norm_roll, MAX(CASE WHEN model_b = 'scaled_05' THEN p END) AS scaled_05, MAX(CASE WHEN model_b = 'scaled_12' THEN p END) AS scaled_12 FROM pv GROUP BY asset, model_a)",
)
def dm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of all pairs of models, a matrix for every asset."""
    parts = conformal.split_paths(paths(spark, sf_dir))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA))
    losses = test.select("model", "asset", "pos", stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(ALPHA)).alias("loss"))
    tests = inference.diebold_mariano(inference.loss_pairs(losses))
    return tests.groupBy("asset", "model_a").pivot("model_b", ["hist_sim", "norm_roll", "scaled_05", "scaled_12"]).agg(F.first("p_value"))


@query(
    Shape("asset model_a", "", "hist_sim norm_roll scaled_05 scaled_12", 6),
    f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}, {PAIRS_CTE}, dm AS (SELECT asset, model_a, model_b, AVG(diff) / SQRT(GREATEST(VAR_POP(diff), 1e-20) / COUNT(*)) * SQRT((COUNT(*) - 1)::DOUBLE / COUNT(*)) AS dm FROM pr GROUP BY ALL), pv AS (SELECT asset, model_a, model_b, {S.two_sided_p('dm')} AS p FROM dm)",
    "(SELECT asset, model_a, MAX(CASE WHEN model_b = 'hist_sim' THEN p END) AS hist_sim, MAX(CASE WHEN model_b = 'norm_roll' THEN p END) AS norm_roll, MAX(CASE WHEN model_b = 'scaled_05' THEN p END) AS scaled_05, MAX(CASE WHEN model_b = 'scaled_12' THEN p END) AS scaled_12 FROM pv GROUP BY asset, model_a)",
)
def dm_matrix_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return dm_matrix(spark, sf_dir)


@query(
    Shape("model_a model_b asset", "", "dm"),
    f"{S.models()},\n{S.parts()},\n{S.qv()},\n{S.TEST}, {PAIRS_CTE}, dm AS (SELECT model_a, model_b, asset, AVG(diff) / SQRT(GREATEST(VAR_POP(diff), 1e-20) / COUNT(*)) * SQRT((COUNT(*) - 1)::DOUBLE / COUNT(*)) AS dm FROM pr GROUP BY ALL)",
    "(SELECT model_a, model_b, asset, dm FROM dm ORDER BY ROUND(ABS(dm), 9) DESC, model_a, model_b, asset LIMIT 20)",
)
def dm_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty strongest comparisons, a report of fixed length."""
    parts = conformal.split_paths(paths(spark, sf_dir))
    test = conformal.apply_shift(parts, conformal.fit_static(parts, ALPHA))
    losses = test.select("model", "asset", "pos", stats.pinball(F.col("r"), -F.col("var_corr"), stats.d(ALPHA)).alias("loss"))
    return inference.diebold_mariano(inference.loss_pairs(losses)).orderBy(F.round(F.abs("dm"), 9).desc(), "model_a", "model_b", "asset").limit(20)


@query(
    Shape("event_type", "n gaps", "mean_value median_value last_value"),
    "e AS (SELECT *, LAG(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)",
    "(SELECT event_type, COUNT(*) AS n, SUM(CAST(CAST(ts AS DATE) - CAST(before AS DATE) > 0 AS INT)) AS gaps, AVG(value) AS mean_value, MEDIAN(value) AS median_value, ARG_MAX(value, (ts, event_id)) AS last_value FROM e GROUP BY event_type)",
)
def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = panels.table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    days = F.date_diff(F.to_date("ts"), F.to_date("before"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((days > 0).cast("int")).alias("gaps"), F.avg("value").alias("mean_value"), F.percentile("value", F.lit(0.5)).alias("median_value"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query(
    Shape("asset part", "n", "mean_r"),
    f"{S.returns('b')}, cu AS (SELECT *, NTILE(3) OVER (PARTITION BY asset ORDER BY pos) AS k FROM ret)",
    "(SELECT asset, CASE k WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'third' END AS part, COUNT(*) AS n, AVG(r) AS mean_r FROM cu GROUP BY ALL)",
)
def segment_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns by market segment, in thirds of each segment's history."""
    k = F.ntile(3).over(Window.partitionBy("asset").orderBy("pos"))
    r = panels.panel(spark, sf_dir, "b").withColumn("part", F.when(k == 1, "first").when(k == 2, "second").otherwise("third"))
    return r.groupBy("asset", "part").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"))


SIGN = "CASE WHEN md5('42:' || d || ':' || asset)[1] < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
CLUSTER = f"{PANEL_CTES}, {PAIRS_CTE}, cm AS (SELECT model_a, model_b, asset, AVG(diff) AS m FROM pr GROUP BY ALL), ct AS (SELECT model_a, model_b, COUNT(*) AS clusters, AVG(m) AS mean_diff, STDDEV_SAMP(m) / SQRT(COUNT(*)) AS se FROM cm GROUP BY ALL), tt AS (SELECT *, CASE WHEN se > 0 THEN mean_diff / se ELSE 0 END AS t FROM ct)"


@query(
    Shape("model", "", "lr p_boot", 7),
    PANEL_CTES + f""", ax AS (SELECT model, asset, viol_corr::DOUBLE AS x, n_test::DOUBLE AS n FROM bt),
dr AS (SELECT model, d, ROUND(SUM(0.01::DOUBLE * n + {SIGN} * (x - 0.01::DOUBLE * n)), 9) AS x0, SUM(n) AS n FROM ax, range(1, 1000) g(d) GROUP BY ALL), dc AS (SELECT model, GREATEST(0.0, LEAST(x0, n)) AS x, n FROM dr),
l1 AS (SELECT model, {S.kupiec_lr('x', 'n', '0.01::DOUBLE')} AS lr FROM dc), l0 AS (SELECT model, {S.kupiec_lr('SUM(x)', 'SUM(n)', '0.01::DOUBLE')} AS lr FROM ax GROUP BY model)""",
    "(SELECT model, l0.lr AS lr, (SUM(CAST(ROUND(l1.lr, 9) >= ROUND(l0.lr, 9) AS INT)) + 1) / 1000.0::DOUBLE AS p_boot FROM l1 JOIN l0 USING (model) GROUP BY ALL)",
)
def wild_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.wild_cluster_kupiec_report(_panel_facts(spark, sf_dir))


def _panel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.loss_pairs(_losses(_test_rows(spark, sf_dir, "c", WC)))


@query(Shape("model_a model_b", "clusters", "mean_diff se t", 7), CLUSTER, "tt")
def dm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.cluster_dm(_panel_pairs(spark, sf_dir))


@query(Shape("model_a model_b", "clusters", "t p_value", 6))
def dm_clusters_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.t_p_value(inference.cluster_dm(_panel_pairs(spark, sf_dir)).withColumn("dof", (F.col("clusters") - 1).cast("double")))


@query(
    Shape("model_a model_b", "", "t p_boot", 6),
    f"{CLUSTER}, dw AS (SELECT model_a, model_b, d, AVG((m - mean_diff) * {SIGN}) AS db, STDDEV_SAMP((m - mean_diff) * {SIGN}) / SQRT(COUNT(*)) AS s FROM cm JOIN ct USING (model_a, model_b), range(1, 1000) g(d) GROUP BY ALL)",
    "(SELECT model_a, model_b, ANY_VALUE(t) AS t, CASE WHEN ANY_VALUE(se) > 0 THEN (SUM(CAST(ROUND(ABS(CASE WHEN s > 0 THEN db / s ELSE 0 END), 9) >= ROUND(ABS(t), 9) AS INT)) + 1) / 1000.0::DOUBLE ELSE 1 END AS p_boot FROM dw JOIN tt USING (model_a, model_b) GROUP BY ALL)",
)
def wild_cluster_dm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.wild_cluster_dm(_panel_pairs(spark, sf_dir))
