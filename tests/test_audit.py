"""Closed-form edge cases, invariances and plain numpy twins of the audit operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vartide.functions import numeric, stats
from vartide.operators import conformal, fit, forecast, inference, recalibrate, returns, simulate
from vartide.operators import distributions as D
from tests_support import series


def values(spark, **columns):
    return spark.range(1).select(*[c.cast("double").alias(n) if n[0] != "_" else c.alias(n) for n, c in columns.items()]).first()


def test_tail_probabilities(spark):
    v = values(spark, a=stats.chi2_sf1(F.lit(3.841458820694124)), b=stats.chi2_sf2(F.lit(5.991464547107979)), c=stats.normal_cdf(F.lit(-2.3263478740408408)), d=stats.erf(F.lit(0.0)), e=stats.chi2_sf1(F.lit(0.0)), f=stats.erf(F.lit(9.0)))
    assert v.a == pytest.approx(0.05, abs=1e-12) and v.b == pytest.approx(0.05, abs=1e-12) and v.c == pytest.approx(0.01, abs=1e-12)
    assert (v.d, v.e, v.f) == (0.0, 1.0, 1.0)


def test_kupiec_edges(spark):
    k = lambda x, n: stats.kupiec_lr(F.lit(x), F.lit(n), F.lit(0.01))
    v = values(spark, none=k(0, 250), every=k(5, 5), even=k(1, 100), empty=stats.kupiec_p(F.lit(0), F.lit(0), F.lit(0.01)))
    assert v.none == pytest.approx(-500 * math.log(0.99), abs=1e-10) and v.every == pytest.approx(-10 * math.log(0.01))
    assert v.even == pytest.approx(0, abs=1e-9) and v.empty == 1


def test_zones(spark):
    row = spark.range(1).select(*[stats.basel_zone(F.lit(x), F.lit(n)).alias(f"z{k}") for k, (x, n) in enumerate([(4, 250), (5, 250), (9, 250), (10, 250), (0, 0), (2, 100), (9, 500)])]).first()
    assert list(row) == ["green", "yellow", "yellow", "red", "green", "yellow", "yellow"]


def test_dependence(spark):
    v = values(spark, zero=stats.transition_lr(*map(F.lit, (100, 0, 0, 0))), some=stats.transition_lr(*map(F.lit, (90, 5, 2, 3))), none=F.coalesce(stats.transition_p_report(*map(F.lit, (100, 0, 0, 0))), F.lit(-1)))
    p01, p11, p = 5 / 95, 3 / 5, 8 / 100
    want = 2 * (90 * math.log((1 - p01) / (1 - p)) + 5 * math.log(p01 / p) + 2 * math.log((1 - p11) / (1 - p)) + 3 * math.log(p11 / p))
    assert v.zero == 0 and v.some == pytest.approx(want) and v.none == -1


def test_scores(spark):
    r, q, e, a = F.lit(-0.03), F.lit(-0.02), F.lit(-0.025), F.lit(0.01)
    v = values(spark, qs=stats.pinball(r, q, a), f=stats.fz0(r, q, e, a), g=stats.fz0_report(r, q, e, a))
    assert v.qs == pytest.approx(0.99 * 0.01)
    assert v.f == pytest.approx(0.01 / (0.01 * -0.025) + 0.8 - math.log(0.025 + 1e-12) - 1) and v.g == pytest.approx(-0.01 / (0.01 * -0.025) + 0.8 + math.log(0.025) - 1)


def test_positions_and_wide_panels(spark):
    wide = spark.createDataFrame([("2020-01-01", 1.0, None), ("2020-01-02", float("nan"), 2.0), ("2020-01-03", 3.0, 4.0)], "date string, x double, y double").withColumn("date", F.to_date("date"))
    got = sorted((r.asset, r.pos, r.r) for r in returns.from_wide(wide).collect())
    assert got == [("x", 0, 1.0), ("x", 1, 3.0), ("y", 0, 2.0), ("y", 1, 4.0)]


def test_static_correction_against_numpy(spark):
    rs = series(spark)
    path = forecast.hist_sim(rs, 0.05, 50)
    parts = conformal.split_paths(path)
    pdf = path.toPandas().sort_values(["asset", "pos"])
    for method in ("linear", "order", "hybrid"):
        got = {r.asset: r.q_v for r in conformal.fit_static(parts, 0.05, method).collect()}
        for asset, g in pdf.groupby("asset"):
            s = np.sort((g.q - g.r).to_numpy()[: int(len(g) * 0.7)])
            k = min(math.ceil((len(s) + 1) * (1 - 0.05)), len(s))
            want = {"linear": np.quantile(s, 0.95), "order": s[k - 1], "hybrid": np.quantile(s, k / len(s))}[method]
            assert got[asset] == pytest.approx(want, abs=1e-12)


def test_rolling_and_drift_against_numpy(spark):
    path = forecast.constant(series(spark, 160, 1), -0.02, "c")
    s = np.array([-0.02 - r.r for r in path.orderBy("pos").collect()])
    got = [r.q_v for r in conformal.rolling_qv(path, 0.05, 60).orderBy("pos").collect()]
    assert np.allclose(got, [np.quantile(s[t - 60 : t], 0.95) for t in range(60, len(s))])
    tv = [r.tv for r in conformal.drift(path, 60).orderBy("pos").collect()]
    for t, v in zip(range(60, len(s)), tv, strict=True):
        w = s[t - 60 : t]
        edges = np.linspace(w.min(), w.max(), 8)
        a, b = (np.histogram(x, edges)[0] / 30 for x in (w[:30], w[30:]))
        assert v == pytest.approx(0.5 * np.abs(a - b).sum(), abs=0.04)  # one score on an edge may fall to either side


def test_audit_is_scale_equivariant(spark):
    rs = series(spark)
    a = {r.asset: r for r in conformal.static_audit(forecast.hist_sim(rs, 0.05, 50), 0.05).collect()}
    b = {r.asset: r for r in conformal.static_audit(forecast.hist_sim(rs.withColumn("r", F.col("r") * 2), 0.05, 50), 0.05).collect()}
    for k in a:
        assert b[k].q_v == pytest.approx(2 * a[k].q_v, abs=1e-9) and b[k].viol_corr == a[k].viol_corr and b[k].ratio == pytest.approx(a[k].ratio, rel=1e-6)


def test_zero_forecast_is_replacement(spark):
    rows = conformal.static_audit(forecast.constant(series(spark)), 0.05).collect()
    assert all(r.regime == "replacement" and math.isinf(r.ratio) and 0.4 < r.pi_raw < 0.6 and r.pi_corr < 0.15 for r in rows)


def test_empty_panel(spark):
    none = series(spark, 10, 1).filter("pos < 0")
    assert conformal.static_audit(forecast.standard_set(none), 0.01).count() == 0


def test_runs(spark):
    d = spark.createDataFrame([("m", "a", k, v) for k, v in enumerate([True, True, None, True, True, True, False, True])], "model string, asset string, pos int, f boolean")
    assert conformal.longest_run(d, F.col("f")).first().max_run == 3


def test_next_return(spark):
    rs = series(spark, 6, 1).filter("pos <> 3")
    got = [(str(r.date), str(r.next_date)) for r in forecast.next_return(rs.select("asset", "date"), rs).orderBy("date").collect()]
    assert got == [("2020-01-01", "2020-01-02"), ("2020-01-02", "2020-01-03"), ("2020-01-03", "2020-01-05"), ("2020-01-05", "2020-01-06"), ("2020-01-06", "None")]


def test_recalibration_against_numpy(spark):
    parts = conformal.split_paths(forecast.hist_sim(series(spark, 300, 1), 0.05, 50))
    pdf = parts.filter("role = 'cal'").toPandas().sort_values("pos")
    got = {r.method: r.param for r in recalibrate.fit_all(parts, 0.05).collect()}
    level = 0.05
    for v in (pdf.r < pdf.q).to_numpy():
        level = float(np.clip(level + 0.05 * (0.05 - v), 1e-6, 1 - 1e-6))
    sigma = numeric.ewma_vol(pdf.r.to_numpy())
    want = {"shift": np.quantile(pdf.score, 0.95), "hist_quantile": -np.quantile(pdf.r, 0.05), "scale": 0.05 / (pdf.r < pdf.q).mean(), "aci": np.quantile(pdf.score, 1 - level), "fhs": -sigma.mean() * np.quantile(pdf.r / sigma, 0.05) / pdf.q.abs().mean()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_panel_comparison_against_numpy(spark):
    rng = np.random.default_rng(4)
    diffs = {a: rng.standard_normal(n) + 0.1 for a, n in (("x", 90), ("y", 100))}
    rows = [("m1", "m2", a, k, float(v)) for a, xs in diffs.items() for k, v in enumerate(xs)]
    got = inference.hac_dm(inference.tail_aligned(spark.createDataFrame(rows, "model_a string, model_b string, asset string, pos int, diff double"))).first()
    s = diffs["x"][-90:] + diffs["y"][-90:]
    rho = np.clip(np.corrcoef(s[:-1], s[1:])[0, 1], -0.99, 0.99)
    bw = min(math.ceil(1.1447 * (4 * rho**2 / ((1 - rho) ** 2 * (1 + rho) ** 2) * 90) ** (1 / 3)), 89)
    e = s - s.mean()
    hac = (e @ e) / 90 + sum(2 * (1 - k / (bw + 1)) * (e[k:] @ e[:-k]) / 90 for k in range(1, bw + 1))
    assert (got.n, got.lags) == (90, bw) and got.dm == pytest.approx(s.mean() / math.sqrt(hac / 90) * math.sqrt(89 / 90))


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 2))
    y = 0.3 + 0.8 * x[:, 0] - 0.2 * x[:, 1] + 0.1 * rng.standard_normal(60)
    c = np.arange(60) % 6
    rows = [(float(a), float(b), float(d), int(k)) for a, (b, d), k in zip(y, x, c, strict=True)]
    got = inference.regress(spark.createDataFrame(rows, "y double, u double, v double, c int"), "y", "u", "v", "c").first()
    m = np.column_stack([np.ones(60), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    e = y - m @ beta
    scores = np.array([m[c == k].T @ e[c == k] for k in range(6)])
    var = inv @ (scores.T @ scores) @ inv * 6 / 5 * 59 / 57
    assert [got.beta0, got.beta1, got.beta2] == pytest.approx(list(beta)) and [got.se_cluster0, got.se_cluster1, got.se_cluster2] == pytest.approx(list(np.sqrt(np.diag(var))))
    assert got.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))


def test_distributions(spark):
    xs = [3.0, -1.0, 2.0, 0.0, 5.0]
    s = F.array(*map(F.lit, xs))
    u, q = F.array(*[F.lit(k / 10) for k in range(1, 10)]), F.array(*[F.lit(float(k)) for k in range(1, 10)])
    v = values(spark, a=D.sample_quantile(s, 0.3), b=D.sample_shortfall(s, 0.3), c=D.sample_cdf(s, F.lit(2.0)), d=D.grid_quantile(u, q, 0.25), e=D.grid_quantile(u, q, 0.05), f=D.grid_cdf(u, q, F.lit(9.5)), g=D.grid_cdf(u, q, F.lit(2.5)), h=D.grid_quantile(u, q, 0.3))
    assert (v.a, v.b, v.c) == (pytest.approx(np.quantile(xs, 0.3)), -0.5, 0.6)
    assert (v.d, v.e, v.f, v.g, v.h) == (pytest.approx(2.5), pytest.approx(0.5), 1.0, pytest.approx(0.25), 3.0)


def test_student_t():
    assert numeric.t_cdf(-2.015048372669157, 5) == pytest.approx(0.05, abs=1e-9) and numeric.t_ppf(0.05, 5) == pytest.approx(-2.015048372669157, abs=1e-9)
    levels = np.arange(1, 10) / 10
    df, mu, sigma = numeric.fit_t_to_grid(levels, np.array([-0.001 + 0.015 * numeric.t_ppf(u, 5) for u in levels]))
    assert abs(df - 5) < 0.5 and abs(mu + 0.001) < 1e-4 and abs(sigma - 0.015) < 1e-4
    draws = np.random.default_rng(1).standard_t(6, 400_000)
    assert numeric.t_shortfall(0.05, 6) == pytest.approx(draws[draws <= np.quantile(draws, 0.05)].mean(), abs=0.03)
    assert numeric.binomial_cdf(2, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3)))


def test_small_fits():
    assert list(numeric.pava(np.array([3.0, 1.0, 2.0, 4.0]))) == [2, 2, 2, 4]
    rng = np.random.default_rng(2)
    xi, beta = numeric.gpd_fit(rng.exponential(2.0, 4000))
    assert abs(xi) < 0.08 and abs(beta - 2) < 0.2
    best, _ = numeric.nelder_mead(lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2, np.array([0.0, 0.0]), np.array([0.5, 0.5]))
    assert best == pytest.approx([1, -2], abs=1e-4)
    q = numeric.stationary_bootstrap(rng.standard_normal(500), 0.9, 200, 20, rng)
    assert abs(q.mean() - 1.28) < 0.25


def test_fitted_methods_keep_coverage(spark):
    p = forecast.hist_sim(series(spark, 700, 1, 3), 0.05, 100).filter("pos >= 100").withColumn("pos", F.col("pos") - 100)
    rows = conformal.corrected(fit.recalibrate(conformal.split_paths(p), 0.05)).groupBy("method").agg(F.avg("viol_corr").alias("pi")).collect()
    assert len(rows) == 5 and all(0.005 <= r.pi <= 0.15 for r in rows)
    ci = fit.bootstrap_ci(conformal.split_paths(p), 0.05, draws=200).first()
    assert ci.q_lo <= ci.q_v <= ci.q_hi
    again = fit.bootstrap_ci(conformal.split_paths(p), 0.05, draws=200).first()
    assert again == ci


def test_innovations_are_standardised():
    rng = np.random.default_rng(3)
    for law in simulate.LAWS:
        x = simulate.innovations(law, 400_000, rng)
        assert abs(x.mean()) < 0.02 and (law == "t3" or abs(x.std() - 1) < 0.05), law


def test_stream_equals_batch(spark, tmp_path):
    from vartide.streaming import monitor

    path = forecast.hist_sim(series(spark, 80, 2), 0.05, 20).select("model", "asset", "pos", "r", "q")
    for k in range(3):
        path.filter((F.col("pos") >= 30 * k) & (F.col("pos") < 30 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(path.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = monitor.monitor(stream, 0.05, 20).writeStream.format("memory").queryName("watch").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.asset, r.pos): r.q_v for r in spark.table("watch").collect()}
    want = {(r.asset, r.pos): r.q_v for r in conformal.rolling_qv(path, 0.05, 20).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_daily_bars_plan(spark):
    from vartide.streaming import monitor

    assert "event_type" in monitor.daily_bars(spark.readStream.format("rate").load().selectExpr("value as event_id", "timestamp as ts", "'a' as event_type", "cast(value as double) as value")).columns


def test_cluster_comparison_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [("m1", "m2", f"a{k}", t, float(x)) for k in range(6) for t, x in enumerate(rng.standard_normal(40) + 0.2)]
    pairs = spark.createDataFrame(rows, "model_a string, model_b string, asset string, pos int, diff double")
    got = inference.t_p_value(inference.cluster_dm(pairs).withColumn("dof", (F.col("clusters") - 1).cast("double"))).first()
    m = np.array([np.mean([r[4] for r in rows if r[2] == f"a{k}"]) for k in range(6)])
    t = m.mean() / (m.std(ddof=1) / math.sqrt(6))
    assert got.t == pytest.approx(t) and got.p_value == pytest.approx(2 * numeric.t_cdf(-abs(t), 5))
    boot = inference.wild_cluster_dm(pairs, 199).first()
    assert 0 < boot.p_boot <= 1 and boot.t == pytest.approx(t)


def test_skew_t_quantiles():
    rng = np.random.default_rng(7)
    for xi in (0.7, 1.0, 1.4):
        z = np.abs(rng.standard_t(6, 300_000))
        x = np.where(rng.random(len(z)) < xi * xi / (1 + xi * xi), z * xi, -z / xi)
        for level in (0.05, 0.3, 0.8):
            assert numeric.skew_t_quantile(level, 6, xi) == pytest.approx(np.quantile(x, level), abs=0.03)


def test_noncentral_t():
    for df in (1.5, 5, 40):
        assert numeric.nct_cdf(-2, df, 0) == pytest.approx(numeric.t_cdf(-2, df), abs=1e-12)
        assert numeric.nct_ppf(0.01, df, 0) == pytest.approx(numeric.t_ppf(0.01, df), abs=1e-9)
        assert numeric.nct_shortfall(0.01, df, 0) == pytest.approx(numeric.t_shortfall(0.01, df), abs=1e-8)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(1_000_000) - 0.5) / np.sqrt(rng.chisquare(5, 1_000_000) / 5)
    q = numeric.nct_ppf(0.05, 5, -0.5)
    assert numeric.nct_cdf(q, 5, -0.5) == pytest.approx(0.05, abs=1e-10) and (x <= q).mean() == pytest.approx(0.05, abs=1e-3)
    assert numeric.nct_shortfall(0.05, 5, -0.5) == pytest.approx(x[x <= q].mean(), abs=0.03)


@pytest.mark.parametrize("m,n", [(4, 3), (5, 5), (3, 6)])
def test_exact_kolmogorov_smirnov(m, n):
    reached = []
    for firsts in itertools.combinations(range(m + n), m):
        gaps = np.cumsum([n if k in firsts else -m for k in range(m + n)])
        reached.append(np.abs(gaps).max())
    values = np.unique(reached)
    assert numeric.ks_exact(values, m, n) == pytest.approx([(np.array(reached) >= v).mean() for v in values])
    assert list(numeric.ks_exact(np.array([0]), m, n)) == [1.0]


def test_rolling_ks_counts_equal_scores_together(spark):
    rng = np.random.default_rng(8)
    scores = rng.integers(0, 4, 40).astype(float)
    rows = spark.createDataFrame([("m", "a", k, float(x), 0.0) for k, x in enumerate(scores)], "model string, asset string, pos long, q double, r double")
    got = fit.rolling_ks(rows, 20).toPandas().sort_values("pos")
    expected = []
    for t in range(20, 40):
        a, b = scores[t - 20 : t - 10], scores[t - 10 : t]
        expected.append(max(abs((a <= v).mean() - (b <= v).mean()) for v in range(4)))
    assert list(got.ks) == pytest.approx(expected) and list(got.p_value) == pytest.approx(numeric.ks_exact(np.rint(np.array(expected) * 100), 10, 10))


def test_parametric_laws(spark):
    rows = [("a", "normal", None, None, 1.0, 2.0, 1.0), ("b", "student_t", 6.0, None, 0.5, 2.0, 0.5), ("c", "skewed_t", 6.0, 0.0, 0.5, 2.0, 0.5), ("d", "skewed_t", 6.0, None, 0.0, 1.0, 0.0), ("e", "other", 6.0, 1.0, 0.0, 1.0, 0.0), ("f", None, None, None, None, None, None), ("g", "student_t", 1.0, None, 0.0, 1.0, 0.0)]
    laws = spark.createDataFrame(rows, "id string, family string, df double, skew double, location double, scale double, at double")
    got = {r.id: r for r in fit.parametric(laws, 0.05).collect()}
    assert got["a"].quantile == pytest.approx(1 - 2 * 1.6448536269514722) and got["a"].below == 0.5
    assert got["b"].quantile == pytest.approx(0.5 + 2 * numeric.t_ppf(0.05, 6)) and got["b"].shortfall == pytest.approx(numeric.t_shortfall(0.05, 6, 0.5, 2.0))
    assert got["c"][2:] == pytest.approx(got["b"][2:])
    assert [got[k][2:] for k in "def"] == [(None, None, None)] * 3 and got["g"].shortfall is None and got["g"].below == 0.5
    assert fit.parametric(laws.limit(0)).count() == 0


def test_gjr_garch_refits_every_day(spark):
    """Each day's forecast is the fit to the window before it, wherever the days are dealt."""
    d = series(spark, n=140, assets=2)
    rows = fit.gjr_garch(d, 0.01, window=60, span=16).collect()
    assert len(rows) == 280 and len({(x.asset, x.pos) for x in rows}) == 280
    history = {}
    for x in sorted(d.collect(), key=lambda x: x.pos):
        history.setdefault(x.asset, []).append(x.r * 100)
    for x in rows:
        past = np.array(history[x.asset][max(0, x.pos - 60) : x.pos])
        if len(past) >= 50 and x.pos % 7 == 0:
            p = numeric.gjr_fit(past)
            assert x.q * 100 == pytest.approx(p[0] + stats.z_value(0.01) * np.sqrt(numeric.gjr_filter(past, *p)[-1]), abs=1e-9), (x.asset, x.pos)


def test_simulation_study_runs_the_whole_grid(spark):
    """5 laws x lengths 1000 and 5000 x 500 replications."""
    got = {(r.law, r.length): r for r in simulate.summary(simulate.study(spark)).collect()}
    assert {k: r.reps for k, r in got.items()} == {(law, n): 500 for law in simulate.LAWS for n in (1000, 5000)}
    assert all(abs(got[law, 5000].mean_pi_corr - 0.01) < 0.001 for law in simulate.LAWS)
