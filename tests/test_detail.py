"""Recalibration in audits, exact binomial tests, the two-piece law and the bootstrap of centred sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import series

from vartide.functions import numeric, stats
from vartide.operators import conformal, forecast, inference, recalibrate
from vartide.plans import api


def pmf(k, n, a):
    return math.comb(n, k) * a**k * (1 - a) ** (n - k)


def test_exact_binomial(spark):
    cases = [(0, 30), (30, 30), (3, 40), (0, 720), (12, 720), (1, 1)]
    df = spark.createDataFrame(cases, "x long, n long")
    a = stats.d(0.05)
    got = {(r.x, r.n): (r.two, r.up) for r in df.select("x", "n", stats.binomial_two_sided(F.col("x"), F.col("n"), a).alias("two"), stats.binomial_upper(F.col("x"), F.col("n"), a).alias("up")).collect()}
    for x, n in cases:
        p = [pmf(k, n, 0.05) for k in range(n + 1)]
        assert got[(x, n)][0] == pytest.approx(sum(v for v in p if v <= p[x] * (1 + 1e-7)), rel=1e-6)
        assert got[(x, n)][1] == pytest.approx(sum(p[x:]), rel=1e-6)


def test_two_piece_law_finds_a_likelihood_as_high_as_the_truth():
    rng = np.random.default_rng(4)
    x, vol = rng.normal(size=1500), np.abs(rng.normal(size=(1500, 2)))
    side = rng.random(1500) < 1 / (1 + 0.7**2)  # below the mode
    t = np.abs(rng.standard_t(6, 1500))
    y = 0.2 + 0.5 * x + np.exp(-1 + 0.3 * vol[:, 0]) * np.where(side, -t / 0.7, t * 0.7)
    law = numeric.TwoPieceStudent(x, vol, y)
    xs, vs, ys = (x - law.of_x[0]) / law.of_x[1], (vol - law.of_spread[0]) / law.of_spread[1], (y - law.of_y[0]) / law.of_y[1]
    truth = np.array([math.atanh((math.log(2) - 0.5) / 2.5), math.atanh(math.log(0.7) / 1.5), (0.2 + 0.5 * law.of_x[0] - law.of_y[0]) / law.of_y[1], 0.5 * law.of_x[1] / law.of_y[1], -1 + 0.3 * law.of_spread[0][0] - math.log(law.of_y[1]), 0.3 * law.of_spread[1][0], 0.0])
    assert law.sound and law.likelihood(law.best, xs, vs, ys) >= law.likelihood(truth, xs, vs, ys) - 1.0
    for level in (0.01, 0.05, 0.5):
        assert (y < law.quantile(level, x, vol)).mean() == pytest.approx(level, abs=0.02)


def test_tail_quantile_of_exponential_losses():
    losses = np.random.default_rng(1).exponential(1.0, 20_000)
    assert numeric.tail_quantile(losses, 0.01) == pytest.approx(-math.log(0.01), abs=0.2)
    assert numeric.tail_quantile(losses[:40], 0.1) == pytest.approx(np.quantile(losses[:40], 0.9))


@pytest.mark.parametrize("method", ["scale", "aci", "fhs", "linear_qr", "isotonic"])
@pytest.mark.parametrize("mode", ["static", "rolling"])
def test_audit_with_recalibration(spark, method, mode):
    r = series(spark, n=400, assets=2)
    out = api.audit(r, forecaster="hist_sim", mode=mode, alpha=0.05, window=60, recalibration=method).collect()
    assert len(out) == 2 and all(x.n_test > 50 and 0 <= x.pi_corr <= 1 for x in out)
    if mode == "static":
        parts = conformal.split_paths(forecast.hist_sim(r, 0.05, 60), warmup=50)
        if method in api.CLOSED:
            plain = recalibrate.apply(parts, api.CLOSED[method](parts, 0.05)).groupBy("asset").agg(F.sum("viol_corr")).collect()
            assert {x.asset: x.viol_corr for x in out} == dict(map(tuple, plain))


def test_audit_takes_a_recalibration_of_ones_own(spark):
    r = series(spark, n=300, assets=1)
    twice = lambda parts, alpha: parts.filter("role = 'test'").withColumns({"var_raw": -F.col("q"), "var_corr": -2 * F.col("q")})
    row = api.audit(r, forecaster="hist_sim", alpha=0.05, window=60, recalibration=twice).first()
    assert row.width_corr == pytest.approx(2 * row.width_raw)
    forecasts = forecast.hist_sim(r, 0.05, 60)
    for bad in (dict(forecasts=forecasts, recalibration="scale"), dict(forecaster="hist_sim", recalibration="nothing"), dict(forecaster="hist_sim", mode="odd"), dict()):
        with pytest.raises(ValueError):
            api.audit(r, **bad)


def test_benchmarks_beside_a_forecaster(spark):
    r = series(spark, n=160, assets=1)
    mine = forecast.rolling_normal(r, 0.05, 60).drop("es")
    models = {x.model for x in api.with_benchmarks(mine, r, 0.05, 60).collect()}
    assert {m.split(" + ")[0] for m in models} == {"norm_roll", "hist_sim", "gjr_garch"} and {m.split(" + ")[1] for m in models} == set(api.CLOSED)


def test_pairs_of_losses_and_centred_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(m, a, t, float(rng.normal())) for m in "cab" for a in ("x", "y") for t in range(30) if not (m == "b" and t == 3)]
    pairs = inference.loss_pairs(spark.createDataFrame(rows, "model string, asset string, pos int, loss double"))
    plain = {(p, q, a, t): u - v for p, a, t, u in rows for q, b, s, v in rows if p < q and (a, t) == (b, s)}
    assert {(x.model_a, x.model_b, x.asset, x.pos): x.diff for x in pairs.collect()} == plain
    got = {(x.model_a, x.model_b): (x.t_orig, x.p_boot) for x in inference.wild_cluster_sums(inference.tail_aligned(pairs)).collect()}
    assert len(got) == 3 and all(t > 0 and p == 0 for t, p in got.values())
