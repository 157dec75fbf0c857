"""GARCH variants, daily tails, boosted trees and the Student law of grids, against plain versions and known laws."""

import math

import numpy as np
import pytest
from tests_support import series

from vartide.functions import numeric
from vartide.operators import conformal, fit, forecast


@pytest.mark.parametrize(("df", "skew"), [(5, -0.3), (8, 0.4), (30, 0.0)])
def test_hansen_law_is_standard_and_its_quantile_inverts_it(df, skew):
    z = np.linspace(-80, 80, 800_001)
    f = np.exp(numeric.hansen_log_density(z, df, skew)) * (z[1] - z[0])
    assert [f.sum(), (f * z).sum(), (f * z * z).sum()] == pytest.approx([1, 0, 1], abs=1e-3)
    for p in (0.01, 0.3, 0.9):
        assert f[z < numeric.hansen_ppf(p, df, skew)].sum() == pytest.approx(p, abs=2e-4)


def test_skewed_fit_finds_the_law_of_its_innovations():
    rng = np.random.default_rng(5)
    law = np.array([numeric.hansen_ppf(u, 5, -0.3) for u in rng.random(4000)])
    v, r = 1.0, np.empty(4000)
    for t, z in enumerate(law):
        r[t] = 0.05 + math.sqrt(v) * z
        v = 0.05 + 0.08 * v * z * z + 0.87 * v
    *model, df, skew = numeric.skewed_gjr_fit(r)
    assert df == pytest.approx(5, abs=1.2) and skew == pytest.approx(-0.3, abs=0.08) and model[4] == pytest.approx(0.87, abs=0.08)


def test_models_without_leverage_or_mean():
    r = np.random.default_rng(2).standard_normal(300)
    assert numeric.gjr_fit(r, leverage=False)[3] == 0
    mu, _, _, gamma, _ = numeric.gjr_fit(r, leverage=False, mean=False)
    assert mu == gamma == 0


@pytest.mark.parametrize(("df", "shift"), [(5, -0.3), (2.5, 1.2), (40, 0.0)])
def test_noncentral_quantile_inverts_its_law(df, shift):
    for p in (1e-4, 0.01, 0.5, 0.99):
        assert numeric.nct_cdf(numeric.nct_ppf(p, df, shift), df, shift) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("levels", [np.arange(1, 10) / 10, np.arange(2, 9) / 10, np.array([0.01, 0.05, 0.5, 0.95, 0.99])])
def test_student_law_of_a_grid(levels):
    for df in (2.5, 5.0, 30.0):
        got = numeric.fit_t_to_grid(levels, np.array([-0.3 + 1.5 * numeric.t_ppf(u, df) for u in levels]))
        assert got == pytest.approx((df, -0.3, 1.5), rel=1e-3)
    rng = np.random.default_rng(3)
    q = np.sort(rng.standard_normal(len(levels)))

    def cost(df, place, scale):
        return sum((place + scale * numeric.t_ppf(u, df) - x) ** 2 for u, x in zip(levels, q, strict=True))

    best = cost(*numeric.fit_t_to_grid(levels, q))
    for df in np.geomspace(2.01, 500, 40):  # no other df does better with its own regression
        z = np.array([numeric.t_ppf(u, df) for u in levels])
        scale = max(float(np.cov(z, q, ddof=0)[0, 1] / z.var()), 1e-8)
        assert best <= cost(df, q.mean() - scale * z.mean(), scale) + 1e-9


def test_boosted_quantile_learns_and_stops_early():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    y = x[:, 0] + rng.normal(size=1500) * np.where(x[:, 1] > 0, 2, 0.5)
    model = numeric.BoostedQuantile(x[:1000], y[:1000], 0.1, rounds=300)
    assert 0 < len(model.trees) < 300
    assert numeric.pinball(y[1000:], model(x[1000:]), 0.1) < 0.8 * numeric.pinball(y[1000:], np.quantile(y[:1000], 0.1), 0.1)
    assert (y[1000:] < model(x[1000:])).mean() == pytest.approx(0.1, abs=0.04)
    noise = numeric.BoostedQuantile(x[:300], rng.normal(size=300), 0.1, rounds=100, patience=5)
    assert len(noise.trees) < 100
    few = numeric.BoostedQuantile(x[:30], y[:30], 0.1)  # too few for a split of two leaves
    assert not few.trees and few(x[:3]) == pytest.approx([np.quantile(y[:30], 0.1)] * 3)
    flat = numeric.BoostedQuantile(np.zeros((100, 2)), y[:100], 0.1)
    assert not flat.trees


def test_grid_of_settings_is_the_single_fit(spark):
    parts = conformal.split_paths(forecast.hist_sim(series(spark, n=300, assets=2), 0.05, 50))
    got = fit.boosted_grid(parts, 0.05, ((20, 7, 0.1), (20, 3, 0.05))).toPandas()
    assert len(got) == 2 * parts.filter("role = 'test' and asset = 'a0'").count() * 2
    pdf = parts.filter("asset = 'a1'").toPandas().sort_values("pos")
    x, cal = fit._features(pdf), (pdf.role == "cal").to_numpy()
    model = numeric.BoostedQuantile(x[cal], pdf.r.to_numpy()[cal], 0.05, 20, 0.05, 3)
    mine = got[(got.asset == "a1") & (got.leaves == 3)].sort_values("pos")
    assert -mine.var_corr.to_numpy() == pytest.approx(model(x[(pdf.role == "test").to_numpy()]))


def test_daily_tails_are_those_of_each_window(spark):
    r = series(spark, n=130, assets=2)
    got = {(x.model, x.asset, x.pos): x.q for x in fit.tail_forecasts(r, 0.05, window=100, span=16).collect()}
    assert len(got) == 2 * 2 * 30
    for asset in ("a0", "a1"):
        own = np.array([x.r for x in r.filter(r.asset == asset).orderBy("pos").collect()])
        for t in (100, 117, 129):
            past = own[t - 100 : t]
            v = numeric.gjr_filter(past * 100, *numeric.gjr_fit(past * 100, False, False))
            z, ahead = past * 100 / np.sqrt(v[:-1]), math.sqrt(v[-1]) / 100
            assert got["fhs", asset, t] == pytest.approx(ahead * np.quantile(z, 0.05))
            # five peaks above the .95 quantile are too few for a law: the losses' own quantile
            assert got["evt_pot", asset, t] == pytest.approx(got["fhs", asset, t])
    flat = fit.tail_forecasts(r.selectExpr("asset", "date", "0.0D as r", "pos"), 0.05, window=100)
    assert flat.count() == 0


def test_garch_names_and_short_windows(spark):
    r = series(spark, n=56, assets=1)
    for args, name in (({"leverage": False}, "garch"), ({"innovations": "skewed_t"}, "gjr_skewed_t"), ({"innovations": "hansen"}, "gjr_hansen")):
        rows = sorted(fit.gjr_garch(r, 0.05, window=52, **args).collect(), key=lambda x: x.pos)
        assert len(rows) == 56 and {x.model for x in rows} == {name} and all(math.isfinite(x.q) for x in rows)
        assert rows[0].q == 0
    with pytest.raises(ValueError):
        fit.gjr_garch(r, innovations="skewed_t", leverage=False)
