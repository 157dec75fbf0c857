"""Longer horizons, gaps by correlation, carried shortfall and routed stores, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import series

from vartide.operators import conformal, forecast, inference
from vartide.sources import io


def test_horizon_of_comparisons(spark):
    d = np.random.default_rng(3).normal(0.1, 1, 60)
    pairs = spark.createDataFrame([("a", "b", "x", t, float(v)) for t, v in enumerate(d)] + [("a", "b", "one", 0, 1.0)], "model_a string, model_b string, asset string, pos int, diff double")
    for h in (1, 4):
        got = {r.asset: r for r in inference.diebold_mariano_ahead(pairs, h).collect()}
        e, n = d - d.mean(), len(d)
        spread = np.mean(e * e) + sum(2 * (1 - k / h) * np.mean(e[k:] * e[:-k]) for k in range(1, h))
        want = d.mean() / math.sqrt(spread / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
        assert got["x"].dm == pytest.approx(want) and got["x"].p_value == pytest.approx(math.erfc(abs(want) / math.sqrt(2)))
        assert got["one"].dm == 0 and got["one"].p_value == 1


def test_gap_by_correlation(spark):
    path = forecast.hist_sim(series(spark, 300), 0.05, 50).unionByName(forecast.constant(series(spark, 300).withColumn("r", F.lit(0.0))))
    parts = conformal.split_paths(path)
    got = {(r.model, r.asset): r for r in conformal.mixing_gap(parts).collect()}
    rows = parts.filter("role = 'cal' and model = 'hist_sim' and asset = 'a0'").orderBy("pos").collect()
    s = np.array([r.score for r in rows])
    rho = np.corrcoef(s[1:], s[:-1])[0, 1]
    assert got["hist_sim", "a0"].rho == pytest.approx(rho)
    assert got["hist_sim", "a0"].gap == math.ceil(math.log(300) / abs(math.log(min(0.99, max(0.01, abs(rho))))))
    assert got["const_zero", "a0"].rho == 0 and got["const_zero", "a0"].gap == math.ceil(math.log(300) / abs(math.log(0.01)))


def test_shortfall_moves_with_the_correction(spark):
    test = spark.createDataFrame([(0.02, 0.03, -0.025), (0.02, 0.01, -0.025)], "var_raw double, var_corr double, es double")
    assert [r.es_corr for r in conformal.carry_shortfall(test).collect()] == pytest.approx([0.035, 0.015])


def test_rates_side_by_side(spark):
    facts = spark.createDataFrame([("m", "x", 1, 10), ("m", "y", 3, 10)], "model string, asset string, viol_corr int, n_test int")
    row = inference.wide_rates(facts, {"x": "one", "y": "two", "z": "three"}).first()
    assert (row.pi_one, row.pi_two, row.pi_three) == (0.1, 0.3, None)


def test_routed_stores(spark, tmp_path):
    rows = spark.createDataFrame([("m", "x", "2020-01-01", 0.01, -0.5)], "model string, asset string, date string, alpha double, q double").withColumn("date", F.to_date("date"))
    folders = {k: str(tmp_path / k) for k in ("one", "two")}
    io.write_forecasts(rows, folders["one"])
    io.write_forecasts(rows.withColumn("q", F.lit(-0.7)), folders["two"])
    assert {(r.source, r.q) for r in io.read_routed(spark, folders).collect()} == {("one", -0.5), ("two", -0.7)}
    with pytest.raises(ValueError):
        io.read_routed(spark, {})
