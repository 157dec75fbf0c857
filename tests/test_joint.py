"""Joint likelihoods, the as-of join in stretches, prices with pushed filters, panel tables."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vartide.functions import numeric
from vartide.operators import forecast
from vartide.plans import reporting
from vartide.sources import io


def simulated(n, seed):
    g, v, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        e = math.sqrt(v) * g.standard_t(5) * math.sqrt(0.6)
        out.append(0.03 + e)
        v = 0.05 + (0.04 + 0.1 * (e < 0)) * e * e + 0.85 * v
    return np.array(out)


def test_gradient_of_the_joint_likelihood():
    for seed, x in enumerate(([0.02, 0.06, 0.05, 0.08, 0.84, 6.0, -0.1], [0.1, 0.5, 0.2, -0.1, 0.3, 2.6, 0.4])):
        r, x = simulated(250, seed), np.array(x)
        _, slope = numeric.skewed_gjr_loss(x, r)
        plain = [(numeric.skewed_gjr_loss(x + h, r)[0] - numeric.skewed_gjr_loss(x - h, r)[0]) / 2e-6 for h in np.eye(7) * 1e-6]
        assert slope == pytest.approx(plain, rel=1e-4, abs=1e-4)


def test_joint_fit_is_never_below_two_steps():
    """200 windows, some constant in places, some large."""
    better = 0
    for k in range(200):
        r = simulated(120, k) * (1, 30, 0.01)[k % 3]
        if k % 10 == 0:
            r[:40] = 0.0
        joint, two = (numeric.skewed_gjr_loss(np.array(f(r)), r)[0] for f in (numeric.skewed_gjr_fit, numeric.skewed_gjr_two_steps))
        assert joint <= two + 1e-6 * abs(two)
        better += joint < two - 1e-3
    assert better > 150


def test_two_piece_regression_is_at_its_top():
    g = np.random.default_rng(4)
    for _ in range(6):
        x, spread = g.normal(size=200), g.normal(size=(200, 2))
        law = numeric.TwoPieceStudent(x, spread, 0.5 * x + np.exp(0.2 * spread[:, 0]) * g.standard_t(4, size=200))
        unit = lambda v, of: (v - of[0]) / of[1]
        assert law.sound and abs(law.best).max() < 8
        _, slope = law._loss(law.best, unit(x, law.of_x), unit(spread, law.of_spread), g.normal(size=200))
        assert np.isfinite(slope).all()


def test_search_stays_in_its_bounds():
    f = lambda x: (float(((x - np.array([3.0, -2.0, 0.5])) ** 2).sum()), 2 * (x - np.array([3.0, -2.0, 0.5])))
    x, value = numeric.projected_search(f, np.zeros(3), np.array([-1.0, -1.0, -1.0]), np.ones(3))
    assert x == pytest.approx([1, -1, 0.5], abs=1e-6) and value == pytest.approx(5, abs=1e-6)


@pytest.mark.parametrize("days", [1, 3, 50, 10_000])
def test_next_return_in_stretches(spark, days):
    r, start = random.Random(days), datetime.date(1969, 11, 20)
    held = {a: sorted(r.sample(range(90), 25)) for a in ("x", "y", None)} | {"late": [80]}
    returns = spark.createDataFrame([(a, start + datetime.timedelta(d), float(d)) for a, v in held.items() for d in v], "asset string, date date, r double").repartition(3)
    asked = [(a, start + datetime.timedelta(d), d) for a in ("x", "y", "late", "none", None) for d in range(-3, 95, 4)]
    got = forecast.next_return(spark.createDataFrame(asked, "asset string, date date, d int").repartition(4), returns, days).collect()
    assert len(got) == len(asked)
    for row in got:
        later = [d for d in held.get(row.asset, []) if d > row.d]
        assert row.next_r == (float(later[0]) if later else None) and row.next_date == (start + datetime.timedelta(later[0]) if later else None)


def test_price_filters_open_fewer_files(spark, tmp_path):
    """Files of other tickers and years would fail if they were opened."""
    for t in ("A", "B"):
        (tmp_path / t).mkdir()
        for y in (2019, 2020, 2021):
            (tmp_path / t / f"{y}.csv").write_text(f"date,close\n{y}-03-01,{y}.5\n{y}-09-01,{y}.75\n" if (t, y) in (("A", 2020), ("A", 2021)) else "date,close\nno date,no price\n")
    io.register_price_source(spark)
    prices = spark.read.format("vartide_prices").option("folder", f"file://{tmp_path}").load()
    got = prices.filter("asset = 'A' and date >= date'2020-06-01' and date < date'2021-06-01'").orderBy("date").collect()
    assert [(x.asset, x.p) for x in got] == [("A", 2020.75), ("A", 2021.5)]
    assert prices.filter("asset in ('A', 'C') and date > date'2021-12-31'").count() == 0 and prices.filter("asset = 'C'").count() == 0
    with pytest.raises(Exception, match="no date"):
        prices.filter("asset = 'B'").count()


def test_tables_are_not_cut(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("model"), (F.col("id") / 3).alias("x"))
    assert reporting.latex(df, {"model": None, "x": 2}).count(r" \\") == 6
    with pytest.raises(ValueError, match="more than 4"):
        reporting.latex(df, {"model": None}, most=4)
    text = reporting.panels(df, {"model": None, "x": 1}, {"low_x": F.col("x") < 1, "rest": df.filter("x >= 1")}, "Two parts")
    assert text.count("Panel") == 2 and r"Panel A: low\_x" in text and text.count(" & ") == 6 and text.index("Panel B") < text.index("1.0")
    assert reporting.to_dict(df, ("model",))["3"] == {"x": 1.0}
    assert reporting.to_dict(df, ("model", "x"))[("0", 0.0)] == {}
