"""Exact quantile regression by its certificate, mergeable isotonic fits, and the table of twelve methods."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vartide.functions import numeric
from vartide.operators import conformal, fit, forecast, isotonic
from vartide.plans import methods
from vartide.sources import panels


def certificate(x, y, beta, alpha):
    """Whether multipliers in [alpha - 1, alpha] exist whose weighted columns cancel: given outside the points that are
    met, solved for on these. The largest violation, with least squares where points coincide."""
    e = y - x @ beta
    met = np.abs(e) < 1e-7 * (1 + np.abs(y).max())
    pull = np.where(e > 0, alpha, alpha - 1)[~met] @ x[~met]
    rows = x[met]
    d = np.clip(np.linalg.lstsq(rows.T, -pull, rcond=None)[0], alpha - 1, alpha)
    for _ in range(3000):  # one multiplier at a time, within its bounds
        for k, row in enumerate(rows):
            d[k] = np.clip(d[k] - row @ (rows.T @ d + pull) / (row @ row), alpha - 1, alpha)
        if np.abs(rows.T @ d + pull).max() < 1e-8:
            break
    return np.abs(rows.T @ d + pull).max()


def test_quantile_regression_is_optimal_on_every_pair(spark):
    """The subgradient holds 0 for every pair of the panel, and the walk's own certificate says so."""
    paths = forecast.standard_set(panels.panel(spark, "/root/testdata/sf0.001"), 0.05, 40).filter("pos >= 40").toPandas()
    for _, rows in paths.groupby(["model", "asset"]):
        q, y = rows.q.to_numpy(), rows.r.to_numpy()
        x = np.column_stack([np.ones(len(q)), q]) if np.ptp(q) else np.ones((len(q), 1))
        for alpha in (0.01, 0.05, 0.5):
            beta, left = numeric.quantile_regression(x, y, alpha)
            assert left <= 1e-7 and certificate(x, y, beta, alpha) <= 1e-6


def test_quantile_regression_on_ties():
    r = np.random.default_rng(3)
    for k in range(120):
        n, p = int(r.integers(4, 120)), int(r.integers(1, 4))
        x = np.column_stack([np.ones(n), *[r.integers(0, 3, n).astype(float) for _ in range(p - 1)]])
        y, alpha = r.integers(0, 4, n).astype(float), float(r.choice([0.05, 0.5, 0.8]))
        if np.linalg.matrix_rank(x) < p:
            with pytest.raises(ValueError):
                numeric.quantile_regression(x, y, alpha)
            continue
        beta, left = numeric.quantile_regression(x, y, alpha)
        own = numeric.pinball(y, x @ beta, alpha)
        assert left <= 1e-7
        for _ in range(40):  # no fit through p of the points is better
            some = r.choice(n, p, replace=False)
            if np.linalg.matrix_rank(x[some]) == p:
                assert own <= numeric.pinball(y, x @ np.linalg.solve(x[some], y[some]), alpha) + 1e-9


def pooled_by_force(points):
    """x -> level, equal x taken together, by pooling of adjacent violators with weights."""
    xs = sorted({x for x, _ in points})
    blocks = []
    for x in xs:
        ys = [y for v, y in points if v == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, more = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + more]
    return {x: t / w for t, w, own in blocks for x in own}


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_isotonic_equals_pooling(spark, chunk):
    r, data = random.Random(chunk), {}
    for key, n in (("a", 1), ("b", 60), ("c", 400), (None, 50), ("up", 30), ("down", 30)):
        data[key] = [(r.choice([r.gauss(0, 1), float(r.randint(0, 5))]), float(r.random() < 0.3)) for _ in range(n)]
    data["up"], data["down"] = [(float(k), float(k)) for k in range(30)], [(float(k), -float(k)) for k in range(30)]
    rows = [(k, x, y) for k, v in data.items() for x, y in v] + [("b", None, 1.0), ("none", None, 0.0)]
    df = spark.createDataFrame(rows, "asset string, x double, y double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = isotonic.fit(df, "x", "y", ("asset",), chunk).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {p.asset for p in pieces} == set(data)
    for key, points in data.items():
        mine = [p for p in pieces if p.asset == key]
        for x, level in pooled_by_force(points).items():
            held = [p.level for p in mine if p.low <= x <= p.high]
            assert held == [pytest.approx(level, abs=1e-9)], (key, x)
        assert {p.low for p in mine} | {p.high for p in mine} <= {x for x, _ in points}


def test_isotonic_over_a_million(spark):
    """One group of 10^6 different x with hits of rising rate: corners, not rows, come together."""
    n = 1_000_000
    hit = (F.pmod(F.col("id") * 48_271, F.lit(1_000_003)) < F.col("id") / 20).cast("double")
    df = spark.range(n, numPartitions=8).select(F.lit("a").alias("asset"), F.col("id").cast("double").alias("x"), hit.alias("y"))
    pieces = sorted(isotonic.fit(df, "x", "y", ("asset",)).collect(), key=lambda p: p.low)
    levels = [p.level for p in pieces]
    assert len(pieces) < 20_000 and levels == sorted(levels) and pieces[0].low == 0 and pieces[-1].high == n - 1
    assert sum(p.level * (p.high - p.low + 1) for p in pieces) == pytest.approx(df.agg(F.sum("y")).first()[0], rel=1e-9)
    assert all(b.low == a.high + 1 for a, b in zip(pieces, pieces[1:], strict=False))


def test_isotonic_rows_as_interpolated(spark):
    r = random.Random(5)
    rows = [("m", a, k, r.gauss(0, 1), round(-abs(r.gauss(1, 0.5)), 1 if a == "ties" else 9)) for a in ("x", "ties") for k in range(300)]
    parts = conformal.split_paths(spark.createDataFrame(rows, "model string, asset string, pos long, r double, q double"))
    got = {(x.asset, x.pos): x.var_corr for x in fit.recalibrate(parts, 0.05, ("isotonic",)).collect()}
    for asset in ("x", "ties"):
        levels = pooled_by_force([(q, float(x < q)) for _, a, k, x, q in rows if a == asset and k < 210])
        xs = np.array(sorted(levels))
        for _, a, k, _, q in rows:
            if a == asset and k >= 210:
                p = float(np.interp(q, xs, [levels[x] for x in xs]))
                assert got[asset, k] == pytest.approx(-q * (0.05 / p if p > 1e-6 else 1.0), abs=1e-9)


def test_twelve_methods(spark):
    paths = forecast.standard_set(panels.panel(spark, "/root/testdata/sf0.001"), 0.05, 40).filter("pos >= 40").withColumn("pos", F.col("pos") - 40)
    paths = paths.filter("model in ('norm_roll', 'hist_sim')")
    pairs = methods.table(methods.native_rows(paths, 0.05, 40).unionByName(methods.fitted_rows(paths, 0.05)), 0.05)
    rows = pairs.collect()
    assert {r.method for r in rows} == {*methods.NATIVE, *methods.FITTED} and len(rows) == 12 * 10
    assert len({(r.asset, r.n) for r in rows}) == 5
    wide = methods.pivot(pairs, (*methods.NATIVE, *methods.FITTED))
    assert wide.columns == ["model", *methods.NATIVE, *methods.FITTED] and wide.count() == 2
    table = {r.method: r for r in methods.summary(pairs).collect()}
    assert table["raw"].pairs == 10 and all(0 <= r.green_pct <= 100 for r in table.values())
