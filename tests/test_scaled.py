"""Sliding order statistics, scans in chunks, ranks and selection: against plain versions, and on long histories."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.operators import conformal, forecast, ranks, recalibrate, scan, sliding
from vartide.sources import scratch


def series(spark, n, seed, assets=("x", None, "y")):
    r = random.Random(seed)
    value = lambda: r.choice([None, math.nan, 0.0, -0.0, r.gauss(0, 1), r.gauss(0, 1), round(r.gauss(0, 1), 1)])
    return spark.createDataFrame([(a, k, value()) for a in assets for k in range(n)], "asset string, pos long, v double").repartition(3)


@pytest.mark.parametrize("window", [1, 7, 60])
def test_sliding_equals_percentile(spark, window):
    rows = series(spark, 300, window)
    got = sliding.sliding(rows, "v", window, (0.0, 0.01, 0.5, 0.975, 1.0), (1, 3), chunk=50)
    w = Window.partitionBy("asset").orderBy("pos").rowsBetween(-window, -1)
    want = rows.select("asset", "pos", F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.01, 0.5, 0.975, 1.0)])).over(w).alias("p"), F.array_sort(F.collect_list("v").over(w)).alias("s"))
    both = {(r.asset, r.pos): r for r in want.collect()}
    rows = got.collect()
    assert len(rows) == 900
    for r in rows:
        p, s = both[r.asset, r.pos].p, both[r.asset, r.pos].s
        if r.qs is None:
            assert p is None and s == []
            continue
        expected = [*p, s[0], s[2] if len(s) > 2 else None]
        assert all(a == b or (a != a and b != b) for a, b in zip(r.qs, expected, strict=True)), (r, expected)


def test_sliding_over_ten_thousand(spark):
    """A window of 10 000 over one history of 60 000 rows, cut into chunks of 40 000."""
    rows = spark.range(60_000).select(F.lit("a").alias("asset"), F.col("id").alias("pos"), (F.pmod(F.col("id") * 7919, F.lit(60_013)) / 7.0).alias("v"))
    got = {r.pos: r.qs[0] for r in sliding.sliding(rows, "v", 10_000, (0.99,)).filter("pos % 4999 = 17 and pos > 0").collect()}
    v = [(k * 7919 % 60_013) / 7.0 for k in range(60_000)]
    for pos, q in got.items():
        s = sorted(v[max(0, pos - 10_000) : pos])
        at = (len(s) - 1) * 0.99
        low = math.floor(at)
        assert q == pytest.approx(s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low), abs=1e-9)


def test_block_lists_split_and_empty():
    held, plain, r = sliding.Ranks(), [], random.Random(4)
    for k in range(20_000):
        if plain and r.random() < (0.2 if k < 12_000 else 0.8):
            held.remove(plain.pop(r.randrange(len(plain))))
        else:
            plain.append(float(r.randint(0, 900)))
            held.add(plain[-1])
    s = sorted(plain)
    assert held.size == len(s) and [held.pick(k) for k in range(len(s))] == s and len(held.blocks) == len(held.tops)
    for x in plain:
        held.remove(x)
    assert held.size == 0
    held.add(1.0)
    assert held.quantile(0.5) == 1.0


def plain_states(recursion, start, xs):
    before, after = [], []
    for x in xs:
        before.append(start)
        start = start if x is None or start is None else recursion.step(start, x)
        after.append(start)
    return before, after


@pytest.mark.parametrize("recursion", [scan.Affine(0.94), scan.ClippedShift(0.05, 0.01, 1e-6, 1 - 1e-6), scan.ClippedShift(0.4, 0.3, 0.1, 0.6)])
def test_scans_equal_a_loop(spark, recursion):
    r = random.Random(2)
    xs = {a: [r.choice([None, 0.0, 1.0, 1.0, r.gauss(0, 2)]) for _ in range(n)] for a, n in (("a", 1), ("b", 50), ("c", 173), ("none", 5))}
    rows = spark.createDataFrame([(a, k, x, "kept") for a, v in xs.items() for k, x in enumerate(v)], "asset string, pos long, v double, more string").repartition(5)
    starts = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.01), ("absent", 1.0)], "asset string, start double")
    got = {(x.asset, x.pos): x for x in scan.scan(rows, recursion, "v", starts, chunk=7).collect()}
    last = {x.asset: x.state for x in scan.last_states(rows, recursion, "v", starts, chunk=7).collect()}
    assert len(got) == 229 and all(x.more == "kept" for x in got.values()) and set(last) == {"a", "b", "c"}
    for a, v in xs.items():
        before, after = plain_states(recursion, {"a": 0.5, "b": 0.2, "c": 0.01}.get(a), v)
        for k in range(len(v)):
            x = got[a, k]
            assert (x.state, x.state_after) == ((None, None) if a == "none" else (pytest.approx(before[k], abs=1e-12), pytest.approx(after[k], abs=1e-12)))
        assert a == "none" or last[a] == pytest.approx(after[-1], abs=1e-12)


def test_a_million_rows_of_one_asset(spark):
    """One history of 10^6 rows: chunks of 8192 over several tasks, each holding a row at a time."""
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit("a").alias("asset"), F.col("id").alias("pos"), F.when(F.pmod(F.col("id") * 48_271, F.lit(1009)) < 12, 1.0).otherwise(0.0).alias("v"))
    starts = spark.createDataFrame([("a", 0.01)], "asset string, start double")
    recursion = scan.ClippedShift(0.05, 0.01, 1e-6, 1 - 1e-6)
    out = scan.scan(rows, recursion, "v", starts)
    parts = out.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum("state").alias("s")).collect()
    level, total = 0.01, 0.0
    for k in range(n):
        total += level
        level = recursion.step(level, 1.0 if k * 48_271 % 1009 < 12 else 0.0)
    assert sum(p.n for p in parts) == n and max(p.n for p in parts) < 0.6 * n
    assert sum(p.s for p in parts) == pytest.approx(total, rel=1e-9)
    assert scan.last_states(rows, recursion, "v", starts).first().state == pytest.approx(level, abs=1e-12)


def test_volatility_and_levels_in_small_chunks(spark):
    """The methods that scan give the same rows whatever the chunks."""
    r = random.Random(9)
    rows = [("m", a, k, r.gauss(0, 1), -abs(r.gauss(1, 0.5))) for a in "ab" for k in range(200)]
    paths = spark.createDataFrame(rows, "model string, asset string, pos long, r double, q double")
    parts = conformal.split_paths(paths)
    for f in (recalibrate.fit_aci, recalibrate.fit_fhs):
        small, whole = ({(x.model, x.asset): x.param for x in f(parts, 0.05, chunk=c).collect()} for c in (9, 10_000))
        assert small == pytest.approx(whole, abs=1e-12)
    path = recalibrate.aci_path(parts, 0.05, chunk=9).collect()
    for a in "ab":
        test = [(q, x) for _, s, k, x, q in rows if s == a and k >= 140]
        levels, _ = plain_states(scan.ClippedShift(0.05, 0.05, 1e-6, 1 - 1e-6), 0.05, [float(x < q) for q, x in test])
        s = sorted(q - x for q, x in test)
        got = sorted((x.pos, x.level, x.q_t) for x in path if x.asset == a)
        for (pos, level, q_t), want in zip(got, levels, strict=True):
            at = (1.0 - want) * (len(s) - 1)
            low = math.floor(at)
            assert level == pytest.approx(want, abs=1e-12) and q_t == pytest.approx(s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low), abs=1e-9), pos
    vol = {x.pos: x.sigma for x in forecast.recursive_vol(paths.filter("asset = 'a'").select("asset", "pos", "r"), chunk=11).collect()}
    xs = [x for _, a, _, x, _ in rows if a == "a"]
    head = xs[:20]
    v = sum((x - sum(head) / 20) ** 2 for x in head) / 20
    for k, x in enumerate(xs):
        assert vol[k] == pytest.approx(math.sqrt(v), abs=1e-12)
        v = 0.94 * v + 0.06 * x * x


def test_ranks_spread_and_ties(spark):
    """A third of all values equal: ranks go on over the parts."""
    r = random.Random(1)
    rows = [(a, k, 5.0 if r.random() < 0.33 else r.choice([None, r.gauss(0, 9)])) for a in ("a", "b", None) for k in range(700)]
    df = spark.createDataFrame(rows, "asset string, pos long, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.asset, x.pos): x.rank for x in ranks.ranked(df, "v", ("asset",)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for a in ("a", "b", None):
        mine = sorted((v, k) for s, k, v in rows if s == a and v is not None)
        assert {k: n for n, (_, k) in enumerate(mine)} == {k: n for (s, k), n in got.items() if s == a}


@pytest.mark.parametrize("prob", [0.0, 0.01, 0.5, 0.99, 1.0])
def test_selection_equals_percentile(spark, prob):
    r = random.Random(7)
    rows = [(a, r.choice([None, 1.0, 1.0, r.gauss(0, 1)]) if a != "flat" else 2.0) for a, n in (("a", 5000), ("flat", 3000), ("one", 1), (None, 400), ("two", 2)) for _ in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "asset string, v double").repartition(4)
    want = {x.asset: x.q for x in df.groupBy("asset").agg(F.percentile("v", F.lit(prob)).alias("q")).filter("q is not null").collect()}
    for few in (10, 1 << 16):
        assert {x.asset: x.quantile for x in ranks.quantiles(df, "v", prob, ("asset",), few).collect()} == want


def test_selection_from_ten_million(spark, monkeypatch):
    """One group of 10^7 values, a third of them equal: what goes on after the bracket is 4 in 1000."""
    n, sizes, real = 10_000_000, [], scratch.written

    def watched(df, label):
        out = real(df, label)
        if label == "inside":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(scratch, "written", watched)
    k = F.pmod(F.col("id") * 7_368_787, F.lit(n))
    df = spark.range(n, numPartitions=8).select(F.lit("a").alias("asset"), F.when(k < n // 3, -1.0).otherwise(k.cast("double")).alias("v"))
    got = ranks.quantiles(df, "v", 0.99, ("asset",)).first().quantile
    at = (n - 1) * 0.99
    assert got == pytest.approx(at, abs=1e-6) and max(sizes) <= 5 * n // 1000
    sizes.clear()
    assert ranks.quantiles(df, "v", 0.2, ("asset",)).first().quantile == -1.0 and sizes == [0]
