"""Readers, writers, verbs and report text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vartide.operators import conformal, forecast
from vartide.plans import api, reporting
from vartide.sources import io
from tests_support import series


def test_forecast_files_round_trip(spark, tmp_path):
    rs = series(spark, 60, 2)
    long = forecast.hist_sim(rs, 0.01, 20).select("model", "asset", "date", F.lit(0.01).alias("alpha"), "q").unionByName(forecast.hist_sim(rs, 0.05, 20).select("model", "asset", "date", F.lit(0.05).alias("alpha"), "q"))
    io.write_forecasts(long, str(tmp_path / "f"))
    back = io.read_forecasts(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    assert "PartitionFilters: [isnotnull(asset" in back.filter("asset = 'a1'")._jdf.queryExecution().toString()


def test_only_missing_pairs_are_written(spark, tmp_path):
    rs = series(spark, 30, 3)
    path = forecast.hist_sim(rs, 0.05, 10)
    assert io.write_new(path.filter("asset <> 'a2'"), str(tmp_path / "p")) == 60
    assert io.write_new(path, str(tmp_path / "p")) == 30
    assert io.write_new(path, str(tmp_path / "p")) == 0 and spark.read.parquet(str(tmp_path / "p")).count() == 90


def test_small_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "GOLD.csv").write_text("date,log_return\n2020-01-01,0.1\n2020-01-02,\n2020-01-03,-0.2\n")
    assert [(r.asset, r.r) for r in io.read_returns_csv(spark, str(tmp_path / "r")).orderBy("date").collect()] == [("GOLD", 0.1), ("GOLD", -0.2)]
    (tmp_path / "m.json").write_text('{"SP500": "^GSPC", "GOLD": "GC=F"}')
    assert {r.key: r.value for r in io.read_map_json(spark, str(tmp_path / "m.json")).collect()} == {"SP500": "^GSPC", "GOLD": "GC=F"}
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.bin").write_bytes(b"x")
    (tmp_path / "z" / "b.bin").write_bytes(b"y")
    want = {"a.bin": hashlib.sha256(b"x").hexdigest(), "b.bin": "0"}
    assert {r.file: r.ok for r in io.verified(spark, str(tmp_path / "z"), want).collect()} == {"a.bin": True, "b.bin": False}
    io.write_csv(spark.createDataFrame([(1, "p")], "Unnamed int, v string"), str(tmp_path / "c"))
    assert io.read_results_csv(spark, str(tmp_path / "c"), {"Unnamed": "id"}).columns == ["id", "v"]


def test_price_source(spark, tmp_path):
    for t, p in (("A", 10.0), ("B", 20.0)):
        (tmp_path / f"{t}.csv").write_text(f"date,close\n2020-01-01,{p}\n2020-01-02,{p * 2}\n")
    io.register_price_source(spark)
    got = spark.read.format("vartide_prices").option("folder", str(tmp_path)).option("tickers", "A,B").load()
    assert got.groupBy("asset").agg(F.sum("p").alias("s")).orderBy("asset").collect() == [("A", 30.0), ("B", 60.0)]


def test_plausible_pairs(spark):
    p = spark.createDataFrame([("m", "a", -0.1), ("m", "b", -40.0)], "model string, asset string, q double")
    assert [r.asset for r in io.plausible_pairs(p).collect()] == ["a"]


def test_verbs(spark):
    rs = series(spark, 300, 2)
    with pytest.raises(ValueError):
        api.audit(rs)
    with pytest.raises(ValueError):
        api.audit(rs, forecaster="hist_sim", mode="other")
    path = forecast.hist_sim(rs, 0.05, 50)
    a = api.audit(rs, path.select("model", "asset", "date", "q"), alpha=0.05).select("asset", "q_v", "viol_corr").orderBy("asset").collect()
    assert a == conformal.static_audit(path, 0.05).select("asset", "q_v", "viol_corr").orderBy("asset").collect()
    assert api.audit(rs, forecaster=lambda r, al, w: forecast.constant(r), alpha=0.05).filter("regime = 'replacement'").count() == 2
    assert api.audit(rs, forecaster="hist_sim", mode="rolling", alpha=0.05, window=50).count() == 2
    both = path.unionByName(forecast.rolling_normal(rs, 0.05, 50).drop("es"))
    tests = api.compare(both, 0.05)
    assert tests.count() == 2 and api.p_value_matrix(tests.filter("asset = 'a0'")).columns == ["model_a", "norm_roll"]
    same = api.compare(path.unionByName(path.withColumn("model", F.lit("twin"))), 0.05).collect()
    assert all(r.dm == 0 and r.p_value == 1 for r in same)
    verdict = api.classify_regime(path, alpha=0.05).first()
    assert verdict.q_lo <= verdict.q_hi and verdict.regime in ("replacement", "signal-preserving")
    master = api.audit_panel(rs, ["hist_sim", "norm_roll"], 0.05, 50)
    assert master.count() == 4 and api.regime_summary(master).filter("pairs = 2").count() == 2
    assert "hist_sim on a0" in reporting.summary(master.filter("model = 'hist_sim' and asset = 'a0'").first())
    assert reporting.comparison(master).count(r"\\") == 5


def test_disjoint_dates_give_nothing(spark):
    rs = series(spark, 50, 1)
    late = forecast.constant(rs).withColumn("date", F.date_add("date", 1000)).select("model", "asset", "date", "q")
    assert api.audit(rs, late).count() == 0


def test_text():
    assert reporting.half_up(0.125, 2) == "0.13" and reporting.half_up(2.5, 0) == "3" and reporting.half_up(None, 2) == "--"
    assert [reporting.stars(p) for p in (0.005, 0.03, 0.07, 0.5, None)] == ["***", "**", "*", "", ""]
    assert reporting.escape("a_b&c") == r"a\_b\&c"
