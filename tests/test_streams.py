"""Streams whose rows come late and out of order give the rows of the batch job."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vartide.operators import conformal
from vartide.streaming import ordered

DAY = datetime.datetime(2024, 1, 1)


def rows_of(n=60, assets=("a", "b")):
    r = random.Random(4)
    return [("m", a, k, r.gauss(0, 1), -1.5 + 0.1 * r.random(), DAY + datetime.timedelta(days=k)) for a in assets for k in range(n)]


SCHEMA = "model string, asset string, pos long, r double, q double, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def batches(spark, where, parts, schema=SCHEMA):
    """A stream that reads one part a micro-batch."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{where}/{k:03}")
        (path,) = (p for p in (where / f"{k:03}").iterdir() if p.suffix == ".parquet")
        path.rename(where / f"{k:03}.parquet")
        import os
        import shutil

        shutil.rmtree(where / f"{k:03}")
        os.utime(where / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where))


def run(df, name, where):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(where)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def batch_rows(spark, rows, window):
    got = conformal.rolling_qv(spark.createDataFrame(rows, SCHEMA), 0.05, window).collect()
    return {(x.asset, x.pos): x.q_v for x in got}


def test_shuffled_micro_batches(spark, tmp_path, rocks):
    rows = rows_of()
    mixed = random.Random(1).sample(rows, len(rows))
    stream = batches(spark, tmp_path, [mixed[k : k + 20] + mixed[k : k + 2] for k in range(0, len(mixed), 20)])
    got = run(ordered.monitor(stream, 0.05, 20, "100 days"), "shuffled", tmp_path / "ck")
    want = batch_rows(spark, rows, 20)
    assert len(got) == len(want) == 80 and all(x.q_v == pytest.approx(want[x.asset, x.pos], abs=1e-12) and x.skipped == 0 for x in got)
    places = [x.pos for x in got if x.asset == "a"]
    assert places == sorted(places)


def test_history_from_a_batch_table(spark, tmp_path, rocks):
    rows = rows_of(assets=("a",))
    stream = batches(spark, tmp_path, [rows[50:], rows[40:50]])
    got = run(ordered.monitor(stream, 0.05, 20, "100 days", history=spark.createDataFrame(rows[:40], SCHEMA)), "continued", tmp_path / "ck")
    want = batch_rows(spark, rows, 20)
    assert [x.pos for x in got] == list(range(40, 60)) and all(x.q_v == pytest.approx(want["a", x.pos], abs=1e-12) for x in got)


def test_a_gap_is_given_up(spark, tmp_path, rocks):
    rows = [x for x in rows_of(assets=("a",)) if x[2] not in (30, 31)]
    parts = [rows[:25], rows[25:40], rows[40:], [("m", "z", 0, 0.0, -1.0, DAY + datetime.timedelta(days=400))], [("m", "z", 1, 0.0, -1.0, DAY + datetime.timedelta(days=401))]]
    got = run(ordered.monitor(batches(spark, tmp_path, parts), 0.05, 20, "1 day", patience_ms=86_400_000), "gap", tmp_path / "ck")
    assert [x.pos for x in got if x.asset == "a"] == [*range(20, 30), *range(32, 60)] and sum(x.skipped for x in got) == 2


def test_returns_meet_forecasts(spark, tmp_path):
    rows = rows_of(20)
    mixed = random.Random(2).sample(rows, len(rows))
    (tmp_path / "r").mkdir()
    (tmp_path / "f").mkdir()
    returns = batches(spark, tmp_path / "r", [[(a, k, t, r) for _, a, k, r, _, t in part] for part in (mixed[:15], mixed[15:])], "asset string, pos long, ts timestamp, r double")
    forecasts = batches(spark, tmp_path / "f", [[(m, a, k, t, q) for m, a, k, _, q, t in part] for part in (rows[:5], rows[5:])], "model string, asset string, pos long, ts timestamp, q double")
    got = run(ordered.joined(returns, forecasts, "100 days"), "met", tmp_path / "ck")
    assert sorted((x.asset, x.pos, x.r, x.q) for x in got) == sorted((a, k, r, q) for _, a, k, r, q, _ in rows)
    assert spark.createDataFrame(rows, SCHEMA).agg(F.count("*")).first()[0] == 40
