"""Batched context inference and the forecast store: against a plain loop; put, get, clear, evict and racing writers."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vartide.operators import context, ranks
from vartide.sources import scratch, store


def series(spark, lengths, seed=1):
    r = random.Random(seed)
    rows = [(a, k, r.gauss(0, 1)) for a, n in lengths.items() for k in range(n)]
    df = spark.createDataFrame(rows, "asset string, pos int, r double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos")))
    return rows, df.repartition(3)


@pytest.mark.parametrize(("batch", "chunk"), [(1, 0), (7, 20), (256, 33)])
def test_contexts_equal_a_loop(spark, batch, chunk):
    rows, df = series(spark, {"a": 1, "b": 90, "c": 41})
    model = context.Redrawn(context_length=16, n_samples=5)
    got = {(x.asset, x.pos): x.output for x in context.infer(df, model, batch, 3, chunk).collect()}
    assert set(got) == {(a, k) for a, k, _ in rows if k >= 3}
    for (a, k), output in got.items():
        past = np.array([x for s, i, x in rows if s == a and k - 16 <= i < k], np.float32)
        own = [float(past[((2026 + k) * (2 * i + 1) * 7919 + 104_729 * i) % len(past)]) for i in range(5)]
        assert output == own


def test_grids_and_paths(spark):
    rows, df = series(spark, {"a": 60})
    model = context.ContextGrid(context_length=512)
    inferred = context.infer(df, model, least=10)
    by_pos = {x.pos: x.output for x in inferred.collect()}
    for k in (10, 33, 59):
        past = np.array([x for _, i, x in rows if i < k], np.float32).astype(float)
        assert by_pos[k] == pytest.approx(np.quantile(past, model.levels), abs=1e-12)
    path = context.path(inferred, model, 0.1).collect()
    assert len(path) == 50 and all(x.es <= x.q + 1e-12 and x.q == pytest.approx(by_pos[x.pos][0], abs=1e-11) for x in path)


def test_a_model_opens_once_in_a_worker(spark, tmp_path):
    class Counted(context.ContextModel):
        def open(self):
            import os
            import uuid

            open(f"{tmp_path}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
            return lambda contexts, lengths, seeds: np.nansum(contexts, axis=1, keepdims=True)

    _, df = series(spark, {f"s{k}": 30 for k in range(12)})
    assert context.infer(df, Counted(model_id="counted"), batch=4).count() == 12 * 29
    opened = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert opened and len(opened) == len(set(opened))


def forecasts(spark, n, model="m", seed=1, value=0.5):
    rows = [(model, None, [float(k), float(k + 1)], k, 3, seed, [value + k, 2.0, 3.0]) for k in range(n)]
    return spark.createDataFrame(rows, "model string, revision string, context array<double>, pos long, n_samples int, seed long, output array<double>").repartition(2)


@pytest.fixture
def held(spark, tmp_path):
    return store.ForecastStore(spark, f"file://{tmp_path}/store")


def test_put_and_get(spark, held):
    rows = forecasts(spark, 20)
    assert held.entries().count() == 0 and held.get(rows.drop("output"))[1].count() == 20
    name = held.put(rows)
    assert name and held.put(rows) is None and list(held.batches()) == [name]
    have, lack = held.get(forecasts(spark, 25).drop("output"))
    assert sorted((x.pos, x.output[0]) for x in have.collect()) == [(k, 0.5 + k) for k in range(20)] and sorted(x.pos for x in lack.collect()) == list(range(20, 25))
    for other in (forecasts(spark, 5, seed=2), forecasts(spark, 5, model="n"), forecasts(spark, 5).withColumn("context", F.array(F.lit(9.0))), forecasts(spark, 5).withColumn("revision", F.lit("2"))):
        assert held.get(other.drop("output"))[0].count() == 0
    near = forecasts(spark, 5).withColumn("context", F.transform("context", lambda x: x * (1 + 1e-12)))  # the same 32-bit floats
    assert held.get(near.drop("output"))[0].count() == 5
    assert held.put(forecasts(spark, 25)) and held.entries().count() == 25


def test_two_writers_make_one_commit(spark, held, monkeypatch):
    """Both write the same rows at once; both saw an empty store. One manifest, and no rows of the other stay."""
    rows, real, gate, names = forecasts(spark, 30), store.ForecastStore._commit, threading.Barrier(2), []

    def together(self, new, batch=None):
        new = scratch.written(new, "new")
        gate.wait()
        return real(self, new, batch)

    monkeypatch.setattr(store.ForecastStore, "_commit", together)
    threads = [threading.Thread(target=lambda: names.append(held.put(rows))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x is None for x in names) == [False, True]
    folders = [f.getPath().getName() for f in held._fs.listStatus(held._at("data"))]
    assert len(held.batches()) == 1 and folders == [b["folder"] for b in held.batches().values()] and held.entries().count() == 30


def test_clear_and_evict(spark, held):
    for k, model in enumerate(("m", "n", "m")):
        held.put(forecasts(spark, 10, model=model, seed=k))
    held.put(forecasts(spark, 4, model="m", seed=7).unionByName(forecasts(spark, 4, model="n", seed=7)))
    assert held.entries().count() == 38
    assert held.evict(24 * 38) == 0 and held.evict(24 * 20) == 18
    assert held.entries().count() == 20 and {x.seed for x in held.entries().collect()} == {1, 2, 7}  # the oldest are gone
    assert held.entries().filter("seed = 1").count() == 2
    held.clear("n")
    assert {x.model for x in held.entries().collect()} == {"m"} and held.entries().count() == 14
    held.clear()
    assert held.entries().count() == 0 and held.batches() == {} and held.put(forecasts(spark, 2))


def test_running_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(k, r.choice([1.5, 2.0, math.pi]), r.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, stamp double, size long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.id: x.running for x in ranks.cumulated(df, [F.col("stamp").desc(), F.col("id").asc()], "size").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for k, _, size in sorted(rows, key=lambda x: (-x[1], x[0])):
        total += size
        assert got[k] == total
