"""Queries that evaluate every day and every asset, on the whole panel and on a short one."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests_support import series

from vartide.plans import catalog, fitted
from vartide.sources import panels

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sample_distribution_daily", "grid_distribution_daily", "asof_next_return_daily", "dm_matrix_assets"])
def test_every_day_and_asset_as_in_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    rows = catalog.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    flat = lambda r: [None if isinstance(x, float) and math.isnan(x) else x for x in r]
    got, key = [tuple(flat(r)) for r in rows.collect()], lambda r: tuple(map(str, r[:2]))
    want = sorted((tuple(flat(r)) for r in db.execute(catalog.ORACLE_SQL[name]).fetchall()), key=key)
    got.sort(key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or x == pytest.approx(y, abs=1e-6) for x, y in zip(a, b, strict=True)), (a, b)
    panel = panels.panel(spark, SF)
    if name == "dm_matrix_assets":
        assert {r[0] for r in got} == {r[0] for r in panel.select("asset").distinct().collect()}
    else:
        assert len(got) == panel.filter("pos >= 50" if "distribution" in name else "true").count()


def test_a_tail_for_every_day(spark, monkeypatch):
    monkeypatch.setattr(panels, "panel", lambda spark, sf_dir, kind="a": series(spark, n=56, assets=2).filter(F.col("pos") >= 0))
    got = {r.id for r in fitted.tail_completion(spark, "").collect()}
    assert got == {f"a{k}:2020-02-{d}" for k in range(2) for d in range(20, 26)}
