"""SQL functions against the Column functions, and the table function against the grouped bootstrap."""

import random

import pytest
from pyspark.sql import functions as F

from vartide.functions import stats, surface
from vartide.operators import conformal, fit


@pytest.fixture(scope="module")
def functions(spark):
    surface.register(spark)
    surface.register(spark)  # again is allowed


def test_functions_equal_columns(spark, functions):
    r = random.Random(3)
    rows = [(float(x), float(n), r.choice([0.01, 0.05]), r.gauss(0, 2), -abs(r.gauss(2, 1)), *[float(r.choice([0, 1, 5, 300])) for _ in range(4)]) for n in (0, 1, 200, 250, 900) for x in {0, min(n, 4), min(n, 9), n // 3, n}]
    df = spark.createDataFrame(rows, "x double, n double, a double, r double, q double, n00 double, n01 double, n10 double, n11 double")
    c = {k: F.col(k) for k in df.columns}
    e = c["q"] - 0.5
    pairs = {
        "va_kupiec_lr(x, n, a)": stats.kupiec_lr(c["x"], c["n"], c["a"]), "va_kupiec_p(x, n, a)": stats.kupiec_p(c["x"], c["n"], c["a"]), "va_transition_lr(n00, n01, n10, n11)": stats.transition_lr(c["n00"], c["n01"], c["n10"], c["n11"]),
        "va_basel_zone(x, n)": stats.basel_zone(c["x"], c["n"]), "va_pinball(r, q, a)": stats.pinball(c["r"], c["q"], c["a"]), "va_fz0(r, q, q - 0.5, a)": stats.fz0(c["r"], c["q"], e, c["a"]),
        "va_erf(r)": stats.erf(c["r"]), "va_normal_cdf(r)": stats.normal_cdf(c["r"]), "va_chi2_sf1(n00)": stats.chi2_sf1(c["n00"]), "va_chi2_sf2(n00)": stats.chi2_sf2(c["n00"]),
    }
    for k, (sql, column) in enumerate(pairs.items()):
        for row in df.select(F.expr(sql).alias("got"), column.alias("want")).collect():
            assert row.got == (row.want if isinstance(row.want, str) else pytest.approx(row.want, abs=1e-12)), (k, sql)


def test_table_function_equals_grouped_bootstrap(spark, functions):
    r = random.Random(1)
    rows = [("m", a, k, r.gauss(0, 1), -1.0) for a in ("x", "y", None) for k in range(120)]
    parts = conformal.split_paths(spark.createDataFrame(rows, "model string, asset string, pos long, r double, q double").repartition(4))
    parts.filter("role = 'cal'").select("model", "asset", "pos", "score").createOrReplaceTempView("scores")
    got = spark.sql("SELECT * FROM va_bootstrap(TABLE(scores) PARTITION BY (model, asset) ORDER BY (pos), 0.05D, 99, 10D, 5)").collect()
    want = {x.asset: x for x in fit.bootstrap_ci(parts, 0.05, draws=99, mean_block=10.0, seed=5).collect()}
    assert len(got) == 3 and all(tuple(x) == pytest.approx(tuple(want[x.asset])) if x.asset else x.q_lo <= x.q_v <= x.q_hi for x in got)
    assert spark.sql("SELECT * FROM va_bootstrap(TABLE(SELECT * FROM scores WHERE false) PARTITION BY (model, asset) ORDER BY (pos), 0.05D, 99, 10D, 5)").count() == 0
