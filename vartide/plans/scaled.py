"""Queries of what long histories need: selection instead of sorting, wide windows, scans in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.operators import conformal, forecast, ranks
from vartide.plans import report as R
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.sources import panels

ALPHA, W = R.ALPHA, R.W
PAIR = conformal.PAIR
WIDE = 1000


@query(Shape("model asset", "", "q_v", 9), f"{S.models()},\n{S.parts()},\n{S.qv()}", "qv")
def static_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static correction of every pair by selection: no task holds a pair's scores."""
    return conformal.fit_static(conformal.split_paths(R.paths(spark, sf_dir)), ALPHA, "selected")


@query(
    Shape("asset date", "", "q q_v", 9),
    f"{S.returns('c')},\n{S.hist_sim(ALPHA, WIDE)}, sc AS (SELECT asset, date, pos, q, quantile_cont(q - r, {1 - ALPHA!r}) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS q_v FROM hs)",
    f"(SELECT * FROM sc WHERE pos >= {W})",
)
def rolling_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical simulation over 1000 days with a correction over the last 250, every nation and day."""
    return conformal.rolling_qv(forecast.hist_sim(panels.panel(spark, sf_dir, "c"), ALPHA, WIDE), ALPHA, W)


@query(
    Shape("asset pos", "", "sigma", 9),
    f"""{S.returns("c")}, st AS (SELECT asset, VAR_POP(r) AS v0 FROM ret WHERE pos < 20 GROUP BY asset),
vt AS (SELECT a.asset, a.pos, SQRT(GREATEST(POW(0.94::DOUBLE, a.pos) * ANY_VALUE(v0) + COALESCE(SUM(0.06::DOUBLE * b.r * b.r * POW(0.94::DOUBLE, a.pos - 1 - b.pos)), 0), 1e-20)) AS sigma
FROM ret a JOIN st USING (asset) LEFT JOIN ret b ON a.asset = b.asset AND b.pos < a.pos AND b.pos >= a.pos - 1000 GROUP BY a.asset, a.pos)""",
    "vt",
)
def recursive_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive volatility of every nation and day, by composed steps; chunks of 256 days."""
    return forecast.recursive_vol(panels.panel(spark, sf_dir, "c"), chunk=256)


@query(
    Shape("asset pos", "rank n", "share", 9),
    f"{S.returns('c')}",
    "(SELECT asset, pos, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY r, pos) - 1 AS rank, COUNT(*) OVER (PARTITION BY asset) AS n, (ROW_NUMBER() OVER (PARTITION BY asset ORDER BY r, pos) - 0.5::DOUBLE) / COUNT(*) OVER (PARTITION BY asset) AS share FROM ret)",
)
def return_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's place among its nation's returns, by sorted ranges."""
    rows = ranks.ranked(panels.panel(spark, sf_dir, "c").select("asset", "pos", "r"), "r", ("asset",))
    n = rows.groupBy("asset").agg(F.count("*").alias("n"))
    return rows.join(n, "asset").withColumn("share", (F.col("rank") + 0.5) / F.col("n"))
