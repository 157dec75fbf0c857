"""Queries of forecasters over batches of contexts, and of the store of their forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.operators import conformal, context
from vartide.plans import report as R
from vartide.plans import sql as S
from vartide.plans.registry import Shape, query
from vartide.sources import panels, scratch, store

ALPHA = R.ALPHA
LEVEL, LEAST = 0.05, 50
DRAWN, GRID = context.Redrawn(), context.ContextGrid()

_CONTEXTS = f"{S.returns()}, cx AS (SELECT asset, date, pos, r, list(CAST(CAST(r AS FLOAT) AS DOUBLE)) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN {DRAWN.context_length} PRECEDING AND 1 PRECEDING) AS c FROM ret)"
_SAMPLES = f"sa AS (SELECT asset, date, pos, r, list_sort(list_transform(range({DRAWN.n_samples}), lambda k: c[CAST((({DRAWN.seed} + pos) * (2 * k + 1) * 7919 + 104729 * k) % len(c) AS BIGINT) + 1])) AS s FROM cx WHERE pos >= {LEAST})"
_AT = (DRAWN.n_samples - 1) * LEVEL
_LOW = int(_AT)


@query(
    Shape("asset date", "", "quantile shortfall", 9),
    f"{_CONTEXTS},\n{_SAMPLES}, sq AS (SELECT *, s[{_LOW + 1}] + (s[{_LOW + 2}] - s[{_LOW + 1}]) * ({_AT!r}::DOUBLE - {_LOW}) AS q FROM sa)",
    "(SELECT asset, date, q AS quantile, list_avg(list_filter(s, lambda x: x <= q)) AS shortfall FROM sq)",
)
def context_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling model over every day's last 512 returns: its quantile and shortfall."""
    rows = context.infer(panels.panel(spark, sf_dir), DRAWN, least=LEAST)
    q, es = context.figures(F.col("output"), DRAWN, LEVEL)
    return rows.select("asset", "date", q.alias("quantile"), es.alias("shortfall"))


_G = ", ".join(f"quantile_cont(r0, {u!r}) OVER w" for u in GRID.levels)
_KNOTS = f"{S.returns()}, rf AS (SELECT asset, date, pos, r, CAST(CAST(r AS FLOAT) AS DOUBLE) AS r0 FROM ret), gr AS (SELECT asset, date, pos, r, [{_G}] AS g FROM rf WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN {GRID.context_length} PRECEDING AND 1 PRECEDING))"
_OUTER = f"g[1] + (g[2] - g[1]) / ({GRID.levels[1]!r}::DOUBLE - {GRID.levels[0]!r}::DOUBLE) * ({ALPHA!r}::DOUBLE - {GRID.levels[0]!r}::DOUBLE)"
_PATHS = f"paths AS (SELECT 'context_grid' AS model, asset, date, pos - {LEAST} AS pos, r, {S.exact(_OUTER)} AS q FROM gr WHERE pos >= {LEAST})"


@query(Shape("model asset zone_corr regime", "n_test viol_raw viol_corr", "q_v pi_corr ratio", 6), f"{_KNOTS},\n{_PATHS},\n{S.parts()},\n{S.qv()},\n{S.TEST},\n{S.backtest()}", "bt")
def context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static audit of a model with a quantile head, its tail completed along the two outer knots."""
    rows = context.infer(panels.panel(spark, sf_dir), GRID, least=LEAST)
    path = context.path(rows, GRID, ALPHA).withColumn("pos", F.col("pos") - LEAST)
    return conformal.static_audit(path.drop("es"), ALPHA)


def stored_forecasts(returns: DataFrame, model: context.ContextModel, where: str, least: int = LEAST) -> DataFrame:
    """Forecasts of every day from the store at `where`; days that it lacks are inferred and put there first."""
    spark = returns.sparkSession
    held = store.ForecastStore(spark, where)
    days = context.contexts(returns, model, least)
    have, lack = held.get(days)
    if not lack.isEmpty():
        fresh = context.infer(returns, model, least=least).select("asset", "pos", "output")
        held.put(lack.join(fresh, ["asset", "pos"]))
        have, _ = held.get(days)
    return have


@query(
    Shape("asset", "days first_hits second_hits", "mean_q", 9),
    f"{_CONTEXTS},\n{_SAMPLES}, sq AS (SELECT *, s[{_LOW + 1}] + (s[{_LOW + 2}] - s[{_LOW + 1}]) * ({_AT!r}::DOUBLE - {_LOW}) AS q FROM sa)",
    "(SELECT asset, COUNT(*) AS days, 0 AS first_hits, COUNT(*) AS second_hits, AVG(q) AS mean_q FROM sq GROUP BY asset)",
)
def context_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts put in a new store and read back: hits before and after, by asset."""
    returns = scratch.written(panels.panel(spark, sf_dir), "returns")
    where = f"{scratch.folder(spark)}/store-{spark.sparkContext.applicationId}-{scratch.uuid.uuid4().hex}"
    days = scratch.written(context.contexts(returns, DRAWN, LEAST), "contexts")
    before = scratch.written(store.ForecastStore(spark, where).get(days)[0].select("asset"), "hits")
    after = stored_forecasts(returns, DRAWN, where)
    q = context.figures(F.col("output"), DRAWN, LEVEL)[0]
    hits = after.groupBy("asset").agg(F.count("*").alias("second_hits"), F.avg(q).alias("mean_q"))
    first = before.groupBy("asset").agg(F.count("*").alias("first_hits"))
    return days.groupBy("asset").agg(F.count("*").alias("days")).join(hits, "asset").join(first, "asset", "left").fillna(0, ["first_hits"])
