"""Return series: log returns, positions, filters, panels and their characteristics.

All semantics are positional within an asset: `pos` counts an asset's returns from 0 in date order. One
window by asset carries everything, so a panel is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_asset(*keys: str):
    return Window.partitionBy(*(keys or ("asset",))).orderBy("date")


def exact(x: Column) -> Column:
    """Twelve decimal places: the same double in any engine, so that comparisons at ties agree."""
    return x.cast("decimal(18,12)").cast("double")


def log_returns(prices: DataFrame) -> DataFrame:
    """asset, date, r, pos from asset, date, p; each asset's first day has no return."""
    r = prices.withColumn("r", exact(F.ln(F.col("p") / F.lag("p").over(by_asset())))).filter(F.col("r").isNotNull())
    return r.select("asset", "date", "r", (F.row_number().over(by_asset()) - 1).alias("pos"))


def without_outliers(returns: DataFrame, most: float = 0.5) -> DataFrame:
    return returns.filter(F.abs("r") <= most)


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as null: Spark orders NaN above all numbers, which would make 0.1 < NaN true."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def from_wide(wide: DataFrame, date: str = "date") -> DataFrame:
    """asset, date, r, pos from a table with one column for each asset; missing values drop out."""
    assets = [c for c in wide.columns if c != date]
    long = nan_to_null(wide.unpivot([date], assets, "asset", "r"), "r").dropna(subset=["r"]).withColumnRenamed(date, "date")
    return long.select("asset", "date", "r", (F.row_number().over(by_asset()) - 1).alias("pos"))


def to_wide(long: DataFrame, value: str = "r") -> DataFrame:
    return long.groupBy("date").pivot("asset").agg(F.first(value))


def daily_prices(rows: DataFrame, asset: Column, day: Column, amount: Column) -> DataFrame:
    """asset, date, p: exact daily sums (decimal), one partial aggregation."""
    total = F.sum(amount.cast("decimal(18,2)")).cast("double")
    return rows.groupBy(asset.alias("asset"), day.cast("date").alias("date")).agg(total.alias("p"))


def characteristics(returns: DataFrame) -> DataFrame:
    """Per asset: observations, yearly volatility, excess kurtosis (bias-corrected), skewness, lag-1
    autocorrelation, share below mean - 3 sd, and the reports' two-sided tail share and biased kurtosis."""
    lagged = returns.withColumn("prev", F.lag("r").over(by_asset()))
    w = Window.partitionBy("asset")
    marked = lagged.withColumns({"mu": F.avg("r").over(w), "sd1": F.stddev_samp("r").over(w), "sd0": F.stddev_pop("r").over(w)})
    n = F.count("r").cast("double")
    g2 = F.kurtosis("r")
    return marked.groupBy("asset").agg(
        F.count("r").alias("n_obs"),
        (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("annual_vol"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis_adj"),
        g2.alias("kurtosis_pop"),
        F.skewness("r").alias("skew_pop"),
        F.corr("r", "prev").alias("autocorr1"),
        F.avg((F.col("r") < F.col("mu") - 3 * F.col("sd1")).cast("double")).alias("tail_one_sided"),
        F.avg((F.abs(F.col("r") - F.col("mu")) > 3 * F.col("sd0")).cast("double")).alias("tail_two_sided"),
    )
