"""Monte-Carlo studies: replications are rows, each simulated in a task with a seed of its own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAWS = ("normal", "t5", "t3", "skew_t", "mixture")


def hansen_constants(df: float, skew: float) -> tuple[float, float, float]:
    """(a, b, c) of Hansen's skewed t law."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi * (df - 2))
    a = 4 * skew * c * (df - 2) / (df - 1)
    return a, math.sqrt(1 + 3 * skew**2 - a * a), c


def innovations(law: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of mean 0 and variance 1."""
    if law == "normal":
        return rng.standard_normal(n)
    if law in ("t5", "t3"):
        df = int(law[1])
        return rng.standard_t(df, n) / math.sqrt(df / (df - 2))
    if law == "skew_t":
        df, skew = 3.0, -0.5
        a, b, _ = hansen_constants(df, skew)
        t = np.abs(rng.standard_t(df, n)) * math.sqrt((df - 2) / df)
        right = rng.random(n) < (1 + skew) / 2
        return (np.where(right, (1 + skew) * t, -(1 - skew) * t) - a) / b
    calm = rng.random(n) < 0.9
    return np.where(calm, rng.standard_normal(n), 3 * rng.standard_normal(n)) / math.sqrt(0.9 + 0.1 * 9)


def garch_path(n: int, eps: np.ndarray, omega: float = 1e-5, a: float = 0.10, b: float = 0.85, shocked: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(returns, deviations); omega is tripled inside `shocked`."""
    r, s = np.empty(n), np.empty(n)
    v = omega / (1 - a - b)
    for t in range(n):
        s[t] = math.sqrt(v)
        r[t] = s[t] * eps[t]
        w = omega * 3 if shocked and shocked[0] <= t < shocked[1] else omega
        v = w + a * r[t] ** 2 + b * v
    return r, s


def study(spark: SparkSession, reps: int = 500, lengths: tuple[int, ...] = (1000, 5000), laws: tuple[str, ...] = LAWS, alpha: float = 0.01, split: float = 0.7, seed: int = 2026) -> DataFrame:
    """law, length, rep: normal forecasts with the true deviations, corrected by the hybrid quantile."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(alpha)
    cells = [F.struct(F.lit(law).alias("law"), F.lit(n).alias("length")) for law in laws for n in lengths]
    grid = spark.range(reps).withColumnRenamed("id", "rep").withColumn("cell", F.explode(F.array(*cells))).select("cell.law", "cell.length", "rep").repartition(64, "law", "length", "rep")

    def run(batches):
        for pdf in batches:
            rows = []
            for law, n, rep in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, LAWS.index(law), int(n), int(rep)])
                r, s = garch_path(n, innovations(law, n, rng))
                q, cut = z * s, int(n * split)
                score = np.sort(q[:cut] - r[:cut])
                q_v = float(np.quantile(score, min(1.0, math.ceil((cut + 1) * (1 - alpha)) / cut)))
                hit = r[cut:] < q[cut:] - q_v
                rows.append((law, n, rep, q_v, float((r[cut:] < q[cut:]).mean()), float(hit.mean()), bool(hit.sum() * 250 / len(hit) <= 4)))
            yield pd.DataFrame(rows, columns=["law", "length", "rep", "q_v", "pi_raw", "pi_corr", "green"])

    return grid.mapInPandas(run, "law string, length int, rep long, q_v double, pi_raw double, pi_corr double, green boolean")


def summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("law", "length").agg(
        F.count("*").alias("reps"), F.avg("q_v").alias("mean_q_v"), F.stddev_pop("q_v").alias("std_q_v"), F.try_divide(F.stddev_pop("q_v"), F.abs(F.avg("q_v"))).alias("cv"),
        F.avg("pi_raw").alias("mean_pi_raw"), F.avg("pi_corr").alias("mean_pi_corr"), (100 * F.avg(F.col("green").cast("double"))).alias("green_pct"),
    )


def rolling_normal_path(r: np.ndarray, window: int, z: float) -> np.ndarray:
    """Normal quantiles from the mean and deviation of the `window` returns before each day; nan at the start."""
    q = np.full(len(r), np.nan)
    past = np.lib.stride_tricks.sliding_window_view(r, window)[:-1]
    q[window:] = past.mean(axis=1) + z * past.std(axis=1)
    return q


def hybrid_level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


#: Fixed values of the studies: lengths, calibration shares.
SAMPLE_SIZES, SHORT_SIZES, SHARES = (250, 500, 1000, 2000, 5000), (250, 500, 1000), (0.4, 0.5, 0.6, 0.7, 0.8)


def robustness(spark: SparkSession, reps: int = 500, alpha: float = 0.01, seed: int = 2027) -> DataFrame:
    """study, law, length, split, rep: rolling normal forecasts on simulated returns, corrected by the hybrid
    quantile. Study 1: every law and sample size at a share of .7; study 2: two laws, short samples, all shares."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(alpha)
    cells = [(1, law, n, 0.7) for law in LAWS for n in SAMPLE_SIZES] + [(2, law, n, f) for law in ("t5", "skew_t") for n in SHORT_SIZES for f in SHARES]
    one = [F.struct(F.lit(k).alias("study"), F.lit(law).alias("law"), F.lit(n).alias("length"), F.lit(f).alias("split")) for k, law, n, f in cells]
    grid = spark.range(reps).withColumnRenamed("id", "rep").withColumn("c", F.explode(F.array(*one))).select("c.*", "rep").repartition(64, "study", "law", "length", "split", "rep")

    def run(batches):
        for pdf in batches:
            rows = []
            for study_, law, n, split, rep in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, study_, LAWS.index(law), int(n), int(split * 10), int(rep)])
                r, _ = garch_path(n, innovations(law, n, rng))
                window = min(250, max(50, n // 5))
                q = rolling_normal_path(r, window, z)[window:]
                r = r[window:]
                cut = int(len(r) * split)
                q_v = float(np.quantile(q[:cut] - r[:cut], hybrid_level(cut, alpha)))
                hit = r[cut:] < q[cut:] - q_v
                rows.append((study_, law, n, split, rep, q_v, float((r[cut:] < q[cut:]).mean()), float(hit.mean()), bool(hit.sum() * 250 / len(hit) <= 4)))
            yield pd.DataFrame(rows, columns=["study", "law", "length", "split", "rep", "q_v", "pi_raw", "pi_corr", "green"])

    return grid.mapInPandas(run, "study int, law string, length int, split double, rep long, q_v double, pi_raw double, pi_corr double, green boolean")


def robustness_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("study", "law", "length", "split").agg(
        F.count("*").alias("reps"), F.avg("q_v").alias("mean_q_v"), F.stddev_pop("q_v").alias("std_q_v"), F.avg("pi_raw").alias("mean_pi_raw"), F.avg("pi_corr").alias("mean_pi_corr"),
        (100 * F.avg(F.col("green").cast("double"))).alias("green_pct"),
    )


def regime_shift(spark: SparkSession, reps: int = 200, length: int = 5000, shock: tuple[int, int] = (2000, 2500), window: int = 250, alpha: float = 0.01, seed: int = 2028) -> DataFrame:
    """law, rep and the mean rolling correction before, during and (a window) after a stretch of tripled omega."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(alpha)
    grid = spark.range(reps).withColumnRenamed("id", "rep").withColumn("law", F.explode(F.array(F.lit("t5"), F.lit("skew_t")))).repartition(64, "law", "rep")

    def run(batches):
        for pdf in batches:
            rows = []
            for rep, law in pdf[["rep", "law"]].itertuples(index=False):
                rng = np.random.default_rng([seed, LAWS.index(law), int(rep)])
                r, _ = garch_path(length, innovations(law, length, rng), shocked=shock)
                score = (rolling_normal_path(r, window, z) - r)[window:]
                q = np.quantile(np.lib.stride_tricks.sliding_window_view(score, window)[:-1], hybrid_level(window, alpha), axis=1)
                day = np.arange(2 * window, length)
                rows.append((law, rep, float(q[day < shock[0]].mean()), float(q[(day >= shock[0]) & (day < shock[1])].mean()), float(q[day >= shock[1] + window].mean())))
            yield pd.DataFrame(rows, columns=["law", "rep", "before", "during", "after"])

    return grid.mapInPandas(run, "law string, rep long, before double, during double, after double")


def regime_summary(runs: DataFrame) -> DataFrame:
    """Means by law, and Student's t (equal variances) of before against after."""
    n = F.count("*").cast("double")
    pooled = (F.var_samp("before") + F.var_samp("after")) / 2
    return runs.groupBy("law").agg(F.count("*").alias("reps"), *[F.avg(c).alias(c) for c in ("before", "during", "after")], ((F.avg("before") - F.avg("after")) / F.sqrt(pooled * 2 / n)).alias("t_before_after"))
