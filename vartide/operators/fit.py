"""Operators that need an optimiser or resampling: grouped Arrow functions over one pair at a time.

A group is one model and asset (or one asset), as long as its history; many pairs run in parallel. Seeds
come from a hash of the pair, never from partitions, so results do not depend on the cluster.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import numeric
from vartide.operators import isotonic

PAIR = ("model", "asset")
#: Small tables with long fits are dealt over at least so many partitions.
TASKS = 64


def seed_of(*key: object) -> int:
    return zlib.crc32(":".join(map(str, key)).encode())


def bootstrap_ci(parts: DataFrame, alpha: float = 0.01, confidence: float = 0.95, draws: int = 999, mean_block: float = 20.0, seed: int = 2026) -> DataFrame:
    """model, asset, q_v and its stationary-bootstrap interval from calibration scores."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("pos")["score"].to_numpy()
        q = numeric.stationary_bootstrap(s, 1 - alpha, draws, mean_block, np.random.default_rng([seed, seed_of(*key)]))
        low, high = np.quantile(q, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame([(*key, float(np.quantile(s, 1 - alpha)), float(low), float(high), float(q.std(ddof=1)))], columns=["model", "asset", "q_v", "q_lo", "q_hi", "q_se"])

    return parts.filter("role = 'cal'").select(*PAIR, "pos", "score").groupBy(*PAIR).applyInPandas(run, "model string, asset string, q_v double, q_lo double, q_hi double, q_se double")


def _linear_quantile(q: np.ndarray, r: np.ndarray, alpha: float) -> tuple[float, float]:
    """Intercept and slope of the exact quantile regression; slope 0 where all forecasts are equal."""
    if not np.ptp(q):
        return float(numeric.quantile_regression(np.ones((len(q), 1)), r, alpha)[0][0]), 0.0
    (a, b), _ = numeric.quantile_regression(np.column_stack([np.ones(len(q)), q]), r, alpha)
    return float(a), float(b)


def isotonic_rows(parts: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Test rows with var_raw and var_corr: forecasts scaled by alpha over the violation rate that an isotonic fit over
    forecasts gives, linear between them; as they are where it is 0. Parts of any length (see `operators.isotonic`)."""
    cal = parts.filter("role = 'cal'").withColumn("_hit", F.coalesce(F.col("r") < F.col("q"), F.lit(False)).cast("double"))
    fitted = isotonic.knots(isotonic.fit(cal, "q", "_hit", PAIR), PAIR)
    test = parts.filter("role = 'test'").join(fitted, list(PAIR))
    p = isotonic.value(F.col("q"), F.col("xs"), F.col("ys"))
    scaled = test.withColumn("_p", p).withColumn("var_corr", -F.col("q") * F.when(F.col("_p") > 1e-6, alpha / F.col("_p")).otherwise(F.lit(1.0)))
    return scaled.select(*PAIR, "pos", "r", F.lit("isotonic").alias("method"), (-F.col("q")).alias("var_raw"), "var_corr")


def _evt_scale(q: np.ndarray, r: np.ndarray, alpha: float, decay: float = 0.94) -> float:
    """Mean volatility times the tail quantile of standardised losses, relative to the forecasts' mean size."""
    sigma, size = numeric.ewma_vol(r, decay), float(np.abs(q).mean())
    losses = -r / sigma
    losses = losses[np.isfinite(losses)]
    if size <= 1e-12 or losses.size < numeric.MIN_SAMPLE:
        return 1.0
    return float(sigma.mean()) * numeric.tail_quantile(losses, alpha) / size


def _skew_t(cal: np.ndarray, r: np.ndarray, test: np.ndarray, alpha: float) -> np.ndarray:
    """Quantiles of the skewed Student regression; of a normal one around the linear fit where it fails."""
    law = numeric.TwoPieceStudent(cal[:, 0], cal[:, 1:], r)
    if law.sound:
        return law.quantile(alpha, test[:, 0], test[:, 1:])
    from statistics import NormalDist

    slope, base = np.polyfit(cal[:, 0], r, 1)
    return base + slope * test[:, 0] + NormalDist().inv_cdf(alpha) * np.std(r - base - slope * cal[:, 0])


def _features(pdf: pd.DataFrame) -> np.ndarray:
    """Forecast and the deviations of the 5 and 20 returns before each day."""
    past = pd.Series(pdf.r.to_numpy())
    return np.column_stack([pdf.q, past.rolling(5, min_periods=2).std().shift().fillna(0), past.rolling(20, min_periods=2).std().shift().fillna(0)])


def recalibrate(parts: DataFrame, alpha: float = 0.01, methods: tuple[str, ...] = ("linear_qr", "isotonic", "evt_pot", "gbm_qr", "skew_t")) -> DataFrame:
    """Test rows by method with var_corr: quantile regression (pinball loss), isotonic coverage, peaks over
    threshold on standardised returns, boosted quantile trees and a skewed Student regression on forecast and
    lagged volatilities. Isotonic fits are merged over tasks, the others take a pair at a time."""
    grouped = tuple(m for m in methods if m != "isotonic")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cal, test = pdf[pdf.role == "cal"], pdf[pdf.role == "test"]
        q, r, tq = cal.q.to_numpy(), cal.r.to_numpy(), test.q.to_numpy()
        out = []
        for method in grouped:
            if method == "linear_qr":
                a, b = _linear_quantile(q, r, alpha)
                v = -(a + b * tq)
            elif method == "evt_pot":
                v = np.abs(tq) * _evt_scale(q, r, alpha)
            else:
                vol = _features(pdf)
                a, b = vol[(pdf.role == "cal").to_numpy()], vol[(pdf.role == "test").to_numpy()]
                v = -(numeric.BoostedQuantile(a, r, alpha)(b) if method == "gbm_qr" else _skew_t(a, r, b, alpha))
            out.append(test[["model", "asset", "pos", "r"]].assign(method=method, var_raw=-tq, var_corr=v))
        return pd.concat(out)[["model", "asset", "pos", "r", "method", "var_raw", "var_corr"]]

    schema = "model string, asset string, pos long, r double, method string, var_raw double, var_corr double"
    out = parts.select(*PAIR, "pos", "r", "q", "role").groupBy(*PAIR).applyInPandas(run, schema) if grouped else None
    if "isotonic" not in methods:
        return out
    rows = isotonic_rows(parts, alpha).withColumn("pos", F.col("pos").cast("long"))
    return rows if out is None else out.unionByName(rows)


#: Settings of the boosted regression that `boosted_grid` compares: trees, leaves (2^depth - 1), rate.
GRID = tuple((n, 2**d - 1, rate) for n in (100, 500) for d in (3, 5) for rate in (0.01, 0.05))


def boosted_grid(parts: DataFrame, alpha: float = 0.01, grid: tuple[tuple[int, int, float], ...] = GRID) -> DataFrame:
    """Test rows by pair and setting of the boosted regression, with var_corr and the trees kept; each pair and
    setting is a group of its own, so a grid spreads over tasks."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, cal, test = _features(pdf), (pdf.role == "cal").to_numpy(), (pdf.role == "test").to_numpy()
        trees, leaves, rate = grid[key[2]]
        model = numeric.BoostedQuantile(x[cal], pdf.r.to_numpy()[cal], alpha, trees, rate, leaves)
        out = pdf[test]
        return pd.DataFrame({"model": key[0], "asset": key[1], "pos": out.pos, "r": out.r, "trees": trees, "leaves": leaves, "rate": rate, "kept": len(model.trees), "var_raw": -out.q, "var_corr": -model(x[test])})

    rows = parts.select(*PAIR, "pos", "r", "q", "role", F.explode(F.array(*map(F.lit, range(len(grid))))).alias("_setting"))
    rows = rows.repartition(max(TASKS, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *PAIR, "_setting")
    return rows.groupBy(*PAIR, "_setting").applyInPandas(run, "model string, asset string, pos long, r double, trees int, leaves int, rate double, kept int, var_raw double, var_corr double")


def _daily(returns: DataFrame, window: int, span: int, forecasts: Callable[[np.ndarray], dict[str, float | None]]) -> DataFrame:
    """Paths of forecasts made for every day from its last `window` returns: `forecasts` gives a quantile for
    each model name, or None where a day has none.

    A group is an asset's `span` days with the `window` days before them, so one history spreads over tasks."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        r, own = pdf.r.to_numpy(), (pdf["_t"] >= key[1] * span).to_numpy()
        dates, places = pdf.date.to_numpy(), pdf.pos.to_numpy()
        rows = [(m, key[0], dates[t], places[t], r[t], q) for t in np.flatnonzero(own) for m, q in forecasts(r[max(0, t - window) : t]).items() if q is not None]
        return pd.DataFrame(rows, columns=["model", "asset", "date", "pos", "r", "q"])

    t = F.row_number().over(Window.partitionBy("asset").orderBy("pos")) - 1
    last = F.max("_t").over(Window.partitionBy("asset"))
    days = returns.select("asset", "date", "pos", "r").withColumn("_t", t).withColumn("_last", last)
    first, end = F.floor(F.col("_t") / span).cast("int"), F.floor(F.least(F.col("_t") + window, "_last") / span).cast("int")
    dealt = days.withColumn("_span", F.explode(F.sequence(first, end))).drop("_last")
    dealt = dealt.repartition(max(TASKS, int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "asset", "_span")
    return dealt.groupBy("asset", "_span").applyInPandas(run, "model string, asset string, date date, pos long, r double, q double")


def gjr_garch(returns: DataFrame, alpha: float = 0.01, window: int = 250, span: int = 32, innovations: str = "normal", leverage: bool = True) -> DataFrame:
    """GARCH forecasts refitted every day on the last `window` returns; the normal law of the window where it has
    fewer than 50 or no fit is found. Innovations: `normal`, or `skewed_t` (Hansen's law, which
    always has leverage), whose quantile is that of the non-central t that stands for it in `parametric`, or
    `hansen` for the fitted law's own quantile. Without `leverage` the normal model is the plain one."""
    from statistics import NormalDist

    if innovations not in ("normal", "skewed_t", "hansen") or (innovations != "normal" and not leverage):
        raise ValueError(f"unknown model: innovations {innovations!r}, leverage {leverage}")
    z = NormalDist().inv_cdf(alpha)
    name = {"normal": "gjr_garch" if leverage else "garch", "skewed_t": "gjr_skewed_t", "hansen": "gjr_hansen"}[innovations]

    def one(past: np.ndarray) -> dict[str, float | None]:
        past = past * 100
        if len(past) < 50:
            return {name: float(past.mean() + z * past.std()) / 100 if len(past) > 1 else 0.0}
        own = z
        if innovations == "normal":
            model = numeric.gjr_fit(past, leverage)
        else:
            *model, df, skew = numeric.skewed_gjr_fit(past)
            own = (numeric.nct_ppf if innovations == "skewed_t" else numeric.hansen_ppf)(alpha, df, skew)
        q = model[0] + own * math.sqrt(numeric.gjr_filter(past, *model)[-1])
        return {name: float(q if math.isfinite(q) else past.mean() + z * past.std()) / 100}

    return _daily(returns, window, span, one)


#: Fixed values of the daily tail forecasts: the peaks' quantile and the largest Value-at-Risk taken.
PEAKS_FROM, VAR_CAP = 0.95, 1.0


def tail_forecasts(returns: DataFrame, alpha: float = 0.01, window: int = 250, span: int = 32, cap: float | None = VAR_CAP) -> DataFrame:
    """Paths of `fhs` (filtered historical simulation) and `evt_pot` (a generalised Pareto law over the peaks of
    standardised losses) for every day with a full window.

    Returns are standardised by a plain zero-mean GARCH fitted to the window; where that has no finite forecast,
    the whole window by one exponentially weighted volatility. evt_pot takes fhs's forecast where peaks are
    few, the law is unsound, or the result is not within (0, cap]; None sets no cap, for returns that are
    not fractions. A window of zeros has no forecast."""

    def one(past: np.ndarray) -> dict[str, float | None]:
        if len(past) < max(window, numeric.MIN_SAMPLE) or not past.any():
            return {}
        model = numeric.gjr_fit(past * 100, leverage=False, mean=False)
        sigma = np.sqrt(numeric.gjr_filter(past * 100, *model)) / 100
        ahead, z = float(sigma[-1]), past / np.maximum(sigma[:-1], 1e-300)
        if not (math.isfinite(ahead) and ahead > 0 and np.isfinite(z).all()):
            weights = 0.94 ** np.arange(len(past) - 1, -1, -1.0)
            ahead = float(np.sqrt(np.sum(weights * past**2) / weights.sum()))
            if ahead <= 0:
                return {}
            z = past / ahead
        fhs = ahead * float(np.quantile(z, alpha))
        peaks = -ahead * numeric.tail_quantile(-z, alpha, PEAKS_FROM)
        sound = -peaks > 0 and (cap is None or -peaks <= cap)
        return {"fhs": fhs, "evt_pot": peaks if sound else fhs}

    return _daily(returns, window, span, one)


def parametric(laws: DataFrame, alpha: float = 0.01) -> DataFrame:
    """laws (id, family, df, skew, location, scale, at) with quantile, shortfall and the distribution function
    at `at`. Families: normal, student_t (needs df), skewed_t (needs df and skew: a non-central t).
    Laws without their parameters, of other families or without a shortfall (df up to 1) give nulls there."""
    from statistics import NormalDist

    unit = NormalDist()
    z = unit.inv_cdf(alpha)

    def standard(family: str | None, df: float, skew: float, x: float) -> tuple[float, float, float]:
        """Quantile, shortfall and distribution function at x of the law with location 0 and scale 1."""
        tailed = df > 1
        if family == "normal":
            return z, -unit.pdf(z) / alpha, unit.cdf(x)
        if family == "student_t" and df > 0:
            return numeric.t_ppf(alpha, df), numeric.t_shortfall(alpha, df) if tailed else np.nan, numeric.t_cdf(x, df)
        if family == "skewed_t" and df > 0 and skew == skew:
            return numeric.nct_ppf(alpha, df, skew), numeric.nct_shortfall(alpha, df, skew) if tailed else np.nan, numeric.nct_cdf(x, df, skew)
        return np.nan, np.nan, np.nan

    def run(batches):
        for pdf in batches:
            figures = pdf[["df", "skew", "location", "scale", "at"]].astype(float)
            rows = []
            for i, family, (df, skew, mu, sigma, x) in zip(pdf["id"], pdf["family"], figures.to_numpy(), strict=True):
                q, es, below = standard(family, df, skew, (x - mu) / sigma) if sigma > 0 else (np.nan,) * 3
                rows.append([i, family, *(None if v != v else float(v) for v in (mu + sigma * q, mu + sigma * es, below))])
            yield pd.DataFrame(rows, columns=["id", "family", "quantile", "shortfall", "below"]).astype({k: float for k in ("quantile", "shortfall", "below")})

    return laws.select("id", "family", "df", "skew", "location", "scale", "at").mapInPandas(run, "id string, family string, quantile double, shortfall double, below double")


def complete_tail(grids: DataFrame, alpha: float = 0.01) -> DataFrame:
    """id, df, location, scale, quantile and shortfall at alpha of the Student t fitted to each quantile grid
    (id, levels, quantiles)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, levels, quantiles in zip(pdf["id"], pdf["levels"], pdf["quantiles"], strict=True):
                df, mu, sigma = numeric.fit_t_to_grid(np.asarray(levels), np.asarray(quantiles))
                rows.append((i, df, mu, sigma, mu + sigma * numeric.t_ppf(alpha, df), numeric.t_shortfall(alpha, df, mu, sigma)))
            yield pd.DataFrame(rows, columns=["id", "df", "location", "scale", "quantile", "shortfall"])

    return grids.mapInPandas(run, "id string, df double, location double, scale double, quantile double, shortfall double")


def rolling_ks(paths: DataFrame, window: int = 250) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of the halves of each trailing window of scores, with the
    exact p-value (equal scores count together)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        s = (pdf.q - pdf.r).to_numpy()
        if len(s) <= window:
            return pd.DataFrame(columns=["model", "asset", "pos", "ks", "p_value"])
        w = np.lib.stride_tricks.sliding_window_view(s, window)[: len(s) - window]
        half = window // 2
        order = np.argsort(w, axis=1, kind="stable")
        first = (order < half) / half - (order >= half) / (window - half)
        ordered = np.take_along_axis(w, order, axis=1)
        last = np.append(ordered[:, 1:] > ordered[:, :-1], np.ones((len(w), 1), bool), axis=1)  # of equal scores
        d = np.where(last, np.abs(np.cumsum(first, axis=1)), 0).max(axis=1)
        reach, which = np.unique(np.rint(d * half * (window - half)).astype(np.int64), return_inverse=True)
        p = numeric.ks_exact(reach, half, window - half)[which]
        return pd.DataFrame({"model": key[0], "asset": key[1], "pos": pdf.pos.to_numpy()[window:], "ks": d, "p_value": p})

    return paths.select(*PAIR, "pos", "q", "r").groupBy(*PAIR).applyInPandas(run, "model string, asset string, pos long, ks double, p_value double")
