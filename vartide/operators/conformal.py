"""Conformal recalibration of quantile paths.

A path has model, asset, date, pos, r and q (negative for losses). Scores are q - r. The calibration part
is the first `split` of an asset's rows; corrections are fitted there and applied to the rest. All pairs of
model and asset go through one plan: windows by (model, asset), partial aggregates, joins of short tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats
from vartide.operators import ranks, sliding

PAIR = ("model", "asset")


def align(returns: DataFrame, forecasts: DataFrame, keys: tuple[str, ...] = ("asset", "date")) -> DataFrame:
    """Inner join of returns and forecasts on date, positions counted anew."""
    joined = returns.drop("pos").join(forecasts.select("model", *keys, "q"), list(keys))
    return joined.withColumn("pos", F.row_number().over(Window.partitionBy(*PAIR).orderBy("date")) - 1)


def split_paths(paths: DataFrame, split: float | Column = 0.7, warmup: int = 0, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Add score, n, n_cal, is_cal; rows before min(warmup, n_cal / 4) leave the calibration part (role 'skip')."""
    w = Window.partitionBy(*keys)
    out = paths.withColumns({"n": F.count("*").over(w), "score": F.col("q") - F.col("r")})
    out = out.withColumn("n_cal", F.floor(F.col("n").cast("double") * stats.level(split)).cast("int"))
    skip = F.least(F.lit(warmup), F.floor(F.col("n_cal") / 4).cast("int"))
    return out.withColumn("role", F.when(F.col("pos") >= F.col("n_cal"), "test").when(F.col("pos") < skip, "skip").otherwise("cal"))


def fit_static(parts: DataFrame, alpha: float | Column = 0.01, method: str = "linear", keys: tuple[str, ...] = PAIR) -> DataFrame:
    """model, asset, q_v from calibration scores: `linear` (type-7 quantile), `order` (order statistic of
    rank ceil((n+1)(1-alpha))) or `hybrid` (type-7 at that rank's level). alpha may be one of the keys. `selected` gives
    the linear one by passes over brackets, for calibration parts that no task can hold."""
    if method == "selected":
        return ranks.quantiles(parts.filter("role = 'cal'"), "score", 1.0 - alpha, keys).withColumnRenamed("quantile", "q_v")
    cal = parts.filter("role = 'cal'").groupBy(*keys)
    if method == "linear" and not isinstance(alpha, Column):
        return cal.agg(F.percentile("score", F.lit(1.0 - alpha)).alias("q_v"))
    s = cal.agg(F.array_sort(F.collect_list("score")).alias("s"))
    n, rank = F.size("s"), stats.order_rank(F.size("s"), stats.level(alpha))
    if method == "linear":
        return s.select(*keys, stats.lerp_sorted(F.col("s"), 1.0 - stats.level(alpha)).alias("q_v"))
    if method == "order":
        return s.select(*keys, F.element_at("s", rank).alias("q_v"))
    return s.select(*keys, stats.lerp_sorted(F.col("s"), rank.cast("double") / n.cast("double")).alias("q_v"))


def apply_shift(parts: DataFrame, params: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Test rows with var_raw, var_corr, their violations and pinball losses' arguments; params is short."""
    test = parts.filter("role = 'test'").join(params, list(keys))
    return corrected(test.withColumns({"var_raw": -F.col("q"), "var_corr": -F.col("q") + F.col("q_v")}))


def corrected(test: DataFrame) -> DataFrame:
    hit = lambda v: F.coalesce(F.col("r") < -F.col(v), F.lit(False)).cast("int")
    return test.withColumns({"viol_raw": hit("var_raw"), "viol_corr": hit("var_corr")})


def carry_shortfall(test: DataFrame) -> DataFrame:
    """Corrected test rows with es (negative, as q is) and es_corr, positive: the shortfall moves by as much as the
    Value-at-Risk does."""
    return test.withColumn("es_corr", -F.col("es") + (F.col("var_corr") - F.col("var_raw")))


def shortfall_measures(alpha: float | Column) -> tuple[Column, ...]:
    """Aggregates z2_raw, z2_corr, fz_raw and fz_corr of `carry_shortfall` rows: excess over the shortfall on violation days
    relative to its mean size (0 without any), and the mean joint loss."""
    out, r = [], F.col("r")
    for s, v, e in (("raw", F.col("q"), F.col("es")), ("corr", -F.col("var_corr"), -F.col("es_corr"))):
        hit = F.col(f"viol_{s}") == 1
        out.append(F.coalesce(F.try_divide(F.sum(F.when(hit, r + F.abs(e))), F.sum(hit.cast("int")) * (F.avg(F.abs(e)) + 1e-12)), stats.d(0)).alias(f"z2_{s}"))
        out.append(F.avg(stats.fz0(r, v, e, stats.level(alpha))).alias(f"fz_{s}"))
    return tuple(out)


def mixing_gap(parts: DataFrame, keys: tuple[str, ...] = PAIR, least: float = 0.01, most: float = 0.99) -> DataFrame:
    """keys, rho and gap: ceil(ln n / |ln |rho||) days between calibration and test, by which scores whose lag-one
    correlation is rho are close to independent. |rho| is held between `least` and `most`, so the gap is finite;
    a series without a correlation (constant, or under three rows) takes `least`."""
    cal = parts.filter("role = 'cal'").withColumn("_before", F.lag("score").over(Window.partitionBy(*keys).orderBy("pos")))
    both = F.when(F.col("_before").isNotNull(), F.col("score"))
    spread = F.stddev_pop(both) * F.stddev_pop("_before")
    g = cal.groupBy(*keys).agg(F.max("n").alias("n"), F.try_divide(F.covar_pop(both, F.col("_before")), spread).alias("rho"))
    rho = F.coalesce(F.nanvl("rho", stats.d(0)), stats.d(0))
    size = F.greatest(stats.d(least), F.least(stats.d(most), F.abs(rho)))
    return g.select(*keys, rho.alias("rho"), F.ceil(F.ln(F.col("n").cast("double")) / F.abs(F.ln(size))).cast("int").alias("gap"))


def transitions(df: DataFrame, column: str, keys: tuple[str, ...] = PAIR) -> DataFrame:
    return df.withColumn(f"prev_{column}", F.lag(column).over(Window.partitionBy(*keys).orderBy("pos")))


def regime(q_v: Column, mean_var: Column, limit: float = 1.0) -> tuple[Column, Column]:
    """(replacement ratio, regime); an infinite ratio where the forecast has no size."""
    ratio = F.when(mean_var < 1e-12, F.lit(float("inf"))).otherwise(F.abs(q_v) / F.when(mean_var >= 1e-12, mean_var))
    return ratio, F.when(ratio > limit, "replacement").otherwise("signal-preserving")


def backtest(test: DataFrame, alpha: float | Column, keys: tuple[str, ...] = PAIR, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per pair: counts, rates, coverage tests, zones and scores before and after correction; `more`
    are further aggregates of the same rows."""
    marked = transitions(transitions(test, "viol_raw", keys), "viol_corr", keys)
    last = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    marked = marked.withColumn("_age", F.row_number().over(last))
    a, aggs = stats.level(alpha), [F.count("*").alias("n_test"), F.first("q_v").alias("q_v"), F.avg(F.abs("var_raw")).alias("width_raw"), F.avg(F.abs("var_corr")).alias("width_corr")]
    for s in ("raw", "corr"):
        v, p = F.col(f"viol_{s}"), F.col(f"prev_viol_{s}")
        aggs += [F.sum(v).alias(f"viol_{s}"), F.sum(F.when(F.col("_age") <= 250, v)).alias(f"last_{s}"), F.avg(stats.pinball(F.col("r"), -F.col(f"var_{s}"), a)).alias(f"qs_{s}")]
        aggs += [F.sum(((p == i) & (v == j)).cast("int")).alias(f"n{i}{j}_{s}") for i in (0, 1) for j in (0, 1)]
    out = marked.groupBy(*keys).agg(*aggs, *more)
    n = F.col("n_test")
    for s in ("raw", "corr"):
        x = F.col(f"viol_{s}")
        cells = [F.coalesce(F.col(f"n{i}{j}_{s}"), F.lit(0)) for i in (0, 1) for j in (0, 1)]
        lr = stats.kupiec_lr(x, n, a)
        out = out.withColumns({
            f"pi_{s}": x / n,
            f"kupiec_lr_{s}": lr,
            f"kupiec_p_{s}": stats.kupiec_p(x, n, a),
            f"lr_ind_{s}": stats.transition_lr(*cells),
            f"ind_p_report_{s}": stats.transition_p_report(*cells),
            f"zone_{s}": stats.basel_zone(F.col(f"last_{s}"), F.least(n, F.lit(250))),
            f"zone_report_{s}": stats.basel_zone_report(x, n),
        }).withColumns({f"ind_p_{s}": stats.chi2_sf1(F.col(f"lr_ind_{s}")), f"cc_p_{s}": stats.chi2_sf2(lr + F.col(f"lr_ind_{s}"))})
    ratio, kind = regime(F.col("q_v"), F.col("width_raw"))
    return out.withColumns({"ratio": ratio, "regime": kind})


def static_audit(paths: DataFrame, alpha: float | Column = 0.01, split: float | Column = 0.7, warmup: int = 0, method: str = "linear", keys: tuple[str, ...] = PAIR) -> DataFrame:
    """The static audit of every pair: correction fitted on the first part, everything measured on the rest.
    Further keys (a column alpha, say) put several audits of a pair into one plan. A linear correction at one
    level is a window over the same partitioning; the others join their short table of parameters."""
    parts = split_paths(paths, split, warmup, keys)
    if method == "linear" and not isinstance(alpha, Column):
        q_v = F.percentile(F.when(F.col("role") == "cal", F.col("score")), F.lit(1.0 - alpha)).over(Window.partitionBy(*keys))
        test = parts.withColumn("q_v", q_v).filter("role = 'test' and q_v is not null")
        return backtest(corrected(test.withColumns({"var_raw": -F.col("q"), "var_corr": -F.col("q") + F.col("q_v")})), alpha, keys)
    return backtest(apply_shift(parts, fit_static(parts, alpha, method, keys), keys), alpha, keys)


def rolling_qv(paths: DataFrame, alpha: float = 0.01, window: int = 250, method: str = "linear") -> DataFrame:
    """Rows from position `window` on with q_v over the preceding `window` scores."""
    scored = paths.withColumn("score", F.col("q") - F.col("r"))
    rank = min(math.ceil((window + 1) * (1 - alpha)), window)
    wanted = {"ranks": (rank,)} if method == "order" else {"quantiles": (1.0 - alpha if method == "linear" else rank / window,)}
    slid = sliding.sliding(scored, "score", window, keys=PAIR, name="_q", **wanted)
    return slid.withColumn("q_v", F.get("_q", F.lit(0))).drop("_q").filter(F.col("pos") >= window)


def drift(paths: DataFrame, window: int = 250, bins: int | None = None) -> DataFrame:
    """Total-variation distance between the halves of each trailing window, on shared equal-width bins."""
    b = bins or max(int(window**0.5), 5)
    half = window // 2
    w = Window.partitionBy(*PAIR).orderBy("pos").rowsBetween(-window, -1)
    rows = paths.withColumn("s", F.collect_list(F.col("q") - F.col("r")).over(w)).filter(F.col("pos") >= window)
    rows = rows.withColumns({"lo": F.array_min("s"), "hi": F.array_max("s")})
    # last bin closed on the right; a flat window falls into one bin
    place = lambda x: F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * b), F.lit(b - 1))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumns({"first": F.transform(F.slice("s", 1, half), place), "second": F.transform(F.slice("s", half + 1, window - half), place)})
    share = lambda name, k: F.size(F.filter(name, lambda x: x == k)) / F.size(name)
    gaps = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda k: F.abs(share("first", k) - share("second", k)))
    return rows.select(*PAIR, "date", "pos", (0.5 * F.aggregate(gaps, stats.d(0), lambda a, x: a + x)).alias("tv"))


def longest_run(df: DataFrame, flag: Column, order: str = "pos", keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys and max_run: the longest stretch of rows where flag holds (null ends a stretch)."""
    f = F.coalesce(flag, F.lit(False))
    rows = df.select(*keys, order, f.alias("_f"))
    island = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - F.row_number().over(Window.partitionBy(*keys, "_f").orderBy(order))
    runs = rows.withColumn("_i", island).groupBy(*keys, "_f", "_i").agg(F.count("*").alias("run"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("run"))), F.lit(0)).cast("long").alias("max_run"))


def rolling_audit(paths: DataFrame, alpha: float = 0.01, window: int = 250, warmup: int = 250, persistence: int = 20) -> DataFrame:
    """The rolling audit of every pair: each day corrected by the scores of the `window` days before it."""
    kept = paths.filter(F.col("pos") >= warmup).withColumn("pos", F.col("pos") - warmup)
    rolled = rolling_qv(kept, alpha, window)
    test = corrected(rolled.withColumns({"var_raw": -F.col("q"), "var_corr": -F.col("q") + F.col("q_v"), "r_t": F.abs("q_v") / (F.abs("q") + 1e-12)}))
    flag = F.coalesce(F.col("r_t") > 1.0, F.lit(False))
    island = F.row_number().over(Window.partitionBy(*PAIR).orderBy("pos")) - F.row_number().over(Window.partitionBy(*PAIR, "_f").orderBy("pos"))
    test = test.withColumn("_f", flag).withColumn("_i", island)
    test = test.withColumn("_run", F.when(F.col("_f"), F.count("*").over(Window.partitionBy(*PAIR, "_f", "_i"))).otherwise(0))
    more = (F.avg("q_v").alias("q_v_mean"), F.stddev_pop("q_v").alias("q_v_std"), F.avg("r_t").alias("r_mean"), F.max("_run").alias("max_run"))
    out = backtest(test, alpha, more=more).drop("q_v", "ratio", "regime")
    return out.withColumn("regime", F.when(F.col("max_run") >= persistence, "replacement").otherwise("signal-preserving"))


def weighted_qv(parts: DataFrame, alpha: float = 0.01, decay: float = 0.002) -> DataFrame:
    """model, asset, q_v, ess: the weighted conformal quantile, weights exp(-decay * age) and one unit for the
    next score; the largest score where the weights never suffice."""
    cal = parts.filter("role = 'cal'").withColumn("w", F.exp(-decay * (F.col("n_cal") - 1 - F.col("pos"))))
    upto = Window.partitionBy(*PAIR).orderBy("score", "pos").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*PAIR)
    share = F.sum("w").over(upto) / (F.sum("w").over(every) + 1.0)
    marked = cal.withColumn("share", share)
    first = F.min(F.when(F.col("share") >= 1.0 - alpha, F.col("score")))
    return marked.groupBy(*PAIR).agg(F.coalesce(first, F.max("score")).alias("q_v"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def coverage_bound(n_cal: Column, alpha: float = 0.01) -> Column:
    """Guaranteed coverage in percent: 1 - alpha - 2.5 sqrt(ln n / n)."""
    n = n_cal.cast("double")
    return (1.0 - alpha - 2.5 * F.sqrt(F.ln(n) / n)) * 100.0


def rolling_bound(tv: Column, window: int = 250, alpha: float = 0.01) -> Column:
    """Coverage guaranteed under drift: 1 - alpha - tv - sqrt(ln w / w)."""
    return (1.0 - alpha - (math.log(window) / window) ** 0.5) - tv


def at_least(parts: DataFrame, n_cal: int, n_test: int) -> DataFrame:
    """The pairs that have so many days to fit on and to test."""
    return parts.filter((F.col("n_cal") >= n_cal) & (F.col("n") - F.col("n_cal") >= n_test))


def var_es_correction(parts: DataFrame, alpha: float = 0.01, es_level: float = 0.025) -> DataFrame:
    """Test rows (with es, negative) with q_v and var_corr, and with n_viol, q_e and es_corr: the correction of
    expected shortfall is a hybrid quantile of r - es over the violation days of the calibration part, 0 without any."""
    hits = parts.filter("role = 'cal' and r < q").groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.col("r") - F.col("es"))).alias("s"))
    n = F.size("s")
    q_e = stats.lerp_sorted(F.col("s"), stats.order_rank(n, stats.d(es_level)).cast("double") / n.cast("double"))
    shortfall = hits.select(*PAIR, n.alias("n_viol"), q_e.alias("q_e"))
    test = apply_shift(parts, fit_static(parts, alpha, "hybrid")).join(shortfall, list(PAIR), "left").fillna(0, ["n_viol", "q_e"])
    return test.withColumn("es_corr", F.col("q_e") - F.col("es"))
