"""Evidence pooled over a panel: coverage, loss comparisons, regressions, characteristics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.functions import stats


def pooled_kupiec(facts: DataFrame, alpha: float = 0.01, keys: tuple[str, ...] = ("model",), violations: str = "viol_corr") -> DataFrame:
    """Coverage of all assets of a key together, with the spread of the assets' own rates (cluster z)."""
    x, n = F.sum(violations), F.sum("n_test")
    g = facts.withColumn("_pi", F.col(violations) / F.col("n_test")).groupBy(*keys).agg(F.count("*").alias("n_assets"), x.alias("x"), n.alias("n"), F.var_samp("_pi").alias("_v"))
    pi = F.col("x") / F.col("n")
    se = F.sqrt(F.col("_v") / F.col("n_assets"))
    lr = F.when((F.col("x") == 0) | (F.col("x") == F.col("n")), stats.d(0)).otherwise(F.greatest(stats.d(0), stats.kupiec_lr(F.col("x"), F.col("n"), stats.d(alpha))))
    g = g.withColumns({"pi": pi, "kupiec_lr": lr, "se_cluster": se})
    return g.withColumns({"kupiec_p": stats.chi2_sf1(F.col("kupiec_lr")), "z_cluster": F.try_divide(F.col("pi") - alpha, F.col("se_cluster"))}).drop("_v")


def loss_pairs(losses: DataFrame, keys: tuple[str, ...] = ("asset", "pos")) -> DataFrame:
    """model_a < model_b, keys, loss_a, loss_b and their diff at the same keys (inner; rows are aligned by keys).

    The models of one key are few, so their losses meet in one array and no table is read twice."""
    met = losses.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("model", "loss"))).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("xs", lambda y: x["model"] < y["model"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    rows = met.select(*keys, F.explode(pairs).alias("p"))
    return rows.select(F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b"), *keys, F.col("p.a.loss").alias("loss_a"), F.col("p.b.loss").alias("loss_b"), (F.col("p.a.loss") - F.col("p.b.loss")).alias("diff"))


def diebold_mariano(pairs: DataFrame, keys: tuple[str, ...] = ("model_a", "model_b", "asset"), hln: bool = True) -> DataFrame:
    """One-step Diebold-Mariano test of each pair: population variance, small-sample factor, normal p."""
    g = pairs.groupBy(*keys).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), F.var_pop("diff").alias("_v"))
    factor = F.sqrt((F.col("n") - 1) / F.col("n")) if hln else stats.d(1)
    t = F.col("mean_diff") / F.sqrt(F.greatest(F.col("_v"), stats.d(1e-20)) / F.col("n")) * factor
    g = g.withColumn("dm", F.when(F.col("n") >= 2, t).otherwise(stats.d(0)))
    return g.withColumn("p_value", F.when(F.col("n") >= 2, stats.two_sided_p(F.col("dm"))).otherwise(stats.d(1))).drop("_v")


def diebold_mariano_ahead(pairs: DataFrame, horizon: int, keys: tuple[str, ...] = ("model_a", "model_b", "asset"), order: str = "pos", hln: bool = True) -> DataFrame:
    """The test for forecasts `horizon` days ahead: Bartlett weights up to horizon - 1 lags, each autocovariance a
    mean over the rows that have that lag; the small-sample factor follows the horizon. One sorted partitioning
    serves every lag."""
    every = Window.partitionBy(*keys)
    centred = pairs.withColumn("_e", F.col("diff") - F.avg("diff").over(every))
    products = [F.avg(F.col("_e") * F.col(f"_e{k}")).alias(f"_g{k}") for k in range(1, horizon)]
    lagged = centred.withColumns({f"_e{k}": F.lag("_e", k).over(every.orderBy(order)) for k in range(1, horizon)}) if horizon > 1 else centred
    g = lagged.groupBy(*keys).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), F.avg(F.col("_e") * F.col("_e")).alias("_g0"), *products)
    n = F.col("n").cast("double")
    spread = sum((2.0 * (1 - k / horizon) * F.coalesce(F.col(f"_g{k}"), stats.d(0)) for k in range(1, horizon)), F.col("_g0"))
    factor = F.sqrt(F.greatest(n + 1 - 2 * horizon + horizon * (horizon - 1) / n, stats.d(0)) / n) if hln else stats.d(1)
    t = F.col("mean_diff") / F.sqrt(F.greatest(spread, stats.d(1e-20)) / n) * factor
    g = g.withColumn("dm", F.when(n >= 2, t).otherwise(stats.d(0)))
    return g.select(*keys, "n", "mean_diff", "dm", F.when(n >= 2, stats.two_sided_p(F.col("dm"))).otherwise(stats.d(1)).alias("p_value"))


def tail_aligned(pairs: DataFrame, keys: tuple[str, ...] = ("model_a", "model_b")) -> DataFrame:
    """keys, rpos and the cross-sectional sum of differences over the last days that all assets have."""
    w = Window.partitionBy(*keys, "asset").orderBy(F.col("pos").desc())
    ranked = pairs.withColumn("rpos", F.row_number().over(w))
    shortest = ranked.groupBy(*keys, "asset").agg(F.max("rpos").alias("n")).groupBy(*keys).agg(F.min("n").alias("n_min"))
    return ranked.join(shortest, list(keys)).filter("rpos <= n_min").groupBy(*keys, "rpos").agg(F.sum("diff").alias("s"))


def hac_dm(sums: DataFrame, keys: tuple[str, ...] = ("model_a", "model_b"), bandwidth: str = "andrews") -> DataFrame:
    """Driscoll-Kraay comparison: the mean of cross-sectional sums over a Bartlett long-run variance.

    The bandwidth follows Andrews' AR(1) rule or floor(4 (T/100)^(2/9)) (`rule`). Autocovariances come from the
    series as one array for each pair, in time order."""
    s = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rpos")).alias("o"), "s"))), lambda x: x["s"]).alias("s"))
    n = F.size("s").cast("double")
    add = lambda a, x: a + x
    s = s.withColumn("mean_diff", F.aggregate("s", stats.d(0), add) / n)
    s = s.withColumn("e", F.transform("s", lambda x: x - F.col("mean_diff")))
    lagged = lambda k: F.aggregate(F.zip_with(F.slice("e", k + 1, F.greatest(F.size("e") - k, F.lit(0))), F.slice("e", F.lit(1), F.greatest(F.size("e") - k, F.lit(0))), lambda a, b: a * b), stats.d(0), add)
    # correlation of the series with itself one day before
    late, early = F.slice("s", F.lit(2), F.size("s")), F.slice("s", F.lit(1), F.size("s") - 1)
    mean = lambda xs: F.aggregate(xs, stats.d(0), add) / F.size(xs)
    s = s.withColumns({"_late": F.transform(late, lambda x: x), "_early": early}).withColumns({"_ml": mean(F.col("_late")), "_me": mean(F.col("_early"))})
    s = s.withColumns({"_late": F.transform("_late", lambda x: x - F.col("_ml")), "_early": F.transform("_early", lambda x: x - F.col("_me"))})
    dot = lambda xs, ys: F.aggregate(F.zip_with(xs, ys, lambda x, y: x * y), stats.d(0), add)
    s = s.withColumn("_rho", F.try_divide(dot("_late", "_early"), F.sqrt(dot("_late", "_late") * dot("_early", "_early"))))
    s = s.withColumn("g0", lagged(F.lit(0)) / n)
    rho = F.greatest(stats.d(-0.99), F.least(stats.d(0.99), F.coalesce(F.nanvl("_rho", stats.d(0)), stats.d(0))))
    a = 4 * rho * rho / F.pow((1 - rho) * (1 + rho), F.lit(2.0))
    andrews = F.ceil(1.1447 * F.pow(a * n, F.lit(1 / 3)))
    rule = F.floor(4.0 * F.pow(n / 100.0, F.lit(2 / 9)))
    s = s.withColumn("lags", F.least(andrews if bandwidth == "andrews" else rule, F.size("s") - 1).cast("int"))
    terms = F.when(F.col("lags") >= 1, F.transform(F.sequence(F.lit(1), F.col("lags")), lambda k: 2.0 * (1.0 - k / (F.col("lags") + 1.0)) * lagged(k) / n)).otherwise(F.array().cast("array<double>"))
    s = s.withColumn("long_run", F.greatest(F.col("g0") + F.aggregate(terms, stats.d(0), add), stats.d(1e-20)))
    s = s.withColumn("dm", F.col("mean_diff") / F.sqrt(F.col("long_run") / n) * F.sqrt((n - 1) / n))
    return s.select(*keys, F.size("s").cast("long").alias("n"), "mean_diff", "lags", "long_run", "dm", stats.two_sided_p(F.col("dm")).alias("p_value"))


def regress(rows: DataFrame, y: str, x1: str, x2: str, cluster: str) -> DataFrame:
    """One row: OLS of y on 1, x1, x2 with classical and cluster-robust standard errors, R2 and the partial R2
    of x1 given x2. Sums of products per cluster are one aggregation; all else is arithmetic on one short row
    for each cluster, as a cluster's score is X'y - X'X b of its own sums."""
    xs = ("x0", "x1", "x2")
    data = rows.select(F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), F.col(x1).cast("double").alias("x1"), F.col(x2).cast("double").alias("x2"), F.col(cluster).alias("c")).dropna()
    products = {f"{a}{b}": F.col(a) * F.col(b) for i, a in enumerate(xs) for b in xs[i:]} | {f"{a}y": F.col(a) * F.col("y") for a in xs} | {"yy": F.col("y") * F.col("y")}
    per = data.groupBy("c").agg(*[F.sum(v).alias(k) for k, v in products.items()])
    every = Window.partitionBy(F.lit(1))  # clusters, not rows
    per = per.withColumns({f"t_{k}": F.sum(k).over(every) for k in products})
    m = lambda i, j: F.col(f"t_x{min(i, j)}x{max(i, j)}")
    det = sum((m(0, i) * (m(1, (i + 1) % 3) * m(2, (i + 2) % 3) - m(1, (i + 2) % 3) * m(2, (i + 1) % 3)) for i in range(3)), stats.d(0))
    per = per.withColumn("det", det)
    per = per.withColumns({f"i{i}{j}": (m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)) / F.col("det") for i in range(3) for j in range(3)})
    per = per.withColumns({f"b{i}": sum((F.col(f"i{i}{j}") * F.col(f"t_x{j}y") for j in range(3)), stats.d(0)) for i in range(3)})
    own = lambda i, j: F.col(f"x{min(i, j)}x{max(i, j)}")
    per = per.withColumns({f"s{i}": F.col(f"x{i}y") - sum((own(i, j) * F.col(f"b{j}") for j in range(3)), stats.d(0)) for i in range(3)})
    same = [*(f"t_{k}" for k in products), *(f"i{i}{j}" for i in range(3) for j in range(3)), *(f"b{i}" for i in range(3))]
    out = per.agg(*[F.first(k).alias(k) for k in same], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}{j}") for i in range(3) for j in range(3)], F.count("*").alias("clusters"))
    n, g = F.col("t_x0x0"), F.col("clusters").cast("double")
    rss = F.col("t_yy") - sum((F.col(f"b{i}") * F.col(f"t_x{i}y") for i in range(3)), stats.d(0))
    var = lambda k: g / (g - 1) * (n - 1) / (n - 3) * sum((F.col(f"i{k}{i}") * F.col(f"m{i}{j}") * F.col(f"i{j}{k}") for i in range(3) for j in range(3)), stats.d(0))
    tss = F.col("t_yy") - F.col("t_x0y") * F.col("t_x0y") / n
    t1 = F.col("b1") / F.sqrt(rss / (n - 3) * F.col("i11"))
    return out.select(
        n.cast("long").alias("n_obs"), *[F.col(f"b{i}").alias(f"beta{i}") for i in range(3)], *[F.sqrt(rss / (n - 3) * F.col(f"i{i}{i}")).alias(f"se{i}") for i in range(3)],
        *[F.sqrt(var(i)).alias(f"se_cluster{i}") for i in range(3)], (1 - rss / tss).alias("r2"), (t1 * t1 / (t1 * t1 + n - 3)).alias("partial_r2"),
    )


def wide_rates(facts: DataFrame, names: dict[str, str], violations: str = "viol_corr") -> DataFrame:
    """model and one column for each asset in `names` (asset: suffix), pi_<suffix>: that asset's own rate."""
    pi = F.col(violations) / F.col("n_test")
    return facts.groupBy("model").agg(*[F.max(F.when(F.col("asset") == asset, pi)).alias(f"pi_{suffix}") for asset, suffix in names.items()])


def wild_cluster_kupiec(facts: DataFrame, draws: int = 999, alpha: float = 0.01, seed: int = 42, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Rademacher bootstrap of pooled coverage over assets: an asset's violations enter a draw where its sign
    is +1. Signs come from a hash of (seed, draw, asset), so any engine and any partitioning draw alike."""
    per = facts.select(*keys, "asset", F.col("viol_corr").alias("x"), F.col("n_test").alias("n"))
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "asset")), 1, 1) < "8"
    star = drawn.groupBy(*keys, "draw").agg(F.sum(F.when(sign, F.col("x")).otherwise(0)).alias("x"), F.sum("n").alias("n"))
    star = star.withColumn("lr", stats.kupiec_lr(F.col("x"), F.col("n"), stats.d(alpha)))
    real = per.groupBy(*keys).agg(F.sum("x").alias("x0"), F.sum("n").alias("n0")).withColumn("lr0", stats.kupiec_lr(F.col("x0"), F.col("n0"), stats.d(alpha)))
    joined = star.join(real, list(keys))
    return joined.groupBy(*keys).agg(F.first("lr0").alias("lr"), F.avg((F.round("lr", 9) >= F.round("lr0", 9)).cast("double")).alias("p_boot"))


def _signed(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """rows (with asset) once per draw, with a sign of +1 or -1 from a hash of (seed, draw, asset)."""
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    up = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "asset")), 1, 1) < "8"
    return drawn.withColumn("sign", F.when(up, 1.0).otherwise(-1.0))


def wild_cluster_kupiec_report(facts: DataFrame, draws: int = 999, alpha: float = 0.01, seed: int = 42, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Reports' form: each asset's excess of violations over the level is turned by its sign; p = (hits + 1) / (draws + 1)."""
    per = facts.select(*keys, "asset", F.col("viol_corr").cast("double").alias("x"), F.col("n_test").cast("double").alias("n"))
    real = per.groupBy(*keys).agg(F.sum("x").alias("x0"), F.sum("n").alias("n0")).withColumn("lr", stats.kupiec_lr(F.col("x0"), F.col("n0"), stats.d(alpha)))
    star = _signed(per, draws, seed).groupBy(*keys, "draw").agg(F.sum(alpha * F.col("n") + F.col("sign") * (F.col("x") - alpha * F.col("n"))).alias("x"), F.sum("n").alias("n"))
    star = star.withColumn("lr_star", stats.kupiec_lr(F.greatest(stats.d(0), F.least(F.round("x", 9), F.col("n"))), F.col("n"), stats.d(alpha)))
    hits = F.sum((F.round("lr_star", 9) >= F.round("lr", 9)).cast("int"))
    return star.join(real, list(keys)).groupBy(*keys).agg(F.first("lr").alias("lr"), ((hits + 1) / (draws + 1)).alias("p_boot"))


def cluster_dm(pairs: DataFrame, keys: tuple[str, ...] = ("model_a", "model_b")) -> DataFrame:
    """Comparison by the assets' own mean differences: t over clusters with the number of assets."""
    means = pairs.groupBy(*keys, "asset").agg(F.avg("diff").alias("m"))
    g = means.groupBy(*keys).agg(F.count("*").alias("clusters"), F.avg("m").alias("mean_diff"), (F.stddev_samp("m") / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return g.withColumn("t", F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se")).otherwise(0.0))


def t_p_value(df: DataFrame, t: str = "t", dof: str = "dof") -> DataFrame:
    """df with p_value, two-sided under Student's law (a short table: one row per test)."""
    from vartide.functions import numeric

    def run(batches):
        for pdf in batches:
            yield pdf.assign(p_value=[2 * numeric.t_cdf(-abs(a), b) for a, b in zip(pdf[t], pdf[dof], strict=True)])

    return df.mapInPandas(run, df.withColumn("p_value", stats.d(0)).schema)


def wild_cluster_dm(pairs: DataFrame, draws: int = 999, seed: int = 42, keys: tuple[str, ...] = ("model_a", "model_b")) -> DataFrame:
    """Bootstrap of cluster_dm: centred cluster means under random signs; p = (hits + 1) / (draws + 1)."""
    means = pairs.groupBy(*keys, "asset").agg(F.avg("diff").alias("m"))
    real = cluster_dm(pairs, keys)
    centred = means.join(real.select(*keys, "mean_diff"), list(keys)).withColumn("c", F.col("m") - F.col("mean_diff"))
    star = _signed(centred, draws, seed).groupBy(*keys, "draw").agg(F.avg(F.col("c") * F.col("sign")).alias("d"), (F.stddev_samp(F.col("c") * F.col("sign")) / F.sqrt(F.count("*").cast("double"))).alias("s"))
    star = star.withColumn("t_star", F.when(F.col("s") > 0, F.col("d") / F.col("s")).otherwise(0.0)).join(real.select(*keys, "t", "se"), list(keys))
    hits = F.sum((F.round(F.abs("t_star"), 9) >= F.round(F.abs("t"), 9)).cast("int"))
    out = star.groupBy(*keys).agg(F.first("t").alias("t"), F.first("se").alias("se"), hits.alias("hits"))
    return out.withColumn("p_boot", F.when(F.col("se") > 0, (F.col("hits") + 1) / (draws + 1)).otherwise(1.0)).drop("hits", "se")


def pooled_hac(test: DataFrame, keys: tuple[str, ...] = ("model",), violations: str = "viol_corr") -> DataFrame:
    """keys, n, days, pi and se_hac: the pooled rate with the Bartlett long-run error of daily sums over assets."""
    daily = test.groupBy(*keys, "date").agg(F.sum(violations).cast("double").alias("s"), F.count("*").alias("k"))
    g = daily.groupBy(*keys).agg(F.sum("k").alias("n"), F.count("*").alias("days"), F.sum("s").alias("x"), F.array_sort(F.collect_list(F.struct("date", "s"))).alias("s"))
    days, add = F.col("days").cast("double"), lambda a, x: a + x
    g = g.withColumn("e", F.transform("s", lambda v: v["s"] - F.col("x") / days)).withColumn("lags", F.floor(4.0 * F.pow(days / 100.0, F.lit(2 / 9))).cast("int"))
    lagged = lambda k: F.aggregate(F.zip_with(F.slice("e", k + 1, F.greatest(F.size("e") - k, F.lit(0))), F.slice("e", F.lit(1), F.greatest(F.size("e") - k, F.lit(0))), lambda a, b: a * b), stats.d(0), add)
    weighted = F.transform(F.sequence(F.lit(0), F.col("lags")), lambda k: F.when(k == 0, 1.0).otherwise(2.0 * (1.0 - k / (F.col("lags") + 1.0))) * lagged(k))
    error = F.sqrt(F.aggregate(weighted, stats.d(0), add) / (days * (days - 1)))
    return g.select(*keys, "n", "days", (F.col("x") / F.col("n")).alias("pi"), (error * days / F.col("n")).alias("se_hac"))


def two_sample(rows: DataFrame, y: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """Student's (equal variances) and Welch's t of the means of y before and after, with Welch's degrees."""
    part = lambda f, c: f(F.when(F.col(late) == F.lit(c), F.col(y)))
    g = rows.groupBy(*keys).agg(*[part(f, c).alias(f"{k}{int(c)}") for c in (False, True) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1, gap = F.col("n0").cast("double"), F.col("n1").cast("double"), F.col("m0") - F.col("m1")
    a, b = F.col("v0") / n0, F.col("v1") / n1
    pooled = ((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)
    return g.select(*keys, F.col("n0").alias("n_before"), F.col("n1").alias("n_after"), (gap / F.sqrt(pooled)).alias("t"), (gap / F.sqrt(a + b)).alias("welch_t"), ((a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))).alias("welch_df"))


def wild_cluster_sums(sums: DataFrame, keys: tuple[str, ...] = ("model_a", "model_b")) -> DataFrame:
    """The bootstrap of daily sums over assets whose own series are centred first. A centred series has mean 0 under
    any signs, so every draw's statistic is 0, and the share of draws that reach t is 1 where t is 0, else 0:
    no draw has to be made."""
    g = sums.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.var_samp("s").alias("v"))
    g = g.withColumn("t_orig", F.when(F.col("v") > 0, F.abs("m") / F.sqrt(F.col("v") / F.col("n"))).otherwise(0.0))
    return g.withColumn("p_boot", (F.round("t_orig", 9) <= 0).cast("double")).drop("m", "v")
