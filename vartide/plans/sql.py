"""DuckDB text for the same computations: the pieces from which the catalog's SQL is put together."""

from __future__ import annotations

from statistics import NormalDist


def erf(x: str) -> str:
    """The error function's series with its double factorial through the log-gamma function."""
    a = f"abs({x})"
    term = f"exp(ln({a}) + n * ln(2.0::DOUBLE * {a} * {a}) - ((n + 1) * ln(2.0::DOUBLE) + lgamma(n + 1.5::DOUBLE) - 0.5::DOUBLE * ln(pi())))"
    series = f"list_sum(list_transform(range(0, 251), lambda n: {term}))"
    return f"(CASE WHEN {a} < 1e-300 THEN 0.0::DOUBLE WHEN {a} >= 6 THEN sign({x})::DOUBLE ELSE sign({x}) * 2.0::DOUBLE / sqrt(pi()) * exp(-({a} * {a})) * {series} END)"


def chi2_sf1(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {erf(f'sqrt({x} / 2.0::DOUBLE)')} END)"


def two_sided_p(t: str) -> str:
    return f"(2.0::DOUBLE * (1.0::DOUBLE - 0.5::DOUBLE * (1.0::DOUBLE + {erf(f'(abs({t}) / sqrt(2.0::DOUBLE))')})))"


def kupiec_lr(x: str, n: str, a: str) -> str:
    pi = f"({x}::DOUBLE / {n})"
    return (
        f"(CASE WHEN {x} = 0 THEN -2.0::DOUBLE * {n} * ln(1.0::DOUBLE - {a}) WHEN {x} = {n} THEN -2.0::DOUBLE * {n} * ln({a}) ELSE "
        f"-2.0::DOUBLE * (({n} - {x}) * ln(1.0::DOUBLE - {a}) + {x} * ln({a}) - ({n} - {x}) * ln(1.0::DOUBLE - {pi}) - {x} * ln({pi})) END)"
    )


def _log_pmf(k: str, n: str, a: str) -> str:
    return f"(lgamma({n} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({n} - {k} + 1.0::DOUBLE) + {k} * ln({a}) + ({n} - {k}) * ln(1.0::DOUBLE - {a}))"


def binomial_two_sided(x: str, n: str, a: str) -> str:
    """Sum of the probabilities that are not above that of x."""
    return f"list_sum(list_transform(list_filter(range(0, CAST({n} AS BIGINT) + 1), lambda k: {_log_pmf('k', n, a)} <= {_log_pmf(x, n, a)} + 1e-7::DOUBLE), lambda k: exp({_log_pmf('k', n, a)})))"


def binomial_upper(x: str, n: str, a: str) -> str:
    """P(X >= x)."""
    return f"least(1.0::DOUBLE, list_sum(list_transform(range(CAST({x} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda k: exp({_log_pmf('k', n, a)}))))"


def binomial_zone(x: str, n: str, a: str) -> str:
    up = binomial_upper(x, n, a)
    return f"(CASE WHEN {x} = 0 OR {x} = {n} THEN CASE WHEN {x}::DOUBLE / {n} <= 0.015 THEN 'Green' ELSE 'Red' END WHEN 1.0::DOUBLE - {up} >= 0.9999 THEN 'Red' WHEN 1.0::DOUBLE - {up} >= 0.95 THEN 'Yellow' ELSE 'Green' END)"


def transition_p_report(s: str) -> str:
    """The reports' form: null where a state never occurs or a rate is 0 or 1."""
    n00, n01, n10, n11 = (f"n{c}_{s}::DOUBLE" for c in ("00", "01", "10", "11"))
    p01, p11, p = f"({n01} / ({n00} + {n01}))", f"({n11} / ({n10} + {n11}))", f"(({n01} + {n11}) / ({n00} + {n01} + {n10} + {n11}))"
    lr = f"(-2.0::DOUBLE * (({n00} + {n10}) * ln(1 - {p}) + ({n01} + {n11}) * ln({p}) - {n00} * ln(1 - {p01}) - {n01} * ln({p01}) - {n10} * ln(1 - {p11}) - {n11} * ln({p11})))"
    return f"(CASE WHEN {n00} > 0 AND {n01} > 0 AND {n10} > 0 AND {n11} > 0 THEN {chi2_sf1(lr)} END)"


def transition_lr(s: str) -> str:
    keep = lambda p: f"greatest(1e-12::DOUBLE, least({p}, 1.0::DOUBLE - 1e-12::DOUBLE))"
    n00, n01, n10, n11 = (f"n{c}_{s}" for c in ("00", "01", "10", "11"))
    p01, p11 = keep(f"{n01}::DOUBLE / greatest({n00} + {n01}, 1)"), keep(f"{n11}::DOUBLE / greatest({n10} + {n11}, 1)")
    p = keep(f"({n01} + {n11})::DOUBLE / greatest({n00} + {n01} + {n10} + {n11}, 1)")
    null = f"(({n00} + {n10}) * ln(1 - {p}) + ({n01} + {n11}) * ln({p}))"
    full = f"({n00} * ln(1 - {p01}) + {n01} * ln({p01}) + {n10} * ln(1 - {p11}) + {n11} * ln({p11}))"
    return f"greatest(0.0::DOUBLE, -2.0::DOUBLE * ({null} - {full}))"


def pinball(r: str, q: str, a: str) -> str:
    return f"(CASE WHEN {r} - {q} < 0 THEN ({a} - 1.0::DOUBLE) * ({r} - {q}) ELSE {a} * ({r} - {q}) END)"


PANELS = {
    "a": "SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v FROM orders",
    "b": "SELECT c_mktsegment AS asset, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey",
    "c": "SELECT n_name AS asset, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
}


def returns(panel: str = "a") -> str:
    """CTEs up to ret(asset, date, r, pos)."""
    return f"""src AS ({PANELS[panel]}),
px AS (SELECT asset, date, CAST(SUM(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS p FROM src GROUP BY ALL),
lr AS (SELECT asset, date, CAST(CAST(LN(p / LAG(p) OVER (PARTITION BY asset ORDER BY date)) AS DECIMAL(18,12)) AS DOUBLE) AS r FROM px),
ret AS (SELECT asset, date, r, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY date) - 1 AS pos FROM lr WHERE r IS NOT NULL)"""


def exact(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,12)) AS DOUBLE)"


def hist_sim(alpha: float, window: int, name: str = "hs") -> str:
    return f"{name} AS (SELECT asset, date, pos, r, {exact(f'COALESCE(quantile_cont(r, {alpha}) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING), 0.0)')} AS q FROM ret)"


def rolling_normal(alpha: float, window: int) -> str:
    z = NormalDist().inv_cdf(alpha)
    phi = 0.3989422804014327 * 2.718281828459045 ** (-z * z / 2)
    over = f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    mean, sd = f"AVG(r) {over}", f"COALESCE(STDDEV_SAMP(r) {over}, 0.0)"
    return f"""nr AS (SELECT asset, date, pos, r, {exact(f"COALESCE({mean} + {sd} * ({z!r})::DOUBLE, 0.0)")} AS q, {exact(f"COALESCE({mean} - {sd} * ({phi / alpha!r})::DOUBLE, 0.0)")} AS es FROM ret)"""


def models(alpha: float = 0.01, window: int = 250, panel: str = "a") -> str:
    """CTEs up to paths(model, asset, date, pos, r, q) of the five native models."""
    return f"""{returns(panel)},
{hist_sim(alpha, window)},
{rolling_normal(alpha, window)},
paths AS (SELECT 'hist_sim' AS model, asset, date, pos, r, q FROM hs UNION ALL SELECT 'scaled_05', asset, date, pos, r, {exact("q * 0.5::DOUBLE")} FROM hs
UNION ALL SELECT 'scaled_12', asset, date, pos, r, {exact("q * 1.2::DOUBLE")} FROM hs UNION ALL SELECT 'const_zero', asset, date, pos, r, 0.0::DOUBLE FROM hs UNION ALL SELECT 'norm_roll', asset, date, pos, r, q FROM nr)"""


def parts(split: float = 0.7, source: str = "paths") -> str:
    return f"""parts AS (SELECT *, q - r AS score, COUNT(*) OVER (PARTITION BY model, asset) AS n, CAST(FLOOR(COUNT(*) OVER (PARTITION BY model, asset) * CAST({split} AS DOUBLE)) AS INT) AS n_cal FROM {source})"""


def qv(alpha: float = 0.01, method: str = "linear", source: str = "parts", where: str = "pos < n_cal") -> str:
    """CTE qv(model, asset, q_v)."""
    if method == "linear":
        return f"qv AS (SELECT model, asset, quantile_cont(score, {1 - alpha!r}) AS q_v FROM {source} WHERE {where} GROUP BY ALL)"
    rank = f"CAST(LEAST(CEIL((len(s) + 1.0::DOUBLE) * CAST({1 - alpha!r} AS DOUBLE)), len(s)) AS INT)"
    srt = f"srt AS (SELECT model, asset, list_sort(list(score)) AS s FROM {source} WHERE {where} GROUP BY ALL)"
    if method == "order":
        return f"{srt}, qv AS (SELECT model, asset, s[{rank}] AS q_v FROM srt)"
    at = f"(({rank})::DOUBLE / len(s) * (len(s) - 1)::DOUBLE)"
    low = f"CAST(FLOOR({at}) AS INT)"
    return f"{srt}, qv AS (SELECT model, asset, s[{low} + 1] + (s[LEAST({low} + 2, len(s))] - s[{low} + 1]) * ({at} - {low}) AS q_v FROM srt)"


TEST = """test AS (SELECT t.*, q_v, -q AS var_raw, -q + q_v AS var_corr, CAST(r < q AS INT) AS viol_raw, CAST(r < -(-q + q_v) AS INT) AS viol_corr FROM parts t JOIN qv USING (model, asset) WHERE pos >= n_cal)"""


def backtest(alpha: float = 0.01, source: str = "test", keys: str = "model, asset") -> str:
    """CTEs up to bt: one row per pair with counts, tests, zones and scores."""
    cells = ", ".join(f"SUM(CAST(p_{s} = {i} AND viol_{s} = {j} AS INT)) AS n{i}{j}_{s}" for s in ("raw", "corr") for i in (0, 1) for j in (0, 1))
    a = f"CAST({alpha!r} AS DOUBLE)"
    per = ", ".join(f"SUM(viol_{s}) AS viol_{s}, SUM(CASE WHEN age <= 250 THEN viol_{s} END) AS last_{s}, AVG({pinball('r', f'(-var_{s})', a)}) AS qs_{s}, AVG(ABS(var_{s})) AS width_{s}" for s in ("raw", "corr"))
    more = ", ".join(
        f"viol_{s}::DOUBLE / n_test AS pi_{s}, {kupiec_lr(f'viol_{s}', 'n_test', a)} AS kupiec_lr_{s}, {transition_lr(s)} AS lr_ind_{s}, "
        f"CASE WHEN (CASE WHEN n_test < 250 THEN round_even(last_{s} * 250.0::DOUBLE / n_test, 0) ELSE last_{s} END) <= 4 THEN 'green' WHEN (CASE WHEN n_test < 250 THEN round_even(last_{s} * 250.0::DOUBLE / n_test, 0) ELSE last_{s} END) <= 9 THEN 'yellow' ELSE 'red' END AS zone_{s}, "
        f"CASE WHEN viol_{s} * 250.0::DOUBLE / n_test <= 4 THEN 'Green' WHEN viol_{s} * 250.0::DOUBLE / n_test <= 9 THEN 'Yellow' ELSE 'Red' END AS zone_report_{s}"
        for s in ("raw", "corr")
    )
    ps = ", ".join(f"{chi2_sf1(f'kupiec_lr_{s}')} AS kupiec_p_{s}, {chi2_sf1(f'lr_ind_{s}')} AS ind_p_{s}, CASE WHEN kupiec_lr_{s} + lr_ind_{s} <= 0 THEN 1.0 ELSE exp(-(kupiec_lr_{s} + lr_ind_{s}) / 2.0::DOUBLE) END AS cc_p_{s}" for s in ("raw", "corr"))
    lag = ", ".join(f"LAG(viol_{s}) OVER (PARTITION BY {keys} ORDER BY pos) AS p_{s}" for s in ("raw", "corr"))
    return f"""mk AS (SELECT *, {lag}, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY pos DESC) AS age FROM {source}),
ag AS (SELECT {keys}, COUNT(*) AS n_test, ANY_VALUE(q_v) AS q_v, {per}, {cells} FROM mk GROUP BY {keys}),
bt0 AS (SELECT *, {more}, CASE WHEN width_raw < 1e-12 THEN 'inf'::DOUBLE ELSE ABS(q_v) / width_raw END AS ratio FROM ag),
bt AS (SELECT *, {ps}, CASE WHEN ratio > 1 THEN 'replacement' ELSE 'signal-preserving' END AS regime FROM bt0)"""
