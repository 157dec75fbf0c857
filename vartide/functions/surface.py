"""Functions for SQL: coverage tests, zones and losses as SQL functions, the stationary bootstrap as a table function.

    surface.register(spark)
    spark.sql("SELECT va_kupiec_p(12, 1000, 0.01)")
    spark.sql("SELECT * FROM va_bootstrap(TABLE(scores) PARTITION BY (model, asset) ORDER BY (pos), 0.01D, 999, 20D, 2026)")

SQL functions are expanded into the plan like any expression. They live as long as the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vartide.functions.stats import TERMS

#: name: arguments, type, body.
FUNCTIONS = {
    "va_erf": (
        "x DOUBLE", "DOUBLE",
        f"CASE WHEN abs(x) >= 6 THEN sign(x) ELSE sign(x) * 2.0D / sqrt(pi()) * exp(-x * x) * aggregate(sequence(1, {TERMS}), named_struct('t', abs(x), 's', abs(x)), "
        "(va_acc, va_k) -> named_struct('t', va_acc.t * 2.0D * x * x / (2.0D * va_k + 1), 's', va_acc.s + va_acc.t * 2.0D * x * x / (2.0D * va_k + 1)), va_acc -> va_acc.s) END",  # names no caller's column has
    ),
    "va_chi2_sf1": ("x DOUBLE", "DOUBLE", "CASE WHEN x <= 0 THEN 1.0D ELSE 1.0D - va_erf(sqrt(x / 2.0D)) END"),
    "va_chi2_sf2": ("x DOUBLE", "DOUBLE", "CASE WHEN x <= 0 THEN 1.0D ELSE exp(-x / 2.0D) END"),
    "va_normal_cdf": ("x DOUBLE", "DOUBLE", "0.5D * (1.0D + va_erf(x / sqrt(2.0D)))"),
    "va_kupiec_lr": (
        "x DOUBLE, n DOUBLE, a DOUBLE", "DOUBLE",
        "CASE WHEN n = 0 THEN 0.0D WHEN x = 0 THEN -2.0D * n * ln(1.0D - a) WHEN x = n THEN -2.0D * n * ln(a) "
        "ELSE -2.0D * ((n - x) * ln(1.0D - a) + x * ln(a) - (n - x) * ln(1.0D - x / n) - x * ln(x / n)) END",
    ),
    "va_kupiec_p": ("x DOUBLE, n DOUBLE, a DOUBLE", "DOUBLE", "CASE WHEN n = 0 THEN 1.0D ELSE va_chi2_sf1(va_kupiec_lr(x, n, a)) END"),
    "va_inside": ("p DOUBLE", "DOUBLE", "greatest(1e-12D, least(p, 1.0D - 1e-12D))"),
    "va_rates_log": ("stay DOUBLE, go DOUBLE, p DOUBLE", "DOUBLE", "stay * ln(1.0D - va_inside(p)) + go * ln(va_inside(p))"),
    "va_transition_lr": (
        "n00 DOUBLE, n01 DOUBLE, n10 DOUBLE, n11 DOUBLE", "DOUBLE",
        "greatest(0.0D, -2.0D * (va_rates_log(n00 + n10, n01 + n11, (n01 + n11) / greatest(n00 + n01 + n10 + n11, 1.0D)) "
        "- va_rates_log(n00, n01, n01 / greatest(n00 + n01, 1.0D)) - va_rates_log(n10, n11, n11 / greatest(n10 + n11, 1.0D))))",
    ),
    "va_basel_zone": (
        "x DOUBLE, n DOUBLE", "STRING",
        "CASE WHEN n = 0 THEN 'green' ELSE CASE WHEN (CASE WHEN n < 250 THEN bround(x * 250.0D / n, 0) ELSE x END) <= 4 THEN 'green' WHEN (CASE WHEN n < 250 THEN bround(x * 250.0D / n, 0) ELSE x END) <= 9 THEN 'yellow' ELSE 'red' END END",
    ),
    "va_basel_zone_report": ("x DOUBLE, n DOUBLE", "STRING", "CASE WHEN x * 250.0D / n <= 4 THEN 'Green' WHEN x * 250.0D / n <= 9 THEN 'Yellow' ELSE 'Red' END"),
    "va_pinball": ("r DOUBLE, q DOUBLE, a DOUBLE", "DOUBLE", "CASE WHEN r < q THEN (a - 1.0D) * (r - q) ELSE a * (r - q) END"),
    "va_fz0": ("r DOUBLE, v DOUBLE, e DOUBLE, a DOUBLE", "DOUBLE", "CASE WHEN abs(e) < 1e-12 THEN va_fz0_at(r, v, -1e-12D, a) ELSE va_fz0_at(r, v, e, a) END"),
    "va_z2_term": ("r DOUBLE, v DOUBLE, e DOUBLE", "DOUBLE", "CASE WHEN r < v THEN r + abs(e) END"),
    "va_regime": ("q_v DOUBLE, width DOUBLE", "STRING", "CASE WHEN width < 1e-12 OR abs(q_v) / width > 1 THEN 'replacement' ELSE 'signal-preserving' END"),
}
_FZ0 = ("r DOUBLE, v DOUBLE, e DOUBLE, a DOUBLE", "DOUBLE", "CASE WHEN r < v THEN (v - r) / (a * e) ELSE 0.0D END + v / e - ln(-e + 1e-12D) - 1.0D")

BOOTSTRAP = "model string, asset string, q_v double, q_lo double, q_hi double, q_se double"


def _bootstrap():
    """The table function's class; its input has model, asset, pos and score, a partition a pair, in order."""
    from pyspark.sql.functions import udtf

    class Bootstrap:
        def __init__(self):
            self.key, self.scores, self.given = None, [], None

        def eval(self, row, alpha: float, draws: int, mean_block: float, seed: int):
            self.key, self.given = (row["model"], row["asset"]), (alpha, draws, mean_block, seed)
            self.scores.append(row["score"])

        def terminate(self):
            import numpy as np

            from vartide.functions import numeric
            from vartide.operators.fit import seed_of

            if self.key is None:
                return
            alpha, draws, mean_block, seed = self.given
            s = np.array(self.scores, float)
            q = numeric.stationary_bootstrap(s, 1 - alpha, int(draws), mean_block, np.random.default_rng([int(seed), seed_of(*self.key)]))
            low, high = np.quantile(q, [0.025, 0.975])
            yield (*self.key, float(np.quantile(s, 1 - alpha)), float(low), float(high), float(q.std(ddof=1)))

    return udtf(Bootstrap, returnType=BOOTSTRAP)


def register(spark: SparkSession) -> None:
    """Create all functions in the session, replacing earlier ones."""
    for name, (arguments, kind, body) in {"va_fz0_at": _FZ0, **FUNCTIONS}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("va_bootstrap", _bootstrap())
