"""Column functions for coverage tests, scores and tail probabilities.

Everything here is a Catalyst expression: it folds, pushes down and runs inside generated code; Python is
never involved. Where the package and the report scripts use different formulas under one name, the
`report` variant has a name of its own.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the error function's series; enough for arguments up to 8.
TERMS = 250


def d(x: float) -> Column:
    """A DOUBLE literal (decimal literals would change integer products)."""
    return F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def level(alpha: float | Column) -> Column:
    """A level that is one number or differs from row to row."""
    return alpha if isinstance(alpha, Column) else d(alpha)


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(level)


def erf(x: Column) -> Column:
    """Error function by 2/sqrt(pi) exp(-x^2) sum t_n with t_n = t_(n-1) 2x^2/(2n+1)."""
    a = F.abs(x)
    zero = F.struct(a.alias("t"), a.alias("s"))

    def step(acc: Column, n: Column) -> Column:
        t = acc["t"] * 2.0 * a * a / (2.0 * n + 1.0)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["s"])
    value = F.when(a >= 6.0, d(1)).otherwise(2.0 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-a * a) * series)
    return F.when(x < 0, -value).otherwise(value)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / d(2**0.5)))


def normal_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / d((2 * 3.141592653589793) ** 0.5)


def two_sided_p(t: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(t)))


def chi2_sf1(x: Column) -> Column:
    """P(chi-square with 1 degree of freedom > x)."""
    return F.when(x <= 0, d(1)).otherwise(1.0 - erf(F.sqrt(x / 2.0)))


def chi2_sf2(x: Column) -> Column:
    return F.when(x <= 0, d(1)).otherwise(F.exp(-x / 2.0))


def _xlog(n: Column, p: Column) -> Column:
    """n ln p with 0 ln 0 = 0."""
    return F.when(n == 0, d(0)).otherwise(n * F.ln(p))


def kupiec_lr(x: Column, n: Column, alpha: Column) -> Column:
    """Proportion-of-failures likelihood ratio; closed forms at no and at only violations."""
    x, n = x.cast("double"), n.cast("double")
    pi = x / F.when(n > 0, n)
    full = -2.0 * ((n - x) * F.ln(1.0 - alpha) + x * F.ln(alpha) - _xlog(n - x, 1.0 - pi) - _xlog(x, pi))
    return F.when(n == 0, d(0)).when(x == 0, -2.0 * n * F.ln(1.0 - alpha)).when(x == n, -2.0 * n * F.ln(alpha)).otherwise(full)


def kupiec_p(x: Column, n: Column, alpha: Column) -> Column:
    return F.when(n == 0, d(1)).otherwise(chi2_sf1(kupiec_lr(x, n, alpha)))


def transition_lr(n00: Column, n01: Column, n10: Column, n11: Column, eps: float = 1e-12) -> Column:
    """Likelihood ratio of first-order dependence, package form: probabilities kept off 0 and 1 by eps."""
    c = [x.cast("double") for x in (n00, n01, n10, n11)]
    keep = lambda p: F.greatest(d(eps), F.least(p, d(1 - eps)))
    pi01, pi11 = keep(c[1] / F.greatest(c[0] + c[1], d(1))), keep(c[3] / F.greatest(c[2] + c[3], d(1)))
    pi = keep((c[1] + c[3]) / F.greatest(c[0] + c[1] + c[2] + c[3], d(1)))
    null = (c[0] + c[2]) * F.ln(1 - pi) + (c[1] + c[3]) * F.ln(pi)
    full = c[0] * F.ln(1 - pi01) + c[1] * F.ln(pi01) + c[2] * F.ln(1 - pi11) + c[3] * F.ln(pi11)
    return F.greatest(d(0), -2.0 * (null - full))


def transition_p_report(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Independence p-value of the reports: null where a state never occurs or a rate is 0 or 1."""
    c = [x.cast("double") for x in (n00, n01, n10, n11)]
    empty = (c[0] + c[1] == 0) | (c[2] + c[3] == 0) | (c[1] + c[3] == 0) | (c[0] + c[2] == 0)
    pi01, pi11 = F.try_divide(c[1], c[0] + c[1]), F.try_divide(c[3], c[2] + c[3])
    edge = (pi01 == 0) | (pi11 == 0) | (pi01 == 1) | (pi11 == 1)
    pi = F.try_divide(c[1] + c[3], c[0] + c[1] + c[2] + c[3])
    lr = -2.0 * ((c[0] + c[2]) * F.ln(1 - pi) + (c[1] + c[3]) * F.ln(pi) - c[0] * F.ln(1 - pi01) - c[1] * F.ln(pi01) - c[2] * F.ln(1 - pi11) - c[3] * F.ln(pi11))
    return F.when(~(empty | edge), chi2_sf1(lr))


def basel_zone(violations: Column, n: Column) -> Column:
    """Traffic light of the package: violations among the last 250; scaled (half to even) below 250."""
    scaled = F.when(n < 250, F.bround(violations.cast("double") * 250.0 / F.when(n > 0, n).cast("double"), 0)).otherwise(violations.cast("double"))
    return F.when(n == 0, "green").when(scaled <= 4, "green").when(scaled <= 9, "yellow").otherwise("red")


def basel_zone_report(violations: Column, n: Column) -> Column:
    """Traffic light of the reports: all violations scaled to 250 days, unrounded."""
    scaled = violations.cast("double") * 250.0 / n.cast("double")
    return F.when(scaled <= 4, "Green").when(scaled <= 9, "Yellow").otherwise("Red")


def _log_odds(a: Column) -> Column:
    return F.ln(a / (1.0 - a))


def _binomial_sum(n: Column, a: Column, counts) -> Column:
    """Sum of binomial probabilities of the k for which counts(k, log probability) holds, by a fold over 0..n."""

    def step(acc: Column, k: Column) -> Column:
        ahead = F.when(k < n, acc["lp"] + F.ln((n - k).cast("double") / (k + 1)) + _log_odds(a)).otherwise(acc["lp"])
        return F.struct(ahead.alias("lp"), (acc["total"] + F.when(counts(k, acc["lp"]), F.exp(acc["lp"])).otherwise(d(0))).alias("total"))

    start = F.struct((n * F.ln(1.0 - a)).alias("lp"), d(0).alias("total"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), start, step, lambda acc: F.least(d(1), acc["total"]))


def binomial_two_sided(x: Column, n: Column, a: Column) -> Column:
    """Exact test: the probabilities of all counts that are not likelier than x."""
    own = F.aggregate(F.slice(F.sequence(F.lit(0).cast("long"), n.cast("long")), F.lit(2), x.cast("int")), n * F.ln(1.0 - a), lambda lp, k: lp + F.ln((n - k + 1).cast("double") / k) + _log_odds(a))
    return _binomial_sum(n, a, lambda k, lp: lp <= own + 1e-7)


def binomial_upper(x: Column, n: Column, a: Column) -> Column:
    """P(X >= x)."""
    return _binomial_sum(n, a, lambda k, lp: k >= x)


def binomial_zone(x: Column, n: Column, a: Column) -> Column:
    """Traffic light by the probability of fewer violations; at the ends by the rate alone."""
    below = 1.0 - binomial_upper(x, n, a)
    return F.when((x == 0) | (x == n), F.when(x / n <= 0.015, "Green").otherwise("Red")).when(below >= 0.9999, "Red").when(below >= 0.95, "Yellow").otherwise("Green")


def coverage_variants(x: Column, n: Column, lr: Column, a: Column) -> list[Column]:
    """p_exact (binomial where no or all days violate), p_floor (1 and 0 there), p_distance (1 within .02 of the
    level, else 0; absolute likelihood ratio) and upper_tail, P(X >= x)."""
    ends, p = (x == 0) | (x == n), chi2_sf1(lr)
    return [
        F.when(ends, binomial_two_sided(x, n, a)).otherwise(p).alias("p_exact"), F.when(x == 0, d(1)).when(x == n, d(0)).otherwise(p).alias("p_floor"),
        F.when(ends, F.when(F.abs(x / n - a) > 0.02, d(0)).otherwise(d(1))).otherwise(chi2_sf1(F.abs(lr))).alias("p_distance"), binomial_upper(x, n, a).alias("upper_tail"),
    ]


def pinball(r: Column, q: Column, alpha: Column) -> Column:
    e = r - q
    return F.when(e < 0, (alpha - 1.0) * e).otherwise(alpha * e)


def fz0(r: Column, v: Column, e: Column, alpha: Column) -> Column:
    """Fissler-Ziegel loss, package form (es kept off zero)."""
    e = F.when(F.abs(e) < 1e-12, d(-1e-12)).otherwise(e)
    hit = F.when(r < v, d(1)).otherwise(d(0))
    return hit * (v - r) / (alpha * e) + v / e - F.ln(-e + 1e-12) - 1.0


def fz0_report(r: Column, v: Column, e: Column, alpha: Column) -> Column:
    """Fissler-Ziegel loss of the reports; two terms carry the other sign."""
    e = F.least(e, d(-1e-10))
    hit = F.when(r < v, d(1)).otherwise(d(0))
    return hit * (r - v) / (alpha * e) + v / e + F.ln(-e) - 1.0


def lerp_sorted(xs: Column, level: Column) -> Column:
    """Linear (type-7) quantile of a sorted array at a level that may differ from row to row."""
    at = level * (F.size(xs) - 1).cast("double")
    low = F.floor(at).cast("int")
    a, b = F.get(xs, low), F.get(xs, F.least(low + 1, F.size(xs) - 1))
    return a + (b - a) * (at - low)


def order_rank(n: Column, alpha: Column) -> Column:
    """Rank ceil((n + 1)(1 - alpha)) of the conformal order statistic, at most n."""
    return F.least(F.ceil((n.cast("double") + 1.0) * (1.0 - alpha)), n.cast("long")).cast("int")
