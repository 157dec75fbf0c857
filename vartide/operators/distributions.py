"""Predictive distributions as columns: samples, quantile grids, parametric laws. All native expressions.

A grid is a pair of arrays (levels, quantiles), both ascending. Student-t tails need an optimiser and live in
`vartide.operators.fit.complete_tail`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vartide.functions import stats


def mean_of(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, stats.d(0), lambda a, x: a + x), F.size(xs))


def std_of(xs: Column) -> Column:
    m = mean_of(xs)
    return F.sqrt(F.try_divide(F.aggregate(xs, stats.d(0), lambda a, x: a + (x - m) * (x - m)), F.size(xs)))


def sample_quantile(samples: Column, level: float) -> Column:
    return stats.let(F.sort_array(samples), lambda s: stats.lerp_sorted(s, stats.d(level)))


def sample_shortfall(samples: Column, level: float) -> Column:
    """Mean of the samples at or below the quantile, else the quantile."""
    return stats.let(sample_quantile(samples, level), lambda q: F.coalesce(mean_of(F.filter(samples, lambda x: x <= q)), q))


def sample_cdf(samples: Column, at: Column) -> Column:
    return F.size(F.filter(samples, lambda x: x <= at)) / F.size(samples)


def tail_mean(samples: Column, k: int = 10) -> Column:
    """Mean of the k smallest samples."""
    return mean_of(F.slice(F.sort_array(samples), 1, k))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation, constant outside (xs ascending)."""
    k = F.size(F.filter(xs, lambda v: v <= x))
    a, b = F.get(xs, k - 1), F.get(xs, k)
    inside = F.get(ys, k - 1) + (F.get(ys, k) - F.get(ys, k - 1)) * (x - a) / F.when(b > a, b - a)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k == F.size(xs), F.element_at(ys, -1)).otherwise(F.coalesce(inside, F.get(ys, k - 1)))


def grid_quantile(levels: Column, quantiles: Column, level: float, tail: str = "linear") -> Column:
    """The grid's own value at a level it has (up to rounding), interpolated inside its range, and completed
    outside: along the two outer knots (`linear`) or by the normal law of the grid's mean and deviation."""
    u = stats.d(level)
    own = F.filter(F.arrays_zip(levels.alias("l"), quantiles.alias("q")), lambda x: F.abs(x["l"] - u) <= 1e-8 + 1e-5 * F.abs(u))
    n = F.size(levels)

    def outer(i: Column, j: Column) -> Column:
        slope = (F.get(quantiles, j) - F.get(quantiles, i)) / (F.get(levels, j) - F.get(levels, i))
        return F.get(quantiles, i) + slope * (u - F.get(levels, i))

    if tail == "linear":
        beyond = F.when(u < F.get(levels, F.lit(0)), outer(F.lit(0), F.lit(1))).otherwise(outer(n - 1, n - 2))
    else:
        beyond = mean_of(quantiles) + std_of(quantiles) * stats.z_value(level)
    inside = (u >= F.get(levels, F.lit(0))) & (u <= F.element_at(levels, -1))
    return F.when(F.size(own) > 0, F.get(own, F.lit(0))["q"]).when(inside, interpolate(u, levels, quantiles)).otherwise(beyond)


def grid_cdf(levels: Column, quantiles: Column, at: Column) -> Column:
    """1 from the largest knot on, interpolated inside; below, the normal law of the grid's mean and deviation."""
    below = stats.normal_cdf((at - mean_of(quantiles)) / F.greatest(std_of(quantiles), stats.d(1e-12)))
    return F.when(at >= F.element_at(quantiles, -1), stats.d(1)).when(at < F.get(quantiles, F.lit(0)), below).otherwise(interpolate(at, quantiles, levels))


def normal_quantile(mean: Column, sd: Column, level: float) -> Column:
    return mean + sd * stats.z_value(level)


def normal_shortfall(mean: Column, sd: Column, level: float) -> Column:
    z = stats.z_value(level)
    return mean - sd * (0.3989422804014327 * 2.718281828459045 ** (-z * z / 2) / level)


def least_squares_normal(quantiles: Column, levels: list[float], first: int, last: int, level: float) -> Column:
    """The quantile at `level` of the normal law that fits the grid's knots first..last (from 1) by least squares.
    The knots are symmetric, so location and scale are fitted apart."""
    z = [stats.z_value(u) for u in levels[first - 1 : last]]
    knots = F.slice(quantiles, first, last - first + 1)
    slope = sum((F.get(quantiles, F.lit(first - 1 + k)) * v for k, v in enumerate(z)), stats.d(0)) / sum(v * v for v in z)
    return mean_of(knots) + slope * stats.z_value(level)
