"""Column expressions of the library: quarters, guarded arithmetic, likelihood ratios, intervals.

All return NULL, never NaN, where a value is undefined, and raise for no input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_start(d) -> Column:
    return F.trunc(F.to_date(d), "quarter")


def quarter_ordinal(d) -> Column:
    """year * 4 + quarter - 1: consecutive quarters are consecutive integers."""
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def ordinal_date(q: Column) -> Column:
    """The first day of a quarter ordinal."""
    return F.make_date(F.floor(q / 4).cast("int"), (F.pmod(q, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(d) -> Column:
    return F.last_day(F.add_months(d, 2))


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded for comparison across engines; -0.0 becomes 0.0."""
    return F.round(c, places) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either is NULL."""
    return F.when(b != 0, a / b)


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, with 0 for x = 0 whatever y is."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def window_llr(c: Column, n: Column, e: Column) -> Column:
    """Conditional (tree) scan: c ln(c/E) + (n-c) ln((n-c)/(n-E)) for c > E, else 0."""
    c, n, e = (x.cast("double") for x in (c, n, e))
    high = (c > e) & (e > 1e-9) & (n > e)
    return F.when(high, xlogy(c, c / e) + xlogy(n - c, (n - c) / (n - e))).when((c > e) & (e > 1e-9), xlogy(c, c / e)).otherwise(F.lit(0.0))


def bernoulli_llr(c: Column, n: Column, cases: Column, total: Column) -> Column:
    """Case-control log likelihood ratio of a region with c of n, given ``cases`` of ``total``; high rates only."""
    c, n, cases, total = (x.cast("double") for x in (c, n, cases, total))
    inside, outside = c, cases - c
    rest = total - n
    value = xlogy(c, c / n) + xlogy(n - c, (n - c) / n) + xlogy(outside, outside / rest) + xlogy(rest - outside, (rest - outside) / rest) - xlogy(cases, cases / total) - xlogy(total - cases, (total - cases) / total)
    return F.when((n > 0) & (rest > 0) & (inside * rest > outside * n), value).otherwise(F.lit(0.0))


def poisson_llr(c: Column, e: Column, cases: Column) -> Column:
    """c ln(c/E) + (C-c) ln((C-c)/(C-E)) for c > E, else 0."""
    return window_llr(c, cases, e)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval, (0, 1) for no trials, clipped to [0, 1]."""
    p = ratio(k.cast("double"), n.cast("double"))
    z2 = z * z
    mid = (p + z2 / (2 * n)) / (1 + F.lit(z2) / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / (1 + F.lit(z2) / n)
    return (
        F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(F.lit(0.0)),
        F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(F.lit(1.0)),
    )


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to 1e-7 (Zelen and Severo's approximation)."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)
