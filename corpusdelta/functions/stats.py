"""Statistical column expressions (X1-X4, X10) and small driver-side
p-value helpers written with ``math`` only (no SciPy in the image).

The helpers are used on aggregate results whose size is bounded by a
parameter (dimensions, features, folds), never on data-sized tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_likelihood(a, b, c, d) -> Column:
    """G2 for observed counts a, b in corpora of sizes c, d.
    ``E1 = c(a+b)/(c+d)``, ``E2 = d(a+b)/(c+d)``; zero-count terms dropped.
    Everything is cast to double first so huge totals cannot overflow."""
    a, b, c, d = (_c(x).cast("double") for x in (a, b, c, d))
    e1 = c * (a + b) / (c + d)
    e2 = d * (a + b) / (c + d)
    t1 = F.when(a > 0, a * F.ln(a / e1)).otherwise(F.lit(0.0))
    t2 = F.when(b > 0, b * F.ln(b / e2)).otherwise(F.lit(0.0))
    return F.lit(2.0) * (t1 + t2)


def per_million(freq, total) -> Column:
    """``freq / total * 1e6`` (NULL for an empty corpus)."""
    return F.try_divide(_c(freq).cast("double"), _c(total).cast("double")) * F.lit(1e6)


def ratio(num, den) -> Column:
    """Ratio with division by zero -> NULL (never inf or NaN)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def log_ratio(r) -> Column:
    """``log2(ratio)``; a zero ratio gives -inf as in the reference."""
    r = _c(r)
    return F.when(r == 0, F.lit(float("-inf"))).otherwise(F.log2(r))


def binary_log_likelihood(y, p, eps: float = 1e-15) -> Column:
    """X10 term: ``y ln p + (1-y) ln(1-p)`` with p clipped to [eps, 1-eps]."""
    pc = F.least(F.greatest(_c(p).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = _c(y).cast("double")
    return y * F.ln(pc) + (1 - y) * F.ln(1 - pc)


# ------------------------------------------------------------ driver helpers
def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def normal_sf_col(z) -> Column:
    """Upper tail of the standard normal as a column expression: the power
    series of the distribution function below 3, beyond it the continued
    fraction of the tail (both to about 1e-15)."""
    def tail(z):
        x = F.abs(z)
        density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")),
                            lambda s, k: _let(s.term * z * z / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s.sum + t).alias("sum"))))
        fraction = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
        return _let(F.when(x < 3, 0.5 - density * terms["sum"]).otherwise(density / fraction),
                    lambda upper: F.when(z < 0, 1 - upper).otherwise(upper))
    return _let((F.col(z) if isinstance(z, str) else z).cast("double"), tail)


def mann_whitney_p(u, a, b, method: str = "auto") -> Column:
    """Two-sided p of Mann-Whitney's U of the arrays ``a`` and ``b`` as a column
    expression. ``method``: ``exact`` (the distribution of U without ties),
    ``asymptotic`` (tie-corrected normal approximation with continuity
    correction), or ``auto``: exact without ties when a sample has at most 8
    values, else asymptotic. NULL for an empty sample."""
    u, a, b = (F.col(c) if isinstance(c, str) else c for c in (u, a, b))
    m, n = F.size(a), F.size(b)
    mu = m * n / 2

    def asymptotic(ties):
        total = (m + n).cast("double")
        return _let(F.sqrt(m * n / 12.0 * (total + 1 - ties / (total * (total - 1)))), lambda sd: F.when(
            sd > 0, F.least(F.lit(1.0), 2 * normal_sf_col((F.abs(u - mu) - 0.5) / sd))).otherwise(1.0))

    def exact():
        # how many orders of m and n values give each U: those whose last value is of the first sample
        # (which lies above all n others), and those whose last one is of the second
        places = F.sequence(F.lit(0), m * n)
        none = F.transform(places, lambda i: F.when(i == 0, 1.0).otherwise(0.0))

        def wider(grid, k):
            return F.aggregate(F.sequence(F.lit(1), m), F.array(none), lambda done, j: F.concat(done, F.array(F.transform(
                places, lambda i: F.coalesce(F.get(F.get(done, j - 1), i - k), F.lit(0.0)) + F.get(F.get(grid, j), i)))))

        def add(s, x):
            return s + x
        grids = F.aggregate(F.sequence(F.lit(1), n), F.array_repeat(none, m + 1), wider)
        return _let(F.get(grids, m), lambda orders: F.least(F.lit(1.0), 2 * F.aggregate(F.slice(
            orders, F.ceil(F.greatest(u, m * n - u)).cast("int") + 1, m * n + 1), F.lit(0.0), add) / F.aggregate(orders, F.lit(0.0), add)))

    tied = _let(F.concat(a, b), lambda both: F.aggregate(
        F.transform(F.array_distinct(both), lambda v: F.size(F.filter(both, lambda x: x == v)).cast("double")),
        F.lit(0.0), lambda s, t: s + t * t * t - t))
    if method == "asymptotic":
        p = _let(tied, asymptotic)
    elif method == "exact":
        p = exact()
    else:
        p = _let(tied, lambda ties: F.when((F.least(m, n) <= 8) & (ties == 0), exact()).otherwise(asymptotic(ties)))
    return F.when((m > 0) & (n > 0), p)


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """Two-sided p of Student's t with ``df`` degrees of freedom."""
    if df <= 0 or t is None or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    return betainc(df / 2.0, 0.5, x)


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square with k degrees of freedom (regularised
    upper incomplete gamma by series / continued fraction)."""
    if x <= 0:
        return 1.0
    a = k / 2.0
    xx = x / 2.0
    if xx < a + 1:
        term = s = 1.0 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= xx / n
            s += term
            if abs(term) < abs(s) * 1e-16:
                break
        return 1.0 - s * math.exp(-xx + a * math.log(xx) - math.lgamma(a))
    b = xx + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        de = d * c
        h *= de
        if abs(de - 1) < 1e-16:
            break
    return math.exp(-xx + a * math.log(xx) - math.lgamma(a)) * h
