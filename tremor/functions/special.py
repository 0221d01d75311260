"""Special functions on arrays (no external numeric library), and their column forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients (g = 7, n = 9).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

#: Euler's constant, a fixed value.
EULER = 0.5772156649015329


def gammaln(x: np.ndarray | float) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float) - 1
    total = LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def upper_gamma(a: float, x: np.ndarray | float) -> np.ndarray:
    """Upper incomplete gamma function of any real ``a`` and positive ``x``.

    From x = 1.5 on, a continued fraction; below, the Taylor series of the difference
    from the complete function, written so that nothing cancels as ``a`` passes 0, and
    for ``a`` below -0.5 the recurrence from ``a`` + 1.
    """
    x = np.asarray(x, float)
    out = np.empty_like(x)
    big = x >= 1.5
    if big.any():
        out[big] = _by_fraction(a, x[big])
    if (~big).any():
        s = x[~big]
        if a < -0.5:
            out[~big] = (upper_gamma(a + 1, s) - s**a * np.exp(-s)) / a
        else:
            out[~big] = _by_series(a, s)
    return out


def _by_fraction(a: float, x: np.ndarray) -> np.ndarray:
    """Lentz's method."""
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full_like(x, 1 / tiny), 1 / b
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return np.exp(-x + a * np.log(x)) * h


def _by_series(a: float, x: np.ndarray) -> np.ndarray:
    """(Gamma(a+1) - x^a) / a minus the series of the lower function beyond its first term."""
    log_x = np.log(x)
    if abs(a) < 1e-5:
        # Series in a of (Gamma(a+1) - x^a) / a, with Euler's constant and zeta(2).
        lead = -EULER - log_x + a * ((math.pi**2 / 6 + EULER**2) / 2 - log_x**2 / 2)
    else:
        lead = (math.gamma(a + 1) - 1 - np.expm1(a * log_x)) / a
    term, total = np.ones_like(x), np.zeros_like(x)
    for k in range(1, 200):
        term = term * (-x / k)
        step = term / (a + k)
        total += step
        if np.all(np.abs(step) <= 1e-17 * np.maximum(np.abs(total), 1e-300)):
            break
    return lead - x**a * total


def inverse_upper_gamma(a: float, y: np.ndarray | float) -> np.ndarray:
    """x with ``upper_gamma(a, x) = y``, by bisection on log x and Newton steps."""
    y = np.asarray(y, float)
    lo, hi = np.full_like(y, -700.0), np.full_like(y, 7.0)
    for _ in range(70):
        mid = (lo + hi) / 2
        above = upper_gamma(a, np.exp(mid)) > y
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.exp((lo + hi) / 2)


def tapered_time_integral(start: np.ndarray, end: np.ndarray | None, c: float, omega: float, tau: float) -> np.ndarray:
    """Integral of exp(-t / tau) (t + c)^-(1 + omega) between two delays; ``tau`` may be infinite, ``end`` None."""
    start = np.asarray(start, float)
    if tau == math.inf:
        at = lambda t: (t + c) ** -omega / omega if omega else -np.log(t + c)
        return at(start) - (0.0 if end is None else at(np.asarray(end, float)))
    total = upper_gamma(-omega, (start + c) / tau)
    if end is not None:
        total = total - upper_gamma(-omega, (np.asarray(end, float) + c) / tau)
    return math.exp(c / tau) * tau**-omega * total


def tapered_delay_of(u: np.ndarray, c: float, omega: float, tau: float) -> np.ndarray:
    """Delay from uniform numbers by the inverse of the tapered kernel's distribution."""
    return inverse_upper_gamma(-omega, (1 - np.asarray(u, float)) * upper_gamma(-omega, np.array(c / tau))) * tau - c


#: Where the column form of the incomplete gamma function passes from its series to its fraction, and their terms.
SPLIT, SERIES_TERMS, FRACTION_TERMS = 3.0, 40, 28


def upper_gamma_of(a: float, x: Column) -> Column:
    """Column form of ``upper_gamma`` for positive ``x``: a polynomial, or a continued fraction of fixed length, from its end.

    ``a`` is a number, so the polynomial's coefficients are too. Relative error below 1e-11 for ``a`` above -1.
    """
    if a < -0.5:
        return (upper_gamma_of(a + 1, x) - F.exp(a * F.log(x) - x)) / a
    series = F.lit(0.0)
    for k in range(SERIES_TERMS, 0, -1):
        series = (series + F.lit((-1.0) ** k / (math.factorial(k) * (a + k)))) * x
    log_x = F.log(x)
    if abs(a) < 1e-5:
        lead = F.lit(-EULER + a * (math.pi**2 / 6 + EULER**2) / 2) - log_x - F.lit(a / 2) * log_x * log_x
    else:
        lead = (F.lit(math.gamma(a + 1) - 1) - F.expm1(a * log_x)) / a
    below = lead - F.exp(a * F.log(x)) * series
    fraction = F.lit(0.0)
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = F.lit(float(k * (k - a))) / (x + (2 * k + 1 - a) - fraction)
    above = F.exp(a * F.log(x) - x) / (x + (1 - a) - fraction)
    return F.when(x < SPLIT, below).otherwise(above)


#: Steps of the column form of the inverse; each squares the error once it is small.
INVERSE_STEPS = 12


def inverse_upper_gamma_of(a: float, y: Column) -> Column:
    """Column form of ``inverse_upper_gamma`` for ``a`` above -1: Newton's steps on the logarithm of the function.

    The start leaves the series out, which makes the function too small, so it lies below the
    root (for ``a`` about 0 it is as near); the logarithm is convex, so the steps rise to the root and never pass it.
    """
    if a <= -1:
        raise ValueError("the column form of the inverse needs an exponent above -1")
    start = F.exp(F.lit(-EULER) - y) if abs(a) < 1e-5 else F.pow(F.greatest(F.lit(math.gamma(a + 1)) - a * y, F.lit(1e-300)), F.lit(1 / a))

    def step(s: Column, _: Column) -> Column:
        value = upper_gamma_of(a, s.x)
        return F.struct((s.x + value * F.log(value / s.y) * F.exp(s.x - (a - 1) * F.log(s.x))).alias("x"), s.y.alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), F.struct(start.alias("x"), y.alias("y")), step, lambda s: s.x)


def time_integral(start: Column, end: Column | None, c: float, omega: float, tau: float) -> Column:
    """Column form of ``tapered_time_integral``."""
    if tau == math.inf:
        at = lambda t: F.pow(t + c, F.lit(-omega)) / omega if omega else -F.log(t + c)
        return at(start) if end is None else at(start) - at(end)
    total = upper_gamma_of(-omega, (start + c) / tau)
    if end is not None:
        total = total - upper_gamma_of(-omega, (end + c) / tau)
    return F.lit(math.exp(c / tau) * tau**-omega) * total


def delay_of(u: Column, c: float, omega: float, tau: float) -> Column:
    """Column form of ``tapered_delay_of``."""
    return inverse_upper_gamma_of(-omega, (1 - u) * F.lit(float(upper_gamma(-omega, np.array(c / tau))))) * tau - c


def delay_cdf(days: Column, c: float, omega: float, tau: float) -> Column:
    """Share of direct offspring that have come by a delay, tapered."""
    return time_integral(F.lit(0.0), days, c, omega, tau) / F.lit(float(tapered_time_integral(np.array([0.0]), None, c, omega, tau)[0]))


def kolmogorov_p(statistic: float, n1: int, n2: int | None = None) -> float:
    """Asymptotic p value of a Kolmogorov-Smirnov statistic of one or two samples."""
    n = n1 if n2 is None else n1 * n2 / (n1 + n2)
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * statistic
    if t < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def normal_p(z: float) -> float:
    """Two-sided p value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


#: Points of a mesh for the integral of a tapered decay.
MESH = 400_000


def integral_mesh(c: float, omega: float, tau: float, longest: float):
    """A function of delays up to ``longest``: the decay's integral from 0.

    Without a taper it is the closed form; with one, linear interpolation on ``MESH``
    points that are even in the logarithm of the delay plus c (relative error below 1e-9).
    """
    if tau == math.inf:
        return lambda dt: tapered_time_integral(np.array(0.0), dt, c, omega, tau)
    low, high = math.log(c), math.log(longest + c)
    x = np.linspace(low, high, MESH)
    y = tapered_time_integral(np.zeros(1), np.exp(x) - c, c, omega, tau)
    per = (MESH - 1) / (high - low)

    def of(dt: np.ndarray) -> np.ndarray:
        at = (np.log(np.asarray(dt, float) + c) - low) * per
        k = np.clip(at.astype(np.int64), 0, MESH - 2)
        return y[k] + (y[k + 1] - y[k]) * (at - k)

    return of


def delay_cdf(days: Column, c: float, omega: float, tau: float) -> Column:
    """Share of direct offspring that have come by a delay, tapered."""
    total = float(tapered_time_integral(np.array([0.0]), None, c, omega, tau)[0])

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        d = x.to_numpy(float)
        return pd.Series(tapered_time_integral(np.zeros(len(d)), d, c, omega, tau) / total)

    return run(days)


def kolmogorov_p_of(statistic: Column, n1: Column, n2: Column) -> Column:
    """``kolmogorov_p`` of two samples, as an expression."""
    n = n1.cast("double") * n2 / (n1 + n2)
    t = (F.sqrt(n) + 0.12 + F.lit(0.11) / F.sqrt(n)) * statistic
    odd = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + odd(k) * F.exp(F.lit(-2.0) * k * k * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))
