"""Distribution functions of one test statistic, evaluated on the driver.

No statistics library is available, so these follow the published series and continued
fractions (regularised incomplete gamma and beta functions) and, for the normality tests,
the published p-value approximations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _continued_fraction(next_pair: Callable[[int], tuple[float, float]], start: float) -> float:
    """Modified Lentz evaluation of start + a1/(b1 + a2/(b2 + ...))."""
    f = start or _TINY
    c, d = f, 0.0
    for i in range(1, 1000):
        a, b = next_pair(i)
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1.0 / d
        step = c * d
        f *= step
        if abs(step - 1.0) < 1e-15:
            break
    return f


def gamma_sf(shape: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(shape, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        k = shape
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tail = _continued_fraction(lambda i: (-i * (i - shape), x + 2 * i + 1 - shape), x + 1 - shape)
    return front / tail


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )

    def pair(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return front / (a * _continued_fraction(pair, 1.0))


def chi_square_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def student_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def f_sf(x: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def normal_quantile(p: float) -> float:
    """Inverse of the normal CDF, by Newton steps from a logistic start."""
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    if p > 0.5:
        return -normal_quantile(1.0 - p)
    z = -math.sqrt(-2.0 * math.log(p)) if p < 0.02 else math.log(p / (1.0 - p)) / 1.702
    for _ in range(60):
        density = math.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
        error = normal_cdf(z) - p
        step = error / density if density else 0.0
        step /= 1.0 + z * step / 2.0
        z -= step
        if abs(step) < 1e-14 * max(1.0, abs(z)):
            break
    return z


_UNIT = NormalDist()
NEAR = 256  # outermost ranks that are never integrated


def score_sums(before: np.ndarray, times: np.ndarray, n: np.ndarray, power: int = 1) -> np.ndarray:
    """Sums of the normal scores of ranks ``before + 1`` to ``before + times`` among ``n``, or of their squares.

    The score of rank i is the normal quantile at (i - 0.375) / (n + 0.25). Few ranks, and the
    ``NEAR`` outermost on either side, are added one by one; between them the sum is an integral,
    which is closed, with the first Euler-Maclaurin term.
    """
    out = np.zeros(len(before))
    for k, (low, t, size) in enumerate(zip(before.tolist(), times.tolist(), n.tolist(), strict=True)):
        high, wide, scores = low + t, size + 0.25, []
        inner = (max(low, NEAR), min(high, size - NEAR)) if t > NEAR else (high, high)
        if inner[1] - inner[0] < NEAR:
            inner = (high, high)
        for i in (*range(int(low), int(inner[0])), *range(int(inner[1]), int(high))):
            scores.append(_UNIT.inv_cdf((i + 0.625) / wide))
        out[k] = sum(s**power for s in scores)
        if inner[0] < inner[1]:
            ends = []
            for i in inner:
                u = (i + 0.125) / wide
                q = _UNIT.inv_cdf(u)
                density = _UNIT.pdf(q)
                ends.append((-density, 1 / density) if power == 1 else (u - q * density, 2 * q / density))
            out[k] += wide * (ends[1][0] - ends[0][0]) - (ends[1][1] - ends[0][1]) / (24 * wide)
    return out


def score_sums_column(before: Column, times: Column, n: Column) -> Column:
    """``score_sums`` of columns, through Arrow."""

    @F.pandas_udf("double")
    def summed(b: pd.Series, t: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(score_sums(b.to_numpy(), t.to_numpy(), size.to_numpy()))

    return summed(before, times, n)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation coefficient over n pairs."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def anderson_darling_p(a2: float, n: int) -> float:
    """D'Agostino and Stephens (1986), both parameters estimated."""
    a = a2 * (1.0 + 0.75 / n + 2.25 / n**2)
    if a >= 10.0:
        return 3.7e-24  # the approximation ends here
    if a >= 0.6:
        return math.exp(1.2937 - 5.709 * a + 0.0186 * a * a)
    if a >= 0.34:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    if a >= 0.2:
        return 1.0 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    return 1.0 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)


def lilliefors_p(d: float, n: int) -> float:
    """Dallal and Wilkinson (1986) below 0.1; Stephens' modified statistic above."""
    kd, nd = (d, n) if n <= 100 else (d * (n / 100.0) ** 0.49, 100)
    p = math.exp(
        -7.01256 * kd**2 * (nd + 2.78019)
        + 2.99587 * kd * math.sqrt(nd + 2.78019)
        - 0.122119
        + 0.974598 / math.sqrt(nd)
        + 1.67997 / nd
    )
    if p <= 0.1:
        return p
    k = (math.sqrt(n) - 0.01 + 0.85 / math.sqrt(n)) * d
    if k <= 0.302:
        return 1.0
    if k <= 0.5:
        return 2.76773 - 19.828315 * k + 80.709644 * k**2 - 138.55152 * k**3 + 81.218052 * k**4
    if k <= 0.9:
        return -4.901232 + 40.662806 * k - 97.490286 * k**2 + 94.029866 * k**3 - 32.355711 * k**4
    if k <= 1.31:
        return 6.198765 - 19.558097 * k + 23.186922 * k**2 - 12.234627 * k**3 + 2.423045 * k**4
    return 0.0


def shapiro_weights_tail(n: int, norm2: float, m_last: float, m_before: float) -> tuple[float, float, float]:
    """Royston (1992, 1995): the two outermost weights and the scale of the others.

    ``norm2`` is the sum of squared normal scores; ``m_last`` and ``m_before`` the two largest.
    """
    u = 1.0 / math.sqrt(n)
    c = math.sqrt(norm2)
    last = m_last / c + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    if n <= 5:
        phi = (norm2 - 2 * m_last**2) / (1 - 2 * last**2)
        return last, m_before / math.sqrt(phi), phi
    before = (
        m_before / c + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    )
    phi = (norm2 - 2 * m_last**2 - 2 * m_before**2) / (1 - 2 * last**2 - 2 * before**2)
    return last, before, phi


def shapiro_p(w: float, n: int) -> float:
    """Royston (1995) p-value of the Shapiro-Wilk statistic, 3 <= n <= 5000."""
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return max(0.0, p)
    y = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return 0.0
        y = -math.log(g - y)
        mean = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        k = math.log(n)
        mean = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        sd = math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return normal_sf((y - mean) / sd)


def normal_cdf_column(z: Column) -> Column:
    """The normal CDF of a column; Spark has no error function, so values go through Arrow."""

    @F.pandas_udf("double")
    def cdf(s: pd.Series) -> pd.Series:
        scaled = (-s.to_numpy(dtype=float) / math.sqrt(2.0)).tolist()
        return pd.Series([0.5 * math.erfc(x) for x in scaled], dtype=float)

    return cdf(z)
