"""Tests of normality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import distributions as D
from tablewright.plans.aggregates import measure
from tablewright.plans.orderstats import numeric
from tablewright.plans.ranks import range_splits, running_totals

SHAPIRO_ROWS = 5000  # fixed value: largest sample the p-value holds for; W is given for any
TEST_SCHEMA = "column string, test string, n bigint, statistic double, p_value double"


def jarque_bera(n: int, skew: float, kurt: float) -> tuple[float, float]:
    """Statistic and p-value from population skewness and excess kurtosis."""
    jb = n / 6.0 * (skew**2 + kurt**2 / 4.0)
    return jb, math.exp(-jb / 2.0)


def dagostino_k2(n: int, skew: float, kurt: float) -> tuple[float, float] | None:
    """D'Agostino (1970) skewness and Anscombe-Glynn (1983) kurtosis scores, combined."""
    if n < 8:
        return None
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = -6.0 / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (kurt - mean) / math.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    term = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(term) ** (1 / 3), term)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2.0)


def shapiro_wilk(n: int, spread: float, scored: float, ends: tuple[float, float, float, float]) -> tuple[float, float | None] | None:
    """W and p (Royston 1995; none beyond 5000 values) from sums over the ranked values.

    ``spread`` is the sum of squared distances from the mean, ``scored`` that of distance times
    normal score, ``ends`` the two smallest and the two largest values.
    """
    if n < 3 or not spread > 0:
        return None
    if n == 3:
        weighted = math.sqrt(0.5) * (ends[3] - ends[0])
    else:
        last_score, before_score = (D.normal_quantile((n - k - 0.375) / (n + 0.25)) for k in (0, 1))
        norm2 = float(D.score_sums(np.array([0]), np.array([n]), np.array([n]), 2)[0])
        last, before, phi = D.shapiro_weights_tail(n, norm2, last_score, before_score)
        outer, next_ = ends[3] - ends[0], ends[2] - ends[1]
        if n > 5:
            weighted = (scored - last_score * outer - before_score * next_) / math.sqrt(phi) + last * outer + before * next_
        else:
            weighted = (scored - last_score * outer) / math.sqrt(phi) + last * outer
    w = min(1.0, weighted**2 / spread)
    return w, D.shapiro_p(w, n) if n <= SHAPIRO_ROWS else None


def distribution_gaps(df: DataFrame, names: list[str], moments: dict, sizes: dict[str, int]) -> DataFrame:
    """``(column, n, a2, d, scored, first, second, last_but_one, last)``: statistics against a fitted normal.

    ``a2`` and ``d`` are those of Anderson-Darling and Kolmogorov; ``scored`` and the outermost
    values are what ``shapiro_wilk`` needs.

    Values are folded to distinct ones and given the count of smaller values; copies of a value
    enter in closed form, so neither a hot value nor a large column gathers in one task.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column"), numeric(n).alias("value")) for n in names])
    rows = df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where(F.col("value").isNotNull())
    splits = range_splits(rows, F.col("value"), sum(sizes[n] for n in names))
    counted = rows.groupBy("column", "value").agg(F.count("*").alias("t"))
    placed = running_totals(counted, ["column"], "value", "t", splits)
    fitted = F.create_map(
        *[
            F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x))
            for n in names
            for x in (n, [float(sizes[n]), moments[(n, "mean")], moments[(n, "std")]])
        ]
    )[F.col("column")]
    size = F.get(fitted, F.lit(0))
    z = (F.col("value") - F.get(fitted, F.lit(1))) / F.get(fitted, F.lit(2))
    scored = placed.select(
        "column", "value", "t", "before", size.alias("n"), D.normal_cdf_column(z).alias("below"), D.normal_cdf_column(-z).alias("above"),
        (D.score_sums_column(F.col("before"), F.col("t"), size.cast("long")) * (F.col("value") - F.get(fitted, F.lit(1)))).alias("scored"),
    )
    upto = F.col("before") + F.col("t")
    n = F.col("n")
    low = F.greatest(F.col("below"), F.lit(1e-300))
    high = F.greatest(F.col("above"), F.lit(1e-300))
    # Sums of (2i - 1) and of 2(n - i) + 1 over the ranks i of the copies of one value.
    part = (upto * upto - F.col("before") * F.col("before")) * F.log(low) + (
        (n - F.col("before")) * (n - F.col("before")) - (n - upto) * (n - upto)
    ) * F.log(high)
    gap = F.greatest(upto / n - F.col("below"), F.col("below") - F.col("before") / n)
    holds = [F.min(F.when((F.col("before") <= i) & (upto > i), F.col("value"))) for i in (F.lit(0), F.lit(1), n - 2, n - 1)]
    return scored.groupBy("column", "n").agg(
        (-F.first("n") - F.sum(part) / F.first("n")).alias("a2"), F.max(gap).alias("d"), F.sum("scored").alias("scored"),
        *[c.alias(a) for c, a in zip(holds, ("first", "second", "last_but_one", "last"), strict=True)],
    )


def normality_tests(df: DataFrame, names: list[str]) -> DataFrame:
    """Shapiro-Wilk, Anderson-Darling, Lilliefors, Jarque-Bera and D'Agostino per column."""
    calls = {}
    for n in names:
        v = numeric(n)
        calls |= {
            (n, "n"): F.count(v), (n, "mean"): F.avg(v), (n, "std"): F.stddev_samp(v),
            (n, "skew"): F.skewness(v), (n, "kurt"): F.kurtosis(v),
        }
    seen = measure(df, calls)
    sizes = {n: seen[(n, "n")] for n in names}
    usable = [n for n in names if sizes[n] >= 3 and seen[(n, "std")]]
    out = []
    if usable:
        for r in distribution_gaps(df, usable, seen, sizes).collect():  # one row per column
            n = r["column"]
            found = shapiro_wilk(sizes[n], seen[(n, "std")] ** 2 * (sizes[n] - 1), r["scored"], tuple(r[e] for e in ("first", "second", "last_but_one", "last")))
            if found:
                out.append((n, "shapiro_wilk", sizes[n], *found))
            out.append((n, "anderson_darling", sizes[n], r["a2"], min(1.0, max(0.0, D.anderson_darling_p(r["a2"], sizes[n])))))
            out.append((n, "lilliefors", sizes[n], r["d"], min(1.0, max(0.0, D.lilliefors_p(r["d"], sizes[n])))))
    for n in usable:
        out.append((n, "jarque_bera", sizes[n], *jarque_bera(sizes[n], seen[(n, "skew")], seen[(n, "kurt")])))
        k2 = dagostino_k2(sizes[n], seen[(n, "skew")], seen[(n, "kurt")])
        if k2:
            out.append((n, "dagostino_k2", sizes[n], *k2))
    return df.sparkSession.createDataFrame(out, TEST_SCHEMA)
