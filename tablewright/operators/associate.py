"""Association between categories, and between numbers and categories.

Every function treats all requested pairs in one job, in long form keyed by ``pair``. No table
of a pair is gathered: counts, totals and ranks are joined, and only the final statistic of a
pair reaches the driver for its p-value.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import distributions as D
from tablewright.plans.aggregates import col
from tablewright.plans.orderstats import numeric
from tablewright.plans.ranks import group_quantiles, join_groups, range_splits, rank_values
from tablewright.session import cut_lineage

# ---------------------------------------------------------------- categorical pairs


def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(pair, a, b, n)``: counts of value pairs, rows with a null on either side left out."""
    cells = [
        F.struct(F.lit(i).alias("pair"), col(a).cast("string").alias("a"), col(b).cast("string").alias("b"))
        for i, (a, b) in enumerate(pairs)
    ]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return (
        rows.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("pair", "a", "b").agg(F.count("*").alias("n"))
    )


def chi_square_stats(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(pair, n, rows, columns, chi_square, cramers_v)`` of pairs with at least 2 x 2 levels."""
    table = contingency(df, pairs)
    a = table.groupBy("pair", "a").agg(F.sum("n").alias("na"))
    b = table.groupBy("pair", "b").agg(F.sum("n").alias("nb"))
    levels_a = a.groupBy("pair").agg(F.count("*").alias("rows"), F.sum("na").alias("total"))
    levels_b = b.groupBy("pair").agg(F.count("*").alias("columns"))
    n = F.col("n").cast("double")
    share = table.join(a, ["pair", "a"]).join(b, ["pair", "b"])
    sums = share.groupBy("pair").agg(F.sum(n * n / (F.col("na").cast("double") * F.col("nb"))).alias("s"))
    chi = F.greatest(F.lit(0.0), F.col("total") * (F.col("s") - 1))
    least = F.least(F.col("rows"), F.col("columns")) - 1
    return (
        sums.join(levels_a, "pair")
        .join(levels_b, "pair")
        .where("rows >= 2 and columns >= 2")
        .select(
            "pair", F.col("total").alias("n"), "rows", "columns",
            chi.alias("chi_square"), F.sqrt(chi / (F.col("total") * least)).alias("cramers_v"),
        )
    )


def categorical_association(df: DataFrame, names: list[str]) -> DataFrame:
    """``(x, y, chi_square, p_value, cramers_v)`` for all pairs, both triangles and the diagonal."""
    pairs = list(combinations(names, 2))
    rows = [(n, n, 0.0, 0.0, 1.0) for n in names]
    found = {}
    if pairs:
        found = {r["pair"]: r for r in chi_square_stats(df, pairs).collect()}  # one row per pair
    for i, (a, b) in enumerate(pairs):
        if i in found:
            r = found[i]
            p = D.chi_square_sf(r["chi_square"], (r["rows"] - 1) * (r["columns"] - 1))
            values = (r["chi_square"], p, r["cramers_v"])
        else:
            values = (0.0, 1.0, 0.0)
        rows += [(a, b, *values), (b, a, *values)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, chi_square double, p_value double, cramers_v double")


# ---------------------------------------------------------------- number by category


def grouped_values(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(pair, g, v)``: filled numbers with their filled category."""
    cells = [
        F.struct(F.lit(i).alias("pair"), col(cat).cast("string").alias("g"), numeric(num).alias("v"))
        for i, (num, cat) in enumerate(pairs)
    ]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.where(F.col("g").isNotNull() & F.col("v").isNotNull())


def group_moments(values: DataFrame) -> DataFrame:
    """``(pair, g, n, mean, var)`` of groups with at least two values."""
    return (
        values.groupBy("pair", "g")
        .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
        .where("n >= 2")
    )


def variance_ratio(moments: DataFrame) -> DataFrame:
    """Sums of squares between and within groups: ``(pair, k, n, ss_between, ss_within)``."""
    whole = moments.groupBy("pair").agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre")
    )
    gap = F.col("mean") - F.col("centre")
    # One row per pair: the number of pairs is bounded by the columns, not by the data.
    joined = moments.join(F.broadcast(whole), "pair")
    return joined.groupBy("pair").agg(
        F.first("k").alias("k"),
        F.first("total").alias("n"),
        F.sum(F.col("n") * gap * gap).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
    )


def welch_anova_stats(moments: DataFrame) -> DataFrame:
    """``(pair, k, f, df1, df2, effect_size)``; eta squared is the effect size."""
    # A group without variance has no weight: its pair has no Welch statistic.
    weighted = moments.withColumn("w", F.try_divide(F.col("n").cast("double"), "var"))
    whole = weighted.groupBy("pair").agg(
        F.count("*").alias("k"),
        F.count("w").alias("weighted"),
        F.sum("w").alias("sum_w"),
        F.try_divide(F.sum(F.col("w") * F.col("mean")), F.sum("w")).alias("centre"),
    ).where("k = weighted and k >= 2")
    joined = weighted.join(F.broadcast(whole), "pair")
    gap, rest = F.col("mean") - F.col("centre"), 1 - F.col("w") / F.col("sum_w")
    parts = joined.groupBy("pair").agg(
        F.first("k").alias("k"),
        F.sum(F.col("w") * gap * gap).alias("between"),
        F.sum(rest * rest / (F.col("n") - 1)).alias("spread"),
    )
    k = F.col("k").cast("double")
    squares = variance_ratio(moments).select(
        "pair", F.try_divide("ss_between", F.col("ss_between") + F.col("ss_within")).alias("effect_size")
    )
    return parts.join(squares, "pair").select(
        "pair", "k",
        (F.col("between") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("spread"))).alias("f"),
        (k - 1).alias("df1"),
        ((k * k - 1) / (3 * F.col("spread"))).alias("df2"),
        "effect_size",
    )


def welch_t_stats(moments: DataFrame) -> DataFrame:
    """``(pair, t, df)`` of pairs with exactly two groups, the smaller group name first."""
    def of(side, field):
        pick = (F.min_by if side == "first" else F.max_by)(field, "g")
        return pick.alias(f"{side}_{field}")

    two = moments.groupBy("pair").agg(
        F.count("*").alias("k"), *[of(s, f) for s in ("first", "last") for f in ("n", "mean", "var")]
    ).where("k = 2")
    a, b = F.col("first_var") / F.col("first_n"), F.col("last_var") / F.col("last_n")
    return two.select(
        "pair",
        F.try_divide(F.col("first_mean") - F.col("last_mean"), F.sqrt(a + b)).alias("t"),
        F.try_divide((a + b) * (a + b), a * a / (F.col("first_n") - 1) + b * b / (F.col("last_n") - 1)).alias("df"),
    )


def value_cells(values: DataFrame) -> DataFrame:
    """``(pair, g, v, n)``: the distinct values of each group with their counts."""
    return values.groupBy("pair", "g", "v").agg(F.count("*").alias("n"))


def rank_sums(
    values: DataFrame, moments: DataFrame, rows: int, splits: list[float] | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """``(pair, g, n, rank_sum, ties)``: rank sums per group over a pair's groups, ties averaged.

    ``ties`` is the sum of t^3 - t over the tied values of the pair. ``cells`` are the
    ``value_cells``, where the caller has them already.
    """
    splits = range_splits(values, F.col("v"), rows) if splits is None else splits
    usable = moments.select("pair", "g", F.col("n").alias("size"))
    counted = join_groups(value_cells(values) if cells is None else cells, usable, ["pair", "g"], "size").drop("size")
    # Both the ties and the sums read the ranks.
    ranked = cut_lineage(rank_values(counted, ["pair"], "v", "n", splits).select("pair", "v", "ties", "rank"))
    t = F.col("ties").cast("double")
    tied = ranked.groupBy("pair").agg(F.sum(t * t * t - t).alias("ties"))
    sums = (
        counted.join(ranked.select("pair", "v", "rank"), ["pair", "v"])
        .groupBy("pair", "g")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    )
    return sums.join(F.broadcast(tied), "pair")  # one row per pair


def mann_whitney_stats(sums: DataFrame) -> DataFrame:
    """``(pair, u, z)`` of two groups: U of the smaller group name, z with continuity and ties."""
    two = sums.groupBy("pair").agg(
        F.count("*").alias("k"),
        F.min_by("n", "g").alias("n1"), F.max_by("n", "g").alias("n2"),
        F.min_by("rank_sum", "g").alias("r1"), F.first("ties").alias("ties"),
    ).where("k = 2")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    return two.select("pair", u.alias("u"), z.alias("z"))


def kruskal_stats(sums: DataFrame) -> DataFrame:
    """``(pair, h, df)`` with tie correction."""
    parts = sums.groupBy("pair").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.first("ties").alias("ties"),
    )
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (n * n * n - n)
    return parts.select("pair", "k", F.try_divide(h, fix).alias("h"), (F.col("k") - 1).cast("double").alias("df"))


def brown_forsythe_stats(
    values: DataFrame, moments: DataFrame, rows: int, splits: list[float] | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """``(pair, f, df1, df2)`` on absolute deviations from the group medians."""
    medians = group_quantiles(values, ["pair", "g"], "v", [0.5], rows, splits, cells)
    usable = medians.join(moments.select("pair", "g", F.col("n").alias("size")), ["pair", "g"])
    gaps = join_groups(values, usable, ["pair", "g"], "size").select(
        "pair", "g", F.abs(F.col("v") - F.get("quantiles", F.lit(0))).alias("v")
    )
    squares = variance_ratio(cut_lineage(group_moments(gaps)))
    between = F.try_divide(F.col("ss_between"), F.col("k") - 1)
    within = F.try_divide(F.col("ss_within"), F.col("n") - F.col("k"))
    return squares.where("k >= 2 and n > k and ss_within > 0").select(
        "pair", F.try_divide(between, within).alias("f"), (F.col("k") - 1).cast("double").alias("df1"),
        (F.col("n") - F.col("k")).cast("double").alias("df2"),
    )


TESTS_SCHEMA = (
    "numeric_column string, categorical_column string, test string, statistic double, df1 double, df2 double, "
    "p_value double, effect_size double"
)


def group_tests(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """All tests of numbers against categories.

    Two groups get Welch's t and Mann-Whitney, more get Welch's ANOVA and Kruskal-Wallis; all
    get Brown-Forsythe. Groups of one value are left out.
    """
    pairs = [(n, c) for n in numbers for c in categories if n != c]
    if not pairs:
        return df.sparkSession.createDataFrame([], TESTS_SCHEMA)
    values = grouped_values(df, pairs)
    rows = df.count() * len(pairs)
    # All are read by several statistics below; moments and sums are far smaller than the rows.
    moments = cut_lineage(group_moments(values))
    # Borders only have to even out the buckets, so a number is read once and not for each of its categories.
    once = df.select(F.explode(F.array(*[numeric(n) for n in numbers])).alias("v"))
    splits = range_splits(once, F.col("v"), rows)
    cells = cut_lineage(value_cells(values))
    sums = cut_lineage(rank_sums(values, moments, rows, splits, cells))
    out = []

    def add(pair: int, test: str, statistic, df1, df2, p, effect=None) -> None:
        if statistic is not None and math.isfinite(statistic):
            out.append((*pairs[pair], test, float(statistic), df1, df2, p, effect))

    # Each result below has one row per pair.
    for r in welch_t_stats(moments).collect():
        if r["t"] is not None:
            add(r["pair"], "welch_t", r["t"], r["df"], None, D.student_two_sided(r["t"], r["df"]))
    for r in mann_whitney_stats(sums).collect():
        p = None if r["z"] is None else min(1.0, 2.0 * D.normal_sf(r["z"]))
        add(r["pair"], "mann_whitney", r["u"], None, None, p)
    for r in welch_anova_stats(moments).where("k > 2").collect():
        if r["f"] is not None and math.isfinite(r["f"]):
            add(r["pair"], "anova", r["f"], r["df1"], r["df2"], D.f_sf(r["f"], r["df1"], r["df2"]), r["effect_size"])
    for r in kruskal_stats(sums).where("k > 2").collect():
        if r["h"] is not None:
            add(r["pair"], "kruskal_wallis", r["h"], r["df"], None, D.chi_square_sf(r["h"], r["df"]))
    for r in brown_forsythe_stats(values, moments, rows, splits, cells).collect():
        add(r["pair"], "brown_forsythe", r["f"], r["df1"], r["df2"], D.f_sf(r["f"], r["df1"], r["df2"]))
    return df.sparkSession.createDataFrame(out, TESTS_SCHEMA)
