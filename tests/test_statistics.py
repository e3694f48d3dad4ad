"""Statistics against published values and direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import distributions as D
from tablewright.operators import associate as A
from tablewright.operators import charts, describe, normality
from tablewright.operators.profile import profile


@pytest.mark.parametrize(
    "got,wanted",
    [
        (D.chi_square_sf(3.841458820694124, 1), 0.05),
        (D.chi_square_sf(18.307038053275146, 10), 0.05),
        (D.student_two_sided(2.2281388519649385, 10), 0.05),
        (D.f_sf(4.9646027437307145, 1, 10), 0.05),
        (D.f_sf(2.6955, 3, 100), 0.05),
        (D.normal_quantile(0.975), 1.959963984540054),
        (D.normal_sf(1.6448536269514722), 0.05),
    ],
)
def test_distributions(got, wanted):
    assert got == pytest.approx(wanted, rel=2e-4)


def wilk(values):
    """W by Royston's weights, value by value."""
    values, n = np.sort(values), len(values)
    m = np.array([D.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last, before, phi = D.shapiro_weights_tail(n, float(m @ m), m[-1], m[-2])
        a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    if n > 5:
        a[-2], a[1] = before, -before
    return float(a @ values) ** 2 / float(((values - values.mean()) ** 2).sum())


def shapiro(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    return {r["test"]: r for r in normality.normality_tests(rows, ["v"]).collect()}["shapiro_wilk"]


def test_shapiro_wilk_textbook_weights(spark):
    """Body weights of eleven men (Shapiro and Wilk 1965): W = 0.79."""
    found = shapiro(spark, [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert found["statistic"] == pytest.approx(0.79, abs=0.002)
    assert 0.004 < found["p_value"] < 0.01


@pytest.mark.parametrize("size", [3, 4, 5, 6, 40, 9000])
def test_shapiro_wilk_of_any_size_with_ties(spark, small_blocks, size):
    values = [(i * 7919 % 1000) ** 2 / 1e3 if i % 3 else 5.0 for i in range(size)]
    found = shapiro(spark, values)
    assert found["statistic"] == pytest.approx(wilk(np.array(values)), rel=1e-9)
    assert (found["p_value"] is None) == (size > 5000)


@pytest.mark.parametrize("power", [1, 2])
def test_sums_of_normal_scores(power):
    n = 20_000
    scores = np.array([D.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]) ** power
    for low, t in ((0, n), (0, 1), (n - 1, 1), (10, 5000), (3000, 15_000), (9000, 2000), (0, 10_000), (19_000, 1000), (500, 300)):
        found = D.score_sums(np.array([low]), np.array([t]), np.array([n]), power)[0]
        assert found == pytest.approx(scores[low : low + t].sum(), rel=1e-9, abs=1e-8)


def test_normality_on_normal_scores(spark):
    scores = [(D.normal_quantile((i + 0.5) / 400),) for i in range(400)]
    found = {r["test"]: r for r in normality.normality_tests(spark.createDataFrame(scores, "v double"), ["v"]).collect()}
    assert set(found) == {"shapiro_wilk", "anderson_darling", "lilliefors", "jarque_bera", "dagostino_k2"}
    assert all(r["p_value"] > 0.5 for r in found.values())


def test_normality_gaps_large_path(spark, small_blocks):
    rows = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 701 / 7.0).alias("v"))
    v = np.sort(rows.toPandas()["v"].to_numpy())
    n = len(v)
    below = np.array([D.normal_cdf(z) for z in (v - v.mean()) / v.std(ddof=1)])
    i = np.arange(1, n + 1)
    a2 = -n - np.sum((2 * i - 1) * (np.log(below) + np.log(1 - below[::-1]))) / n
    d = max((i / n - below).max(), (below - (i - 1) / n).max())
    found = {r["test"]: r["statistic"] for r in normality.normality_tests(rows, ["v"]).collect()}
    assert found["anderson_darling"] == pytest.approx(a2, rel=1e-9)
    assert found["lilliefors"] == pytest.approx(d, rel=1e-9)


def test_contingency_of_a_known_table(spark):
    cells = {("m", "yes"): 20, ("m", "no"): 30, ("w", "yes"): 30, ("w", "no"): 20}
    rows = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    r = A.chi_square_stats(rows, [("a", "b")]).first()
    assert r["chi_square"] == pytest.approx(4.0) and r["cramers_v"] == pytest.approx(0.2)
    both = {(x["x"], x["y"]): x["p_value"] for x in A.categorical_association(rows, ["a", "b"]).collect()}
    assert both[("a", "b")] == pytest.approx(0.0455, abs=1e-4) and both[("a", "a")] == 0.0


def test_degenerate_groups_give_no_statistic(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 1.0), ("c", 1.0), ("d", 9.0)], "g string, v double")
    found = {r["test"] for r in A.group_tests(rows, ["v"], ["g"]).collect()}
    assert found.isdisjoint({"anova", "brown_forsythe", "welch_t"})


def test_group_tests_large_path(spark, small_blocks):
    hot = F.when(F.col("id") % 3 == 0, 4.0).otherwise(F.col("id") % 97 + F.col("id") % 4)
    rows = spark.range(0, 2400, 1, 4).select(hot.cast("double").alias("v"), (F.col("id") % 4).cast("string").alias("g"))
    pdf = rows.toPandas()
    found = {r["test"]: r for r in A.group_tests(rows, ["v"], ["g"]).collect()}
    pdf["r"] = pdf["v"].rank()
    n = len(pdf)
    s = sum(p["r"].sum() ** 2 / len(p) for _, p in pdf.groupby("g"))
    t = pdf["v"].value_counts()
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    assert found["kruskal_wallis"]["statistic"] == pytest.approx(h, rel=1e-9)
    pdf["z"] = (pdf["v"] - pdf.groupby("g")["v"].transform("median")).abs()
    means = pdf.groupby("g")["z"].transform("mean")
    between = sum(len(p) * (p["z"].mean() - pdf["z"].mean()) ** 2 for _, p in pdf.groupby("g")) / 3
    within = ((pdf["z"] - means) ** 2).sum() / (n - 4)
    assert found["brown_forsythe"]["statistic"] == pytest.approx(between / within, rel=1e-9)


def test_histogram_of_a_constant(spark):
    rows = spark.createDataFrame([(5.0,)] * 7, "v double")
    r = describe.histogram(rows, describe.numeric_records(rows, ["v"])).collect()
    assert [(x["start"], x["end"], x["count"]) for x in r] == [(5.0, 5.0, 7)]


def test_empty_bins_survive(spark):
    rows = spark.createDataFrame([(0.0,)] * 30 + [(100.0,)], "v double")
    r = describe.histogram(rows, describe.numeric_records(rows, ["v"])).orderBy("bin").collect()
    assert sum(x["count"] for x in r) == 31 and sum(x["count"] == 0 for x in r) == len(r) - 2


@pytest.mark.parametrize("days,wanted", [(800, "month"), (200, "week"), (5, "day"), (0.2, "hour"), (0.01, "minute")])
def test_granularity(spark, days, wanted):
    rows = spark.createDataFrame([(0,), (int(days * 86_400_000),)], "ms bigint").select(F.timestamp_millis("ms").alias("t"))
    assert describe.datetime_summary(rows, ["t"]).first()["granularity"] == wanted


def test_chart_kinds_are_fixed(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("bb").alias("s"), (F.col("id") % 2).alias("bit"))
    kinds = charts.chart_kinds(profile(rows))
    assert kinds["id"] == ["histogram", "line"] and kinds["bit"][0] == "bar" and kinds["s"][0] == "bar"


def test_k2_matches_definition():
    assert normality.jarque_bera(600, 0.0, 1.0) == (25.0, math.exp(-12.5))
    assert normality.dagostino_k2(7, 0.1, 0.1) is None


def test_rank_correlations_with_and_without_gaps(spark, small_blocks):
    """Columns ranked once and pairs with their own ranks, against ranks by hand."""
    from tablewright.operators import correlate

    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (900, 4)).astype(float)
    x[:, 1] = np.round(x[:, 0] / 3 + rng.normal(size=900))
    holes = rng.random((900, 4)) < [0, 0, 0, 0.2]
    rows = [[None if h else float(v) for v, h in zip(r, hole)] for r, hole in zip(x, holes)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    got = correlate.spearman_pairs(df, ["a", "b", "c", "d"])

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v) + np.searchsorted(order, v, side="right") + 1) / 2

    for i in range(4):
        for j in range(i + 1, 4):
            both = ~(holes[:, i] | holes[:, j])
            want = np.corrcoef(ranks(x[both, i]), ranks(x[both, j]))[0, 1]
            value, n = got["abcd"[i], "abcd"[j]]
            assert n == both.sum() and value == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("broadcast", [10_000, 1])
def test_large_groups_are_spread_over_tasks(spark, monkeypatch, broadcast):
    """No join puts the rows of a large group into one task, and the statistics stay the same."""
    from tablewright.operators import associate as A
    from tablewright.plans import ranks

    rows = spark.range(0, 4000, 1, 4).select(
        (F.col("id") * 37 % 1009).cast("double").alias("v"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise("all").alias("g")
    )
    pairs = [("v", "g")]
    values = A.grouped_values(rows, pairs)
    moments = A.group_moments(values)
    wanted = A.brown_forsythe_stats(values, moments, 4000).collect(), sorted(A.rank_sums(values, moments, 4000).collect())
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 300)
    monkeypatch.setattr(ranks, "MOST_BROADCAST", broadcast)
    found = A.brown_forsythe_stats(values, moments, 4000).collect(), sorted(A.rank_sums(values, moments, 4000).collect())
    for a, b in zip(wanted, found, strict=True):
        assert len(a) == len(b) and all(x == pytest.approx(y) for r, t in zip(a, b, strict=True) for x, y in zip(r, t, strict=True))
    facts = moments.select("pair", "g", F.col("n").alias("size"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = ranks.join_groups(values.repartition(4), facts, ["pair", "g"], "size").where("g = 'all'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 2000


def test_group_tests_fold_the_values_once(spark, monkeypatch):
    """Ranks and medians read stored counts of values; the rows are read for these, the moments, the borders and the gaps."""
    from tablewright.operators import associate as A
    from tablewright.plans import ranks

    seen = spark.sparkContext.accumulator(0)

    def noted(i):
        seen.add(1)
        return float(i * 37 % 101)

    def rows(v):
        return spark.range(1200, numPartitions=3).select(v.alias("v"), F.concat(F.lit("g"), F.col("id") % 3).alias("g"), F.concat(F.lit("h"), F.col("id") % 2).alias("h"))

    plain = F.expr("double(id * 37 % 101)")
    wanted = sorted(A.group_tests(rows(plain), ["v"], ["g", "h"]).collect())
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100)
    found = sorted(A.group_tests(rows(F.udf(noted, "double")("id")), ["v"], ["g", "h"]).collect())
    assert seen.value <= 4 * 1200
    assert [r["test"] for r in found] == [r["test"] for r in wanted] and len(found) == 6
    for a, b in zip(found, wanted, strict=True):
        assert (a["statistic"], a["p_value"]) == pytest.approx((b["statistic"], b["p_value"]))
