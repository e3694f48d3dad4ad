"""Exploratory statistics and chart data."""

from pyspark.sql import functions as F

from checks.profiling import TAILS, index_sql, tails
from checks.registry import GAPS, SQL, gaps, query, rounded, table, union_all
from tablewright.operators import associate as A
from tablewright.operators import charts, correlate, describe, normality
from tablewright.operators.impute import indicator_fill, median_fill
from tablewright.operators.profile import profile, profile_frame
from tablewright.plans.analysis import analyze
from tablewright.plans.orderstats import index_quantiles, interpolated_quantiles

G = f"WITH g AS (SELECT {GAPS} FROM orders) "
T = f"WITH t AS ({TAILS}) "
COLUMNS = ["o_orderkey", "total", "cust", "status", "priority", "placed"]
PRICES = ["price", "quantity"]


def lines(spark, folder):
    return table(spark, folder, "lineitem")


@query(
    "table_summary",
    G + "SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns, CAST(sum(8 + 8 + 8 + 8 + coalesce(strlen(status), 0) + coalesce(strlen(priority), 0)) AS BIGINT) AS memory_bytes, "
    "CAST(0 AS BIGINT) AS duplicate_count, 0.0::DOUBLE AS duplicate_percentage, 6 * count(*) - ("
    + " + ".join(f"count({c})" for c in COLUMNS) + ") AS missing_cells, round(100.0 * (6 * count(*) - (" + " + ".join(f"count({c})" for c in COLUMNS)
    + ")) / (6 * count(*)), 6) AS missing_percentage FROM g",
)
def _(spark, folder):
    return rounded(describe.table_summary(gaps(spark, folder)))


@query(
    "type_distribution",
    "SELECT * FROM (VALUES ('numeric', CAST(4 AS BIGINT), 66.666667::DOUBLE), ('string', CAST(1 AS BIGINT), 16.666667::DOUBLE), ('datetime', CAST(1 AS BIGINT), 16.666667::DOUBLE)) "
    "AS t(inferred_type, count, percentage)",
)
def _(spark, folder):
    d = table(spark, folder, "events").drop("props").withColumn("user_code", F.col("user_id") + 1)
    return rounded(describe.type_distribution(profile_frame(d, profile(d, duplicates=False))))


_V = "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM t WHERE {c} IS NOT NULL"
_SUMMARY = (
    "SELECT \"column\", count(*) AS n, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median, "
    "round(stddev_samp(v), 4) AS std, round(var_samp(v), 2) AS variance, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3, "
    "round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr FROM (" + _V + ") GROUP BY \"column\""
)


@query("numeric_summary", T + union_all(_SUMMARY, PRICES))
def _(spark, folder):
    full = describe.numeric_summary(tails(spark, folder), PRICES)
    return rounded(full.select("column", "n", "min", "max", "mean", "median", "std", "variance", "q1", "q3", "iqr"), 4, variance=2)


_MOMENTS = (
    "SELECT \"column\", round(sum(power((v - m) / s, 3)) / count(*), 6) AS skewness, round(sum(power((v - m) / s, 4)) / count(*) - 3, 6) AS kurtosis "
    "FROM (" + _V + "), (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM t) GROUP BY \"column\""
)


@query("skewness_kurtosis", T + union_all(_MOMENTS, PRICES))
def _(spark, folder):
    records = describe.numeric_records(tails(spark, folder), PRICES, outliers=False)
    rows = [(x["column"], x["skewness"], x["kurtosis"]) for x in records]
    return rounded(spark.createDataFrame(rows, "column string, skewness double, kurtosis double"))


_OUT = (
    "SELECT \"column\", count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS iqr_outliers, "
    "count(CASE WHEN 0.6745 * abs(v - med) / mad > 3.5 THEN 1 END) AS robust_outliers FROM (" + _V + "), "
    "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, median({c}) AS med FROM t), "
    "(SELECT median(abs({c} - (SELECT median({c}) FROM t))) AS mad FROM t) GROUP BY \"column\""
)


@query("outlier_counts", T + union_all(_OUT, PRICES))
def _(spark, folder):
    return describe.numeric_summary(tails(spark, folder), PRICES).select("column", "iqr_outliers", "robust_outliers")


def histogram_sql(source: str, c: str, limit: int) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(b AS INTEGER) AS bin, round(lo + b * w, 4) AS start, round(lo + (b + 1) * w, 4) AS \"end\", coalesce(n, 0) AS count "
        f"FROM (SELECT lo, (hi - lo) / k AS w, unnest(range(k)) AS b FROM h) LEFT JOIN "
        f"(SELECT least(CAST(floor((v - lo) / ((hi - lo) / k)) AS BIGINT), k - 1) AS b, count(*) AS n FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source}), h GROUP BY 1) USING (b)"
    )


def bins_sql(source: str, c: str, limit: int) -> str:
    return (
        f"SELECT lo, hi, CAST(greatest(5, least({limit}, CASE WHEN iqr > 0 THEN ceil((hi - lo) / (2 * iqr / power(n, 1 / 3.0))) ELSE ceil(log2(n)) + 1 END)) AS BIGINT) AS k "
        f"FROM (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source}))"
    )


@query("histogram", T + ", h AS (" + bins_sql("t", "price", 32) + ") " + histogram_sql("t", "price", 32))
def _(spark, folder):
    t = tails(spark, folder)
    return rounded(describe.histogram(t, describe.numeric_records(t, ["price"], outliers=False)), 4)


@query(
    "box_plot",
    T + union_all("SELECT '{c}' AS \"column\", round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, "
                  "round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM t", PRICES),
)
def _(spark, folder):
    return rounded(describe.box_plot(tails(spark, folder), PRICES), 4)


# ---------------------------------------------------------------- normality

EVENTS = "SELECT event_id, value FROM events"
_CDF = (
    "CASE WHEN abs(z) > 7 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 140), "
    "lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (lgamma(k + 1.5) + (k + 1) * ln(2) - 0.5 * ln(pi()))))) END"
)
_FIT = (
    "WITH s AS (SELECT l_quantity AS v, count(*) AS t FROM lineitem GROUP BY 1), f AS (SELECT count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem), "
    "p AS (SELECT v, t, sum(t) OVER (ORDER BY v) AS upto, n, (v - m) / sd AS z FROM s, f), q AS (SELECT *, upto - t AS before, " + _CDF + " AS below FROM p) "
)


@query(
    "anderson_darling",
    _FIT + "SELECT 'l_quantity' AS \"column\", any_value(n) AS n, round(-any_value(n) - sum((power(upto, 2) - power(before, 2)) * ln(below) + "
    "(power(n - before, 2) - power(n - upto, 2)) * ln(1 - below)) / any_value(n), 3) AS statistic FROM q",
)
def _(spark, folder):
    t = normality.normality_tests(lines(spark, folder), ["l_quantity"]).where("test = 'anderson_darling'")
    return rounded(t.select("column", "n", "statistic"), 3)


@query(
    "lilliefors",
    _FIT + "SELECT 'l_quantity' AS \"column\", any_value(n) AS n, round(max(greatest(upto / n - below, below - before / n)), 6) AS statistic FROM q",
)
def _(spark, folder):
    t = normality.normality_tests(lines(spark, folder), ["l_quantity"]).where("test = 'lilliefors'")
    return rounded(t.select("column", "n", "statistic"))


_POP = "(SELECT count(*) AS n, sum(power(v - m, 3)) / count(*) / power(sum(power(v - m, 2)) / count(*), 1.5) AS g, sum(power(v - m, 4)) / count(*) / power(sum(power(v - m, 2)) / count(*), 2) - 3 AS k " \
    "FROM (SELECT value AS v FROM events), (SELECT avg(value) AS m FROM events))"


@query("jarque_bera", f"SELECT 'value' AS \"column\", n, round(n / 6.0 * (g * g + k * k / 4), 4) AS statistic, round(exp(-n / 12.0 * (g * g + k * k / 4)), 6) AS p_value FROM {_POP}")
def _(spark, folder):
    t = normality.normality_tests(table(spark, folder, "events"), ["value"]).where("test = 'jarque_bera'")
    return rounded(t.select("column", "n", "statistic", "p_value"), 4, p_value=6)


_K2 = (
    "SELECT *, g * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n * 1.0 * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b, "
    "(k + 6.0 / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / (power(n + 1.0, 2) * (n + 3) * (n + 5))) AS x, "
    "6.0 * (n * 1.0 * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS c FROM " + _POP
)


@query(
    "dagostino_k2",
    f"WITH a AS ({_K2}), w AS (SELECT *, sqrt(2 * (b - 1)) - 1 AS w2, 6 + 8 / c * (2 / c + sqrt(1 + 4 / (c * c))) AS a FROM a) "
    "SELECT 'value' AS \"column\", n, round(k2, 3) AS statistic, round(exp(-k2 / 2), 5) AS p_value FROM (SELECT n, power(asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)), 2) + "
    "power((1 - 2 / (9 * a) - sign((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) * power(abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))), 1 / 3.0)) / sqrt(2 / (9 * a)), 2) AS k2 FROM w)",
)
def _(spark, folder):
    t = normality.normality_tests(table(spark, folder, "events"), ["value"]).where("test = 'dagostino_k2'")
    return rounded(t.select("column", "n", "statistic", "p_value"), 3, p_value=5)


# The rational approximation of the normal quantile of algorithm AS 241 (PPND7).
_QUANTILE = """
CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) *
  (((59.109374720 * (0.180625 - (p - 0.5) ** 2) + 159.29113202) * (0.180625 - (p - 0.5) ** 2) + 50.434271938) * (0.180625 - (p - 0.5) ** 2) + 3.3871327179) /
  (((67.187563600 * (0.180625 - (p - 0.5) ** 2) + 78.757757664) * (0.180625 - (p - 0.5) ** 2) + 17.895169469) * (0.180625 - (p - 0.5) ** 2) + 1)
ELSE sign(p - 0.5) * (((0.17023821103 * r + 1.3067284816) * r + 2.7568153900) * r + 1.4234372777) / ((0.12021132975 * r + 0.73700164250) * r + 1) END
"""
_WILK = f"""
  SELECT x, n, i, (SELECT avg({{c}}) FROM {{t}}) AS mean, {_QUANTILE} AS m
  FROM (SELECT *, sqrt(-ln(least(p, 1 - p))) - 1.6 AS r FROM (
    SELECT {{c}} AS x, count(*) OVER () AS n, row_number() OVER (ORDER BY {{c}}) AS i, (row_number() OVER (ORDER BY {{c}}) - 0.375) / (count(*) OVER () + 0.25) AS p
    FROM {{t}}))
"""
_W = f"""
  SELECT '{{c}}' AS "column", n, round(power((scored - m1 * (x4 - x1) - m2 * (x3 - x2)) / sqrt(phi) + a1 * (x4 - x1) + a2 * (x3 - x2), 2) / spread, 5) AS statistic
  FROM (SELECT *, (norm2 - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM (
    SELECT *, m1 / sqrt(norm2) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS a1,
      m2 / sqrt(norm2) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS a2
    FROM (SELECT n, 1 / sqrt(n) AS u, sum(m * m) AS norm2, sum(m * (x - mean)) AS scored, sum((x - mean) ** 2) AS spread,
        max(CASE WHEN i = n THEN m END) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2, max(CASE WHEN i = 1 THEN x END) AS x1,
        max(CASE WHEN i = 2 THEN x END) AS x2, max(CASE WHEN i = n - 1 THEN x END) AS x3, max(CASE WHEN i = n THEN x END) AS x4
      FROM ({_WILK}) GROUP BY n)))
"""


@query("shapiro_wilk", " UNION ALL ".join(_W.format(c=c, t=t) for c, t in (("s_acctbal", "supplier"), ("l_extendedprice", "lineitem"), ("l_quantity", "lineitem"))))
def _(spark, folder):
    small = normality.normality_tests(table(spark, folder, "supplier"), ["s_acctbal"])
    large = normality.normality_tests(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(small.unionByName(large).where("test = 'shapiro_wilk'").select("column", "n", "statistic"), 5)


# ---------------------------------------------------------------- categories, texts, times

_COUNTED = "(SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)"


@query(
    "categorical_summary",
    union_all(
        "SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS total, count(*) AS cardinality, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, "
        "round(1 - sum(n * 1.0 * n) / (sum(n) * 1.0 * sum(n)), 6) AS gini, round(max(n) / min(n), 6) AS imbalance_ratio FROM " + _COUNTED,
        ["l_returnflag", "l_linestatus"],
    ),
)
def _(spark, folder):
    return rounded(describe.categorical_summary(lines(spark, folder), ["l_returnflag", "l_linestatus"]))


@query(
    "top_values",
    "SELECT 'p_name' AS \"column\", CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS place, v AS value, n AS count, "
    "round(100.0 * n / (SELECT count(*) FROM part), 6) AS percentage FROM (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, v LIMIT 20",
)
def _(spark, folder):
    return rounded(describe.top_values(table(spark, folder, "part"), ["p_name"]))


@query(
    "text_summary",
    "SELECT 'text' AS \"column\", count(*) AS n, min(strlen(text)) AS min_length, max(strlen(text)) AS max_length, round(avg(strlen(text)), 6) AS mean_length, "
    "round(median(strlen(text)), 6) AS median_length, 0.0::DOUBLE AS empty_percentage, 0.0::DOUBLE AS whitespace_percentage, "
    r"(SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '') AS unique_tokens FROM documents",
)
def _(spark, folder):
    return rounded(describe.text_summary(table(spark, folder, "documents"), ["text"]))


_LEN = "(SELECT strlen(text) AS length FROM documents)"


@query("length_histogram", "WITH h AS (" + bins_sql(_LEN, "length", 24) + ") " + histogram_sql(_LEN, "length", 24).replace("'length'", "'text'"))
def _(spark, folder):
    return rounded(describe.length_histogram(table(spark, folder, "documents"), ["text"]), 4)


@query(
    "datetime_summary",
    "SELECT 'ts' AS \"column\", epoch_us(min(ts)) // 1000 AS min_ms, epoch_us(max(ts)) // 1000 AS max_ms, round(((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) / 86400000.0, 6) AS range_days, "
    "'day' AS granularity FROM events UNION ALL SELECT 'o_orderdate', epoch_ms(min(o_orderdate)), epoch_ms(max(o_orderdate)), "
    "round((epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate))) / 86400000.0, 6), 'month' FROM orders",
)
def _(spark, folder):
    a = describe.datetime_summary(table(spark, folder, "events"), ["ts"])
    return rounded(a.unionByName(describe.datetime_summary(table(spark, folder, "orders"), ["o_orderdate"])))


@query(
    "time_bins",
    "SELECT 'ts' AS \"column\", (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS bucket_ms, count(*) AS count FROM events GROUP BY 2",
)
def _(spark, folder):
    return describe.time_bins(table(spark, folder, "events"), ["ts"])


@query(
    "column_statistics",
    "SELECT 'value' AS \"column\", count(value) AS n, round(avg(value), 4) AS mean FROM events UNION ALL SELECT 'event_id', count(*), round(avg(event_id), 4) FROM events "
    "UNION ALL SELECT 'user_id', count(*), round(avg(user_id), 4) FROM events",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    blocks = describe.column_statistics(events, profile(events, duplicates=False))
    return rounded(blocks["numeric"].select("column", "n", "mean"), 4)


# ---------------------------------------------------------------- missingness


@query(
    "missingness",
    G + union_all("SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percentage FROM g", COLUMNS),
)
def _(spark, folder):
    return rounded(describe.missingness(gaps(spark, folder)))


@query(
    "co_missing",
    G + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1 END) AS count, "
        f"round(100.0 * count(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1 END) / count(*), 6) AS percentage FROM g"
        for a in COLUMNS for b in COLUMNS
    ),
)
def _(spark, folder):
    return rounded(describe.co_missing(gaps(spark, folder)))


# ---------------------------------------------------------------- correlation

NUM = ["total", "cust", "o_orderkey"]
_PAIRS = [(a, b) for a in NUM for b in NUM if a != b]
_EYE = " UNION ALL ".join(f"SELECT '{a}' AS x, '{a}' AS y, 1.0::DOUBLE AS value, CAST(NULL AS BIGINT) AS n" for a in NUM)


@query(
    "pearson",
    G + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS value, regr_count({a}, {b}) AS n FROM g" for a, b in _PAIRS) + " UNION ALL " + _EYE,
)
def _(spark, folder):
    return rounded(correlate.pearson(gaps(spark, folder), NUM).drop("p_value"))


@query(
    "spearman",
    G + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr(ra, rb), 6) AS value, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in _PAIRS
    ) + " UNION ALL " + _EYE,
)
def _(spark, folder):
    return rounded(correlate.spearman(gaps(spark, folder), NUM).drop("p_value"))


@query(
    "top_correlated_pairs",
    G + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS value FROM g" for a, b in _PAIRS if a < b) + ") ORDER BY abs(value) DESC, x, y LIMIT 2",
)
def _(spark, folder):
    return rounded(correlate.top_pairs(correlate.pearson(gaps(spark, folder), NUM), 2).select("x", "y", "value"))


# ---------------------------------------------------------------- association

CATS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_shipmode"), ("l_linestatus", "l_shipmode")]
LINES = "SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'm' || CAST((l_partkey + l_quantity) % 4 AS BIGINT) END AS l_shipmode FROM lineitem"


def shipped(spark, folder):
    return spark.sql(LINES.replace("lineitem", "{lineitem}"), lineitem=lines(spark, folder))


@query(
    "contingency_table",
    f"WITH l AS ({LINES}) " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS pair, {a} AS a, {b} AS b, count(*) AS n FROM l WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for i, (a, b) in enumerate(CATS)
    ),
)
def _(spark, folder):
    return A.contingency(shipped(spark, folder), CATS)


def chi_sql(i: int, a: str, b: str) -> str:
    return (
        f"SELECT CAST({i} AS INTEGER) AS pair, any_value(total) AS n, round(any_value(total) * (sum(n * 1.0 * n / (na * 1.0 * nb)) - 1), 4) AS chi_square, "
        f"round(sqrt((sum(n * 1.0 * n / (na * 1.0 * nb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS cramers_v, "
        # the series of the lower incomplete gamma function; beyond a half of 60 the p-value is 0 to six places
        f"any_value(total) * (sum(n * 1.0 * n / (na * 1.0 * nb)) - 1) / 2 AS half, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) / 2 AS shape, "
        f"CASE WHEN half > 60 THEN 0.0 ELSE round(1 - exp(shape * ln(half) - half) * list_sum([exp(t * ln(half) - lgamma(shape + t + 1)) FOR t IN range(300)]), 6) END AS p_value FROM "
        f"(SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, CAST(sum(n) OVER () AS BIGINT) AS total FROM "
        f"(SELECT {a} AS a, {b} AS b, count(*) AS n FROM l WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))"
    )


_CHI = f"WITH l AS ({LINES}) " + " UNION ALL ".join(chi_sql(i, a, b) for i, (a, b) in enumerate(CATS))


@query("chi_square", f"SELECT pair, n, chi_square FROM ({_CHI})")
def _(spark, folder):
    return rounded(A.chi_square_stats(shipped(spark, folder), CATS).select("pair", "n", "chi_square"), 4)


@query("cramers_v", f"SELECT pair, cramers_v FROM ({_CHI})")
def _(spark, folder):
    return rounded(A.chi_square_stats(shipped(spark, folder), CATS).select("pair", "cramers_v"))


_NAMES = ["l_returnflag", "l_linestatus", "l_shipmode"]
_WHICH = " UNION ALL ".join(f"SELECT {i} AS pair, '{a}' AS x, '{b}' AS y UNION ALL SELECT {i}, '{b}', '{a}'" for i, (a, b) in enumerate(CATS))


@query(
    "association_matrix",
    f"SELECT x, y, chi_square, p_value, cramers_v FROM ({_CHI}) JOIN ({_WHICH}) USING (pair) UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n}', '{n}', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE" for n in _NAMES),
)
def _(spark, folder):
    return rounded(A.categorical_association(shipped(spark, folder), _NAMES), 6, chi_square=4)


TWO, MANY = ("l_extendedprice", "l_linestatus"), ("l_quantity", "l_shipmode")
_M = "SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM (SELECT {n} AS v, {c} AS g FROM l WHERE {n} IS NOT NULL AND {c} IS NOT NULL) GROUP BY g HAVING count(*) >= 2"


def moments_sql(pair) -> str:
    return _M.replace("{n}", pair[0]).replace("{c}", pair[1])


L = f"WITH l AS ({LINES}) "


@query("group_moments", L + f"SELECT g, n, round(m, 6) AS mean, round(s, 6) AS var FROM ({moments_sql(MANY)})")
def _(spark, folder):
    return rounded(A.group_moments(A.grouped_values(shipped(spark, folder), [MANY])).drop("pair"))


@query(
    "welch_t",
    L + "SELECT round((m1 - m2) / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 3) AS df FROM (SELECT x.m AS m1, y.m AS m2, x.s / x.n AS a, "
    f"y.s / y.n AS b, x.n AS n1, y.n AS n2 FROM ({moments_sql(TWO)}) x, ({moments_sql(TWO)}) y WHERE x.g < y.g)",
)
def _(spark, folder):
    return rounded(A.welch_t_stats(A.group_moments(A.grouped_values(shipped(spark, folder), [TWO]))).drop("pair"), 6, df=3)


@query(
    "anova",
    L + f", m AS (SELECT *, n / s AS w FROM ({moments_sql(MANY)})), c AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * m) / sum(w) AS wc, sum(n * m) / sum(n) AS gc FROM m), "
    "p AS (SELECT any_value(k) AS k, sum(w * (m - wc) * (m - wc)) AS b, sum((1 - w / sw) * (1 - w / sw) / (n - 1)) AS l, sum(n * (m - gc) * (m - gc)) AS ssb, sum((n - 1) * s) AS ssw FROM m, c) "
    "SELECT k, round(b / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1.0) * l), 6) AS f, CAST(k - 1 AS DOUBLE) AS df1, round((k * k - 1) / (3 * l), 2) AS df2, round(ssb / (ssb + ssw), 9) AS effect_size FROM p",
)
def _(spark, folder):
    return rounded(A.welch_anova_stats(A.group_moments(A.grouped_values(shipped(spark, folder), [MANY]))).drop("pair"), 6, df2=2, effect_size=9)


def ranks_sql(pair) -> str:
    n, c = pair
    return (
        f"SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v) AS t FROM "
        f"(SELECT {n} AS v, {c} AS g FROM l WHERE {n} IS NOT NULL AND {c} IS NOT NULL)"
    )


def sums(df, pair):
    values = A.grouped_values(df, [pair])
    return A.rank_sums(values, A.group_moments(values), df.count())


@query(
    "mann_whitney",
    L + f", r AS ({ranks_sql(TWO)}), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS rs FROM r GROUP BY g), t AS (SELECT sum(t * 1.0 * t - 1) AS ties FROM r), "
    "u AS (SELECT x.n AS n1, y.n AS n2, x.n + y.n AS n, x.rs - x.n * (x.n + 1) / 2 AS u, ties FROM s x, s y, t WHERE x.g < y.g) "
    "SELECT u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u",
)
def _(spark, folder):
    return rounded(A.mann_whitney_stats(sums(shipped(spark, folder), TWO)).drop("pair"))


@query(
    "kruskal_wallis",
    L + f", r AS ({ranks_sql(MANY)}), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS rs FROM r GROUP BY g), t AS (SELECT sum(t * 1.0 * t - 1) AS ties, CAST(count(*) AS DOUBLE) AS n FROM r) "
    "SELECT count(*) AS k, round((12 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(rs * rs / s.n) - 3 * (any_value(t.n) + 1)) / (1 - any_value(ties) / (power(any_value(t.n), 3) - any_value(t.n))), 4) AS h, "
    "CAST(count(*) - 1 AS DOUBLE) AS df FROM s, t",
)
def _(spark, folder):
    return rounded(A.kruskal_stats(sums(shipped(spark, folder), MANY)).drop("pair"), 4)


@query(
    "brown_forsythe",
    L + ", v AS (SELECT l_quantity AS v, l_shipmode AS g FROM l WHERE l_shipmode IS NOT NULL), z AS (SELECT g, abs(v - median(v) OVER (PARTITION BY g)) AS z FROM v), "
    "m AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS s FROM z GROUP BY g), c AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gc FROM m) "
    "SELECT round(sum(m.n * (m - gc) * (m - gc)) / (any_value(k) - 1) / (sum((m.n - 1) * s) / (any_value(c.n) - any_value(k))), 6) AS f, CAST(any_value(k) - 1 AS DOUBLE) AS df1, "
    "CAST(any_value(c.n) - any_value(k) AS DOUBLE) AS df2 FROM m, c",
)
def _(spark, folder):
    df = shipped(spark, folder)
    values = A.grouped_values(df, [MANY])
    return rounded(A.brown_forsythe_stats(values, A.group_moments(values), df.count()).drop("pair"))


@query("group_tests")
def _(spark, folder):
    return A.group_tests(shipped(spark, folder), ["l_quantity", "l_extendedprice"], ["l_linestatus", "l_shipmode"])


def chi_tail_sql(x: str, df: str) -> str:
    """The upper tail of chi-square by the series of the lower incomplete gamma function."""
    h, a = f"({x} / 2)", f"({df} / 2)"
    return f"CASE WHEN {h} > 60 THEN 0.0 ELSE 1 - exp({a} * ln({h}) - {h}) * list_sum([exp(step * ln({h}) - lgamma({a} + step + 1)) FOR step IN range(300)]) END"


def f_tail_sql(f: str, df1: str, df2: str) -> str:
    """The upper tail of F by the series of the incomplete beta function."""
    y, a, b = f"({df1} * {f} / ({df1} * {f} + {df2}))", f"({df1} / 2)", f"({df2} / 2)"
    head = f"exp({a} * ln({y}) + {b} * ln(1 - {y}) - lgamma({a} + 1) - lgamma({b}) + lgamma({a} + {b}))"
    terms = f"exp(lgamma({a} + {b} + step) - lgamma({a} + {b}) - lgamma({a} + 1 + step) + lgamma({a} + 1) + step * ln({y}))"
    return f"CASE WHEN {df1} * {f} > 120 THEN 0.0 ELSE 1 - {head} * list_sum([{terms} FOR step IN range(300)]) END"


@query(
    "group_test_p_values",
    " UNION ALL ".join(
        f"SELECT '{test}' AS test, round({tail}, 3) AS p_value FROM ({SQL[source]})"
        for test, source, tail in (
            ("welch_t", "welch_t", f_tail_sql("(t * t)", "1.0", "df")),
            ("mann_whitney", "mann_whitney", chi_tail_sql("(z * z)", "1.0")),
            ("anova", "anova", f_tail_sql("f", "df1", "df2")),
            ("kruskal_wallis", "kruskal_wallis", chi_tail_sql("h", "df")),
            ("brown_forsythe", "brown_forsythe", f_tail_sql("f", "df1", "df2")),
        )
    ),
)
def _(spark, folder):
    two = A.group_tests(shipped(spark, folder), [TWO[0]], [TWO[1]]).where("test != 'brown_forsythe'")
    many = A.group_tests(shipped(spark, folder), [MANY[0]], [MANY[1]])
    return two.unionByName(many).select("test", F.round("p_value", 3).alias("p_value"))


@query("interpolated_quantiles", T + "SELECT unnest([0.1, 0.5, 0.9]) AS share, round(unnest(quantile_cont(price, [0.1, 0.5, 0.9])), 4) AS value FROM t")
def _(spark, folder):
    found = interpolated_quantiles(tails(spark, folder), ["price"], [0.1, 0.5, 0.9])["price"]
    return rounded(spark.createDataFrame(list(zip([0.1, 0.5, 0.9], found)), "share double, value double"), 4)


@query(
    "index_quantiles",
    T + "SELECT 0.05 AS share, " + index_sql("price", 0.05) + " AS value FROM t UNION ALL SELECT 0.95, " + index_sql("price", 0.95) + " FROM t",
)
def _(spark, folder):
    found = index_quantiles(tails(spark, folder), ["price"], [0.05, 0.95])["price"]
    return spark.createDataFrame(list(zip([0.05, 0.95], found)), "share double, value double")


# ---------------------------------------------------------------- views


@query(
    "chart_data",
    union_all("SELECT '{c}' AS \"column\", 'histogram' AS series, CAST(count(*) AS DOUBLE) AS drawn FROM events", ["event_id", "user_id", "value"])
    + " UNION ALL SELECT 'ts', 'time', count(*) FROM events UNION ALL SELECT 'event_type', 'length', count(*) FROM events "
    "UNION ALL SELECT 'event_type', 'categories', count(*) FROM events "
    "UNION ALL SELECT 'value', 'box', round(min(value) + quantile_cont(value, 0.25) + median(value) + quantile_cont(value, 0.75) + max(value), 4) FROM events",
)
def _(spark, folder):
    events = table(spark, folder, "events").drop("props")
    drawn = charts.chart_data(events, profile(events, duplicates=False)).groupBy("column", "series").agg(F.sum("value").alias("drawn"))
    return rounded(drawn.where("series != 'box' or column = 'value'"), 4)


_BOX = [("min", "min(total)"), ("q1", "quantile_cont(total, 0.25)"), ("median", "median(total)"), ("q3", "quantile_cont(total, 0.75)"), ("max", "max(total)")]


def _dashboard_sql(dataset: str, source: str) -> str:
    head = f"SELECT '{dataset}' AS dataset, "
    parts = [f"{head}'total' AS \"column\", 'box' AS series, '{n}' AS label, round({v}, 4) AS value FROM {source}" for n, v in _BOX]
    parts += [f"{head}'total', 'histogram', NULL, CAST(count(total) AS DOUBLE) FROM {source}"]
    parts += [f"{head}'{c}', 'categories', {c}, CAST(count(*) AS DOUBLE) FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("status", "priority")]
    return " UNION ALL ".join(parts)


@query(
    "dashboard",
    G + ", f AS (SELECT coalesce(total, (SELECT median(total) FROM g)) AS total, coalesce(status, 'Missing') AS status, coalesce(priority, 'Missing') AS priority FROM g) "
    + _dashboard_sql("original", "g") + " UNION ALL " + _dashboard_sql("processed", "f"),
)
def _(spark, folder):
    original = gaps(spark, folder).select("total", "status", "priority")
    processed = indicator_fill(median_fill(original, ["total"]), ["status", "priority"])
    drawn = charts.dashboard({"original": original, "processed": processed})
    # the bins of a histogram together hold every value
    value = F.sum("value").alias("value")
    label = F.when(F.col("series") != "histogram", F.col("label")).alias("label")
    wanted = drawn.where("series in ('box', 'categories') or (series = 'histogram' and column = 'total')")
    return rounded(wanted.groupBy("dataset", "column", "series", label).agg(value), 4)


@query(
    "heatmap_view",
    G + "SELECT x, y, value, CAST(3 AS INTEGER) AS total_columns, true AS truncated FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS value FROM g" for a, b in _PAIRS)
    + " UNION ALL SELECT x, y, value FROM (" + _EYE + ")) WHERE x IN ('cust', 'o_orderkey') AND y IN ('cust', 'o_orderkey')",
)
def _(spark, folder):
    view = charts.heatmap_view(correlate.pearson(gaps(spark, folder), NUM), "pearson", limit=2)
    return rounded(view.select("x", "y", "value", "total_columns", "truncated"))


@query(
    "full_analysis",
    "SELECT 'value' AS \"column\", count(*) AS n, round(avg(value), 4) AS mean FROM events UNION ALL SELECT 'event_id', count(*), round(avg(event_id), 4) FROM events "
    "UNION ALL SELECT 'user_id', count(*), round(avg(user_id), 4) FROM events",
)
def _(spark, folder):
    return rounded(analyze(table(spark, folder, "events"))["numeric"].select("column", "n", "mean"), 4)
