"""Filling and outliers."""

from pyspark.sql import functions as F

from checks.profiling import TAILS, index_sql, tails
from checks.registry import GAPS, gaps, query, rounded, table
from tablewright.operators import impute as I
from tablewright.operators import outliers as O
from tablewright.operators.knn import knn_fill, knn_predict
from tablewright.plans.cleaning import CleaningOptions, clean_table, column_lineage, summary_frame

G = f"WITH g AS (SELECT {GAPS} FROM orders) "
NUM = "o_orderkey, round(coalesce(total, (SELECT {f}(total) FROM g)), 4) AS total, round(coalesce(CAST(cust AS DOUBLE), (SELECT {f}(cust) FROM g)), 4) AS cust"
_MODE = "(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def numbers(spark, folder):
    return gaps(spark, folder).select("o_orderkey", "total", "cust")


def words(spark, folder):
    return gaps(spark, folder).select("o_orderkey", "status", "priority")


@query("median_fill", G + "SELECT " + NUM.replace("{f}", "median") + " FROM g")
def _(spark, folder):
    return rounded(I.median_fill(numbers(spark, folder), ["total", "cust"]), 4)


@query("mean_fill", G + "SELECT " + NUM.replace("{f}", "avg") + " FROM g")
def _(spark, folder):
    return rounded(I.mean_fill(numbers(spark, folder), ["total", "cust"]), 4)


@query(
    "mode_fill",
    G + f"SELECT o_orderkey, coalesce(status, {_MODE.replace('{c}', 'status')}) AS status, coalesce(priority, {_MODE.replace('{c}', 'priority')}) AS priority FROM g",
)
def _(spark, folder):
    return I.mode_fill(words(spark, folder), ["status", "priority"])


@query("indicator_fill", G + "SELECT o_orderkey, coalesce(status, 'Missing') AS status, coalesce(priority, 'Missing') AS priority FROM g")
def _(spark, folder):
    return I.indicator_fill(words(spark, folder), ["status", "priority"])


@query("constant_fill", G + "SELECT o_orderkey, coalesce(status, 'Unknown') AS status, coalesce(priority, 'Unknown') AS priority FROM g")
def _(spark, folder):
    return I.constant_fill(words(spark, folder), ["status", "priority"])


@query(
    "forward_backward_fill",
    G + "SELECT o_orderkey, coalesce(last_value(placed IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), "
    "first_value(placed IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS placed FROM g",
)
def _(spark, folder):
    return I.forward_backward_fill(gaps(spark, folder).select("o_orderkey", "placed"), ["placed"], "o_orderkey")


_NEAR = (
    "SELECT o_orderkey AS k, total AS v, last_value(total IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN total IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER b AS pk, "
    "first_value(total IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN total IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER a AS nk FROM g "
    "WINDOW b AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), a AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
)


@query(
    "interpolate",
    G + f"SELECT k AS o_orderkey, round(coalesce(v, CASE WHEN nk > pk THEN pv + (nv - pv) * ((k - pk) / (nk - pk)) END, pv, nv), 4) AS total FROM ({_NEAR})",
)
def _(spark, folder):
    return rounded(I.interpolate(gaps(spark, folder).select("o_orderkey", "total"), ["total"], "o_orderkey"), 4)


@query(
    "file_order_fill",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS total FROM orders) "
    "SELECT o_orderkey, coalesce(total, last_value(total IGNORE NULLS) OVER (ORDER BY o_orderkey), first_value(total IGNORE NULLS) "
    "OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total FROM o",
)
def _(spark, folder):
    """Without an order key; the file holds the orders by their key."""
    o = table(spark, folder, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS total")
    return I.forward_backward_fill(o, ["total"])


SUPPLIERS = "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier"


@query(
    "knn_fill",
    f"WITH s AS ({SUPPLIERS}), d AS (SELECT q.s_suppkey AS k, sqrt((power(q.s_suppkey - d.s_suppkey, 2) + power(q.s_nationkey - d.s_nationkey, 2)) / 2.0) AS gap, "
    "d.s_suppkey AS tie, d.s_acctbal AS y FROM s q JOIN s d ON q.s_acctbal IS NULL AND d.s_acctbal IS NOT NULL), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, tie) AS place FROM d), "
    "f AS (SELECT k, sum(y / gap) / sum(1 / gap) AS guess FROM n WHERE place <= 5 GROUP BY k) "
    "SELECT s_suppkey, s_nationkey, round(coalesce(s_acctbal, guess), 6) AS s_acctbal FROM s LEFT JOIN f ON s_suppkey = k",
)
def _(spark, folder):
    s = spark.sql(SUPPLIERS.replace("supplier", "{supplier}"), supplier=table(spark, folder, "supplier"))
    return rounded(knn_fill(s, "s_acctbal", 5, "s_suppkey"))


LINES = (
    "SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS line, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity, "
    "CASE WHEN l_orderkey % 1000 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS price FROM lineitem"
)


@query(
    "knn_fill_lines",
    f"WITH s AS ({LINES}), d AS (SELECT q.line AS k, sqrt((power(q.l_partkey - d.l_partkey, 2) + power(q.l_suppkey - d.l_suppkey, 2) + power(q.l_quantity - d.l_quantity, 2)) / 3.0) AS gap, "
    "d.line AS tie, d.price AS y FROM s q JOIN s d ON q.price IS NULL AND d.price IS NOT NULL), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, tie) AS place FROM d), "
    "f AS (SELECT k, sum(y * CASE WHEN gap < 1e-10 THEN 1e10 ELSE 1 / gap END) / sum(CASE WHEN gap < 1e-10 THEN 1e10 ELSE 1 / gap END) AS guess FROM n WHERE place <= 5 GROUP BY k) "
    "SELECT line, round(coalesce(price, guess), 4) AS price FROM s LEFT JOIN f ON line = k",
)
def _(spark, folder):
    """Three features, many boxes."""
    s = spark.sql(LINES.replace("lineitem", "{lineitem}"), lineitem=table(spark, folder, "lineitem"))
    return rounded(knn_fill(s, "price", 5, "line", ["l_partkey", "l_suppkey", "l_quantity"]).select("line", "price"), 4)


@query(
    "knn_model",
    "WITH t AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal AS y FROM supplier), "
    "d AS (SELECT q.s_suppkey AS k, abs(q.a - d.a) + abs(q.s_suppkey - d.s_suppkey) AS gap, d.s_suppkey AS tie, d.y FROM t q JOIN t d "
    "ON q.s_suppkey % 4 = 0 AND d.s_suppkey % 4 <> 0), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, tie) AS place FROM d) "
    "SELECT k AS s_suppkey, round(avg(y), 6) AS prediction FROM n WHERE place <= 5 GROUP BY k",
)
def _(spark, folder):
    s = table(spark, folder, "supplier")
    rows = knn_predict(
        s.where("s_suppkey % 4 <> 0"), s.where("s_suppkey % 4 = 0"), ["s_nationkey", "s_suppkey"], "s_acctbal", 5,
        metric="manhattan", key="s_suppkey",
    )
    return rounded(rows.select("s_suppkey", "prediction"))


@query(
    "fallback_fill",
    G + "SELECT o_orderkey, round(coalesce(total, (SELECT median(total) FROM g)), 4) AS total, "
    f"coalesce(status, {_MODE.replace('{c}', 'status')}) AS status FROM g",
)
def _(spark, folder):
    g = gaps(spark, folder).select("o_orderkey", "total", "status")
    return rounded(I.impute(g, {"total": "automatic", "status": "automatic"})[0], 4)


@query(
    "final_fill",
    G + "SELECT o_orderkey, coalesce(total, 0) AS total, CAST(coalesce(cust, 0) AS DOUBLE) AS cust, coalesce(status, 'Unknown') AS status FROM g",
)
def _(spark, folder):
    return I.final_fill(gaps(spark, folder).select("o_orderkey", "total", "cust", "status"))


@query(
    "impute_dispatch",
    G + "SELECT o_orderkey, round(coalesce(total, (SELECT avg(total) FROM g)), 4) AS total, round(coalesce(CAST(cust AS DOUBLE), (SELECT median(cust) FROM g)), 4) AS cust, "
    "coalesce(status, 'Missing') AS status, coalesce(priority, 'Unknown') AS priority, "
    "coalesce(last_value(placed IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), "
    "first_value(placed IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS placed FROM g",
)
def _(spark, folder):
    chosen = {
        "total": "mean_imputation", "cust": "median_imputation", "status": "category_indicator",
        "priority": "constant_imputation", "placed": "forward_fill",
    }
    return rounded(I.impute(gaps(spark, folder), chosen, order_by="o_orderkey")[0], 4)


@query(
    "zero_and_drop_fill",
    G + "SELECT o_orderkey, coalesce(total, 0) AS total, status FROM g WHERE status IS NOT NULL",
)
def _(spark, folder):
    return I.drop_missing(I.zero_fill(gaps(spark, folder).select("o_orderkey", "total", "status"), ["total"]), ["status"])


@query(
    "scoring_fill",
    G + "SELECT o_orderkey, round(coalesce(total, (SELECT avg(total) FROM g)), 4) AS total, coalesce(status, '') AS status FROM g",
)
def _(spark, folder):
    return rounded(I.scoring_fill(gaps(spark, folder).select("o_orderkey", "total", "status"), ["total", "status"]), 4)


# ---------------------------------------------------------------- outliers

_CAPS = "(SELECT " + index_sql("price", 0.05) + " AS lo, " + index_sql("price", 0.95) + " AS hi FROM t)"
_IQR = "(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT " + index_sql("price", 0.25) + " AS q1, " + index_sql("price", 0.75) + " AS q3 FROM t))"
_KEYS = "l_orderkey, l_linenumber, quantity, "
T = f"WITH t AS ({TAILS}) "


@query("cap_outliers", T + f"SELECT {_KEYS} round(least(greatest(price, lo), hi), 4) AS price FROM t, {_CAPS}")
def _(spark, folder):
    return rounded(O.cap_outliers(tails(spark, folder), ["price"]), 4)


@query("remove_outliers", T + f"SELECT {_KEYS} round(price, 4) AS price FROM t, {_IQR} WHERE price BETWEEN lo AND hi")
def _(spark, folder):
    return rounded(O.remove_outliers(tails(spark, folder), ["price", "quantity"]), 4)


@query(
    "replace_outliers",
    T + f"SELECT {_KEYS} round(CASE WHEN price < lo OR price > hi THEN (SELECT median(price) FROM t) ELSE price END, 4) AS price FROM t, {_IQR}",
)
def _(spark, folder):
    return rounded(O.replace_outliers(tails(spark, folder), ["price"]), 4)


@query("treat_outliers_dispatch", T + f"SELECT {_KEYS} round(price, 4) AS price FROM t")
def _(spark, folder):
    return rounded(O.treat_outliers(tails(spark, folder), ["price"], "keep_outliers"), 4)


# ---------------------------------------------------------------- the whole run


def _run(spark, folder):
    g = gaps(spark, folder).drop("placed")
    g = g.unionByName(g.where("o_orderkey % 3 = 0"))
    options = CleaningOptions(key="o_orderkey", order_by="o_orderkey", decisions={("missing_values", "total"): "mean_imputation"})
    return g, clean_table(g, options)


_CLEANED = "g AS (SELECT o_orderkey, total, cust, status, priority FROM (SELECT " + GAPS + " FROM orders))"


@query(
    "cleaning_run",
    f"WITH {_CLEANED} SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, round(coalesce(total, (SELECT avg(total) FROM g)), 4) AS total FROM g",
)
def _(spark, folder):
    return rounded(_run(spark, folder)[1].training.select("o_orderkey", "total"), 4)


@query(
    "cleaning_summary",
    f"WITH {_CLEANED}, c AS (SELECT count(*) AS n, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS extra FROM g) "
    "SELECT n + extra AS rows_before, n AS rows_after, CAST(5 AS BIGINT) AS columns_before, CAST(5 AS BIGINT) AS columns_after, "
    "CAST(0 AS BIGINT) AS issues_remaining, 1.0::DOUBLE AS quality_after FROM c",
)
def _(spark, folder):
    g, result = _run(spark, folder)
    return summary_frame(g, result).drop("issues_found", "quality_before")


@query("cleaning_lineage", "SELECT * FROM (VALUES ('o_orderkey', false), ('total', false), ('cust', false), ('status', false), ('priority', false)) AS t(\"column\", removed)")
def _(spark, folder):
    g, result = _run(spark, folder)
    return column_lineage(g, result).select("column", "removed")
