"""Profiles, inference, issues and rules."""

from pyspark.sql import functions as F

from checks.registry import GAPS, TEXTS, gaps, query, rounded, table, texts, union_all
from tablewright.operators import profile as P
from tablewright.operators import quality as Q
from tablewright.operators.select import column_listing
from tablewright.plans.cleaning import dry_run
from tablewright.sources.tables import column_info

G = f"WITH g AS (SELECT {GAPS} FROM orders) "
COLUMNS = ["o_orderkey", "total", "cust", "status", "priority", "placed"]
NUMBERS = ["o_orderkey", "total", "cust"]
HINTED = {"o_orderkey": "numeric", "total": "numeric", "cust": "numeric", "status": "string", "priority": "string", "placed": "datetime"}


def index_sql(c: str, q: float) -> str:
    """``sorted[floor(n * q)]``."""
    return f"list({c} ORDER BY {c}) FILTER ({c} IS NOT NULL)[CAST(floor(count({c}) * {q}) AS BIGINT) + 1]"


_TYPES = "CASE '{c}' " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in HINTED.items()) + " END"

COUNTS = union_all(
    "SELECT '{c}' AS name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count, "
    "CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
    "round(100.0 * sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS null_percentage FROM g",
    COLUMNS,
)


@query("column_profile", G + COUNTS)
def _(spark, folder):
    g = gaps(spark, folder)
    return rounded(P.profile_frame(g, P.profile(g, duplicates=False)).select("name", "unique_count", "null_count", "null_percentage"))


@query("column_metadata", G + union_all("SELECT '{c}' AS name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count FROM g", COLUMNS))
def _(spark, folder):
    return column_info(gaps(spark, folder)).select("name", "null_count")


@query(
    "type_inference",
    "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('amount', 'numeric'), ('quoted', 'string'), ('worded', 'string'), "
    "('flag', 'binary'), ('empty', 'unknown'), ('doc', 'text'), ('mail', 'identifier'), ('day', 'datetime'), ('truth', 'binary'), "
    "('iso', 'datetime')) AS t(name, inferred_type)",
)
def _(spark, folder):
    t = texts(spark, folder).drop("stamp").withColumns(
        {
            "empty": F.lit(None).cast("string"),
            "doc": F.concat_ws(" ", *[F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(s))) for s in "ab"]),
            "mail": F.concat(F.lit("u"), F.col("o_orderkey").cast("string"), F.lit("@example.org")),
            "day": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("o_orderkey") % 900).cast("int")),
            "truth": F.col("o_orderkey") % 2 == 0,
            "iso": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("o_orderkey") % 900).cast("int")).cast("string"),
            "flag": F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no"),
        }
    )
    return P.profile_frame(t, P.profile(t, duplicates=False, sample_key=["o_orderkey"])).select("name", "inferred_type")


@query(
    "role_inference",
    G + "SELECT name, CASE WHEN inferred_type = 'identifier' THEN 'identifier' "
    "WHEN regexp_matches(name, 'target|label|class|outcome|result|prediction|default|churn|fraud|risk|score|rating|price|value|amount|cost|"
    "revenue|sales|profit|loss|duration|time|age') THEN 'target_candidate' "
    "WHEN regexp_matches(name, 'date|time|created|updated|modified|timestamp|name|description|comment|note|address|city|country') THEN 'metadata' "
    "WHEN inferred_type = 'binary' OR (inferred_type = 'string' AND unique_count <= 10) THEN 'target_candidate' "
    "WHEN inferred_type = 'numeric' AND unique_count > 10 AND unique_count < rows // 2 THEN 'target_candidate' ELSE 'feature' END AS inferred_role "
    "FROM (SELECT c.name, c.unique_count, (SELECT count(*) FROM g) AS rows, " + _TYPES.replace("'{c}'", "c.name") + f" AS inferred_type FROM ({COUNTS}) c)",
)
def _(spark, folder):
    g = gaps(spark, folder)
    return P.profile_frame(g, P.profile(g, duplicates=False, sample_key=["o_orderkey"])).select("name", "inferred_role")


_SKEW = "sum(power((v - m) / s, 3)) / count(*)"


@query(
    "numeric_characteristics",
    G + union_all(
        "SELECT '{c}' AS name, round(any_value(m), 4) AS mean, round(any_value(s), 4) AS std, round(" + _SKEW + ", 6) AS skewness, "
        "CASE WHEN abs(" + _SKEW + ") < 1 THEN 'normal' ELSE 'skewed' END AS distribution "
        "FROM (SELECT CAST({c} AS DOUBLE) AS v FROM g WHERE {c} IS NOT NULL), "
        "(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM g)",
        NUMBERS,
    ),
)
def _(spark, folder):
    g = gaps(spark, folder)
    frame = P.profile_frame(g, P.profile(g, duplicates=False)).where("characteristics['mean'] is not null")
    c = F.col("characteristics")
    return frame.select(
        "name", F.round(c["mean"].cast("double"), 4).alias("mean"), F.round(c["std"].cast("double"), 4).alias("std"),
        F.round(c["skewness"].cast("double"), 6).alias("skewness"), c["distribution"].alias("distribution"),
    )


@query(
    "cardinality_bands",
    G + f"SELECT name, CASE WHEN unique_count < 10 THEN 'low' WHEN unique_count < 50 THEN 'medium' ELSE 'high' END AS band FROM ({COUNTS})",
)
def _(spark, folder):
    g = gaps(spark, folder)
    return P.profile_frame(g, P.profile(g, duplicates=False)).select("name", F.col("characteristics")["cardinality"].alias("band"))


@query(
    "category_characteristics",
    G + union_all(
        "SELECT '{c}' AS name, first(v ORDER BY n DESC, v) AS most_frequent, "
        "CASE WHEN stddev_pop(n) < avg(n) THEN 'balanced' ELSE 'imbalanced' END AS balance "
        "FROM (SELECT {c} AS v, count(*) AS n FROM g WHERE {c} IS NOT NULL GROUP BY {c})",
        ["status", "priority"],
    ),
)
def _(spark, folder):
    shapes = P.count_shapes(P.value_counts(gaps(spark, folder), ["status", "priority"]))
    balance = F.when(F.col("count_std") < F.col("count_mean"), "balanced").otherwise("imbalanced")
    return shapes.select(F.col("column").alias("name"), "most_frequent", balance.alias("balance"))


TAILS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS price, l_quantity AS quantity FROM lineitem"


def tails(spark, folder):
    """Line items with a tail of large prices."""
    return spark.sql(TAILS.replace("lineitem", "{lineitem}"), lineitem=table(spark, folder, "lineitem"))


_BOUNDS = (
    "SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT count({c}) AS n, "
    + index_sql("{c}", 0.25) + " AS q1, " + index_sql("{c}", 0.75) + " AS q3 FROM t)"
)


@query(
    "outlier_flags",
    f"WITH t AS ({TAILS}) " + union_all(
        "SELECT '{c}' AS name, count(CASE WHEN {c} < lo OR {c} > hi THEN 1 END) > any_value(n) // 20 AS has_outliers FROM t, (" + _BOUNDS + ")",
        ["price", "quantity"],
    ),
)
def _(spark, folder):
    t = tails(spark, folder)
    flags = P.outlier_flags(t, ["price", "quantity"], P.measure(t, {n: F.count(n) for n in ("price", "quantity")}))
    return spark.createDataFrame(list(flags.items()), "name string, has_outliers boolean")


@query(
    "duplicate_rows",
    "SELECT count(*) AS duplicates, round(100.0 * count(*) / (SELECT count(*) + count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) FROM orders), 6) "
    "AS percentage FROM orders WHERE o_orderkey % 3 = 0",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    twice = orders.unionByName(orders.where("o_orderkey % 3 = 0"))
    copies = P.duplicate_rows(twice)
    return rounded(twice.agg(F.lit(copies).cast("bigint").alias("duplicates"), (100.0 * F.lit(copies) / F.count("*")).alias("percentage")))


@query(
    "dataset_profile",
    G + "SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS duplicate_count, 'classification,regression,time_series' AS problem_types, "
    "CASE WHEN count(*) < 10000 THEN 'small' WHEN count(*) < 100000 THEN 'medium' WHEN count(*) < 1000000 THEN 'large' ELSE 'very_large' END AS size_category, "
    "'low' AS feature_complexity, CAST(4 AS BIGINT) AS high_cardinality_features, 'high' AS missing_data_complexity FROM g",
)
def _(spark, folder):
    g = gaps(spark, folder)
    d = P.dataset_frame(g, P.profile(g, sample_key=["o_orderkey"]))
    return d.select(
        "row_count", "column_count", "duplicate_count", F.concat_ws(",", "problem_types").alias("problem_types"), "size_category",
        "feature_complexity", "high_cardinality_features", "missing_data_complexity",
    )


@query(
    "column_listing",
    G + f"SELECT name, unique_count, CAST(6 AS BIGINT) AS total, CAST(4 AS BIGINT) AS filtered FROM ({COUNTS}) WHERE contains(name, 't')",
)
def _(spark, folder):
    g = gaps(spark, folder)
    listed = column_listing(
        P.profile_frame(g, P.profile(g, duplicates=False)), search="T", types=["numeric", "string", "binary"], sort_by="nulls", direction="desc"
    )
    return listed.select("name", "unique_count", F.col("total").cast("bigint").alias("total"), F.col("filtered").cast("bigint").alias("filtered"))


_MISSING = f"SELECT * FROM ({COUNTS}) WHERE null_percentage > 10 AND null_percentage <= 50"


@query(
    "dry_run",
    G + "SELECT 'missing_values' AS issue_type, CASE WHEN null_percentage > 30 THEN 'high' ELSE 'medium' END AS severity, name AS columns, "
    f"CAST(null_count AS STRING) AS missing FROM ({_MISSING})",
)
def _(spark, folder):
    issues = dry_run(gaps(spark, folder))["issues"]
    return issues.select("issue_type", "severity", F.concat_ws(",", "columns").alias("columns"), F.col("details")["missing_count"].alias("missing"))


# ---------------------------------------------------------------- issues and scores


@query(
    "outlier_issue",
    f"WITH t AS ({TAILS}) SELECT 'price' AS \"column\", round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, "
    "round(min(CASE WHEN price >= lo THEN price END), 4) AS normal_min, round(max(CASE WHEN price <= hi THEN price END), 4) AS normal_max, "
    "count(CASE WHEN price < lo OR price > hi THEN 1 END) AS outlier_count FROM t, (" + _BOUNDS.replace("{c}", "price") + ")",
)
def _(spark, folder):
    return rounded(Q.outlier_ranges(tails(spark, folder), ["price"]).drop("examples"), 4)


@query(
    "missing_issues",
    G + "SELECT name AS \"column\", CASE WHEN null_percentage > 30 THEN 'high' ELSE 'medium' END AS severity, null_count AS missing_count, "
    "CASE WHEN name IN ('total', 'cust', 'o_orderkey') THEN CASE WHEN (SELECT count(*) FROM g) >= 100 AND null_percentage < 40 "
    "THEN 'median_imputation,mean_imputation,knn_imputation' ELSE 'median_imputation,mean_imputation' END "
    "WHEN name = 'placed' THEN 'forward_fill,interpolation' "
    "WHEN unique_count <= 10 THEN 'mode_imputation,category_indicator,constant_imputation' ELSE 'mode_imputation,constant_imputation' END AS options "
    f"FROM ({_MISSING})",
)
def _(spark, folder):
    g = gaps(spark, folder)
    issues = Q.issue_frame(g, Q.missing_issues(g, P.profile(g, duplicates=False)))
    return issues.select(
        F.get("columns", F.lit(0)).alias("column"), "severity", F.col("details")["missing_count"].cast("bigint").alias("missing_count"),
        F.concat_ws(",", "options").alias("options"),
    )


@query(
    "issue_list",
    f"WITH t AS ({TAILS}) SELECT 'outliers' AS issue_type, 'medium' AS severity, 'price' AS columns, "
    "'keep_outliers,cap_outliers,remove_outliers' AS options FROM t, (" + _BOUNDS.replace("{c}", "price") + ") HAVING count(CASE WHEN price < lo OR price > hi THEN 1 END) > any_value(n) // 20 "
    "UNION ALL SELECT 'missing_values', 'medium', 'quantity', 'median_imputation,mean_imputation,knn_imputation' FROM t "
    "HAVING count(CASE WHEN l_orderkey % 5 = 0 THEN 1 END) BETWEEN 0.1 * count(*) AND 0.3 * count(*)",
)
def _(spark, folder):
    t = tails(spark, folder).withColumn("quantity", F.when(F.col("l_orderkey") % 5 != 0, F.col("quantity")))
    issues = Q.issue_frame(t, Q.find_issues(t, P.profile(t, duplicates=False)))
    return issues.select("issue_type", "severity", F.concat_ws(",", "columns").alias("columns"), F.concat_ws(",", "options").alias("options"))


_FILLED = " + ".join(f"count({c})" for c in COLUMNS)


@query(
    "completeness_score",
    G + f"SELECT count(*) AS rows, 6 * count(*) AS cells, {_FILLED} AS filled, round(({_FILLED}) / (6.0 * count(*)), 6) AS score, "
    "CAST(5 AS BIGINT) AS columns_with_nulls FROM g",
)
def _(spark, folder):
    return rounded(Q.completeness(gaps(spark, folder)))


# ---------------------------------------------------------------- rules


@query(
    "decision_rules",
    G + "SELECT name AS \"column\", CASE WHEN name IN ('total', 'cust', 'o_orderkey') THEN CASE WHEN null_percentage >= 5 AND null_percentage < 20 "
    "THEN 'knn_imputation' ELSE 'median_imputation' END WHEN null_percentage < 10 THEN 'mode_imputation' ELSE 'constant_imputation' END AS choice "
    f"FROM ({_MISSING})",
)
def _(spark, folder):
    g = gaps(spark, folder)
    choices = Q.decide(g, Q.missing_issues(g, P.profile(g, duplicates=False)))
    return spark.createDataFrame([(c, v) for (_, c), v in choices.items()], "column string, choice string")


@query("target_selection", "SELECT 'classification' AS task, 'status' AS target")
def _(spark, folder):
    g = gaps(spark, folder).select("o_orderkey", "status", "total")
    found = P.profile(g, duplicates=False, sample_key=["o_orderkey"])
    task = Q.problem_type_rule(found)
    return spark.createDataFrame([(task, Q.target_rule(found, task))], "task string, target string")


@query(
    "target_scores",
    "SELECT * FROM (VALUES ('o_orderkey', CAST(-15 AS BIGINT)), ('priority', CAST(8 AS BIGINT)), ('order_class', CAST(18 AS BIGINT))) AS t(option, score)",
)
def _(spark, folder):
    g = gaps(spark, folder).selectExpr("o_orderkey", "priority", "priority AS order_class")
    scored = Q.target_scores(Q.target_options(g, P.profile(g, duplicates=False, sample_key=["o_orderkey"])))
    return scored.select("option", F.col("score").cast("bigint").alias("score"))


@query(
    "task_estimates",
    "SELECT name, CASE WHEN u <= 2 THEN 'binary' WHEN u <= 10 THEN 'multiclass' ELSE 'regression' END AS task, "
    "CASE WHEN name IN ('l_returnflag', 'l_linestatus') OR u <= 20 THEN 'classification' ELSE 'regression' END AS training_task FROM ("
    + union_all("SELECT '{c}' AS name, count(DISTINCT {c}) AS u FROM lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]) + ")",
)
def _(spark, folder):
    t = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    rows = [
        (c.name, Q.task_estimate(c.unique_count), Q.training_task_estimate(c.kind, c.unique_count))
        for c in P.profile(t, duplicates=False).columns
    ]
    return spark.createDataFrame(rows, "name string, task string, training_task string")
