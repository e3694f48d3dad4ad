"""Selection, cleaning and type correction."""

from pyspark.sql import functions as F

from checks.registry import GAPS, TEXTS, gaps, query, rounded, table, texts, union_all
from tablewright.functions import text as X
from tablewright.operators import clean, select
from tablewright.operators.profile import profile

G = f"WITH g AS (SELECT {GAPS} FROM orders) "
T = f"WITH t AS (SELECT {TEXTS} FROM orders) "


def trim_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def number_sql(c: str) -> str:
    return f"regexp_replace({trim_sql(c)}, '[,$%€£ ]', '', 'g')"


FLOAT = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
ERRORS = "('error','unknown','n/a','na','null','missing','none','#n/a')"
MISSING = "('unknown','error','n/a','na','null','none','missing','nan','#n/a','#error','')"


def parse_sql(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{FLOAT}') THEN TRY_CAST({c} AS DOUBLE) END"


def readable_sql(c: str) -> str:
    return f"({trim_sql(c)} <> '' AND lower({trim_sql(c)}) NOT IN {ERRORS})"


def double_sql(c: str) -> str:
    n = number_sql(c)
    kept = f"regexp_replace({n}, '[^0-9.\\-]', '', 'g')"
    return f"CASE WHEN {readable_sql(c)} THEN coalesce({parse_sql(n)}, {parse_sql(kept)}) END"


def whole_sql(c: str) -> str:
    return f"CASE WHEN {readable_sql(c)} THEN CAST(trunc({parse_sql(number_sql(c))}) AS BIGINT) END"


# ---------------------------------------------------------------- projection, ranges, samples


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, folder):
    return select.select_columns(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])


@query("exclude_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, folder):
    return select.exclude_columns(table(spark, folder, "orders"), ["o_orderdate", "o_orderpriority"], target="o_totalprice")


@query("row_range", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 600")
def _(spark, folder):
    return select.row_range(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 600, 1000, "o_orderkey")


@query(
    "page_of_rows",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey "
    "LIMIT 50 OFFSET (SELECT count(*) - 1 FROM orders)",
)
def _(spark, folder):
    rows, total = select.page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 10**9, 50, "o_orderkey")
    return rows.withColumn("total", F.lit(total))


@query("target_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(spark, folder):
    return select.target_last(table(spark, folder, "orders").select("o_totalprice", "o_orderkey", "o_custkey"), "o_totalprice")


@query("drop_date_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    inferred = profile(orders, duplicates=False).inferred
    return select.drop_date_columns(orders, inferred, "classification", "o_orderstatus")


@query("split_identifiers", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(spark, folder):
    supplier = table(spark, folder, "supplier")
    return select.split_identifiers(supplier, profile(supplier, duplicates=False).inferred)[0]


@query(
    "preview_rows",
    G + "SELECT o_orderkey, total, cust, status, priority FROM g ORDER BY o_orderkey LIMIT 5",
)
def _(spark, folder):
    return select.preview_rows(gaps(spark, folder), ["o_orderkey", "total", "cust", "status", "priority", "placed"], "o_orderkey")


@query("sample_values")
def _(spark, folder):
    drawn = select.sample_values(gaps(spark, folder), key=["o_orderkey"])
    return spark.createDataFrame(list(drawn.items()), "column string, samples array<string>")


# ---------------------------------------------------------------- rows and columns

COPIES = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0"


@query("drop_duplicate_rows", f"SELECT DISTINCT * FROM ({COPIES})")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return clean.drop_duplicate_rows(orders.unionByName(orders.where("o_orderkey % 3 = 0")))


@query("drop_sparse_columns", G + "SELECT o_orderkey, total, cust, status, priority FROM g")
def _(spark, folder):
    return clean.drop_sparse_columns(gaps(spark, folder))


_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ("total", "cust", "status", "priority", "placed"))


@query("drop_sparse_rows", G + f"SELECT total, cust, status, priority, placed FROM g WHERE ({_NULLS}) / 5.0 <= 0.4")
def _(spark, folder):
    return clean.drop_sparse_rows(gaps(spark, folder).drop("o_orderkey"), 0.4)


@query(
    "auto_clean",
    G + ", d AS (SELECT DISTINCT * FROM (SELECT * FROM g UNION ALL SELECT * FROM g WHERE o_orderkey % 3 = 0)) "
    "SELECT o_orderkey, total, cust, status, priority FROM d WHERE "
    "(CASE WHEN total IS NULL THEN 1 ELSE 0 END + CASE WHEN cust IS NULL THEN 1 ELSE 0 END + "
    "CASE WHEN status IS NULL THEN 1 ELSE 0 END + CASE WHEN priority IS NULL THEN 1 ELSE 0 END) / 5.0 <= 0.5",
)
def _(spark, folder):
    g = gaps(spark, folder)
    return clean.auto_clean(g.unionByName(g.where("o_orderkey % 3 = 0")), row_threshold=0.5)[0]


@query(
    "auto_clean_log",
    "SELECT 'duplicates_removed' AS action_type, 'dataset' AS target, "
    "'Removed ' || count(*) || ' duplicate rows' AS description FROM orders WHERE o_orderkey % 3 = 0 "
    "UNION ALL SELECT 'column_removed', 'placed', 'Dropped column ''placed'''",
)
def _(spark, folder):
    g = gaps(spark, folder)
    log = clean.auto_clean(g.unionByName(g.where("o_orderkey % 3 = 0")))[1]
    return clean.action_frame(g, log).select("action_type", "target", "description")


# ---------------------------------------------------------------- texts

_QUOTES = trim_sql("replace(replace(regexp_replace(regexp_replace(" + trim_sql("quoted") + ", "
    + "'^\"\"\"(.+)\"\"\"$', '\\1'), '^\"{1,2}([^\"].*[^\"])\"{1,2}$', '\\1'), '\"\"\"', ''), '\"\"', '')")


@query("strip_quotes", T + f"SELECT o_orderkey, nullif({_QUOTES}, '') AS quoted FROM t")
def _(spark, folder):
    return clean.strip_quotes(texts(spark, folder).select("o_orderkey", "quoted"))


@query(
    "blank_missing",
    T + f"SELECT o_orderkey, CASE WHEN lower({trim_sql('worded')}) NOT IN {MISSING} THEN {trim_sql('worded')} END AS worded, "
    "quoted FROM (SELECT o_orderkey, worded, CASE WHEN quoted = '\"\"' THEN 'x ' ELSE quoted END AS quoted FROM t)",
)
def _(spark, folder):
    t = texts(spark, folder).withColumn("quoted", F.expr("CASE WHEN quoted = '\"\"' THEN 'x ' ELSE quoted END"))
    return clean.blank_missing(t.select("o_orderkey", "worded", "quoted"))


@query("text_to_double", T + f"SELECT o_orderkey, {double_sql('amount')} AS value FROM t")
def _(spark, folder):
    return texts(spark, folder).select("o_orderkey", X.to_double(F.col("amount")).alias("value"))


@query(
    "text_to_integer",
    T + f"SELECT o_orderkey, {whole_sql('amount')} AS whole, CAST(CASE WHEN {whole_sql('amount')} IS NOT NULL THEN "
    f"least(greatest({whole_sql('amount')}, -2147483648), 2147483647) END AS INTEGER) AS small FROM t",
)
def _(spark, folder):
    return texts(spark, folder).select(
        "o_orderkey", X.to_integer(F.col("amount")).alias("whole"), X.to_integer(F.col("amount"), 32).alias("small")
    )


_N = "TRY_CAST(stamp AS BIGINT)"


@query(
    "epoch_to_timestamp",
    T + f"SELECT o_orderkey, epoch_ms(CASE WHEN {_N} > 1000000000 AND {_N} < 2000000000 THEN {_N} * 1000 "
    f"WHEN {_N} > 1000000000000 AND {_N} < 2000000000000 THEN {_N} END) AS stamp FROM t",
)
def _(spark, folder):
    return texts(spark, folder).select("o_orderkey", X.epoch_to_timestamp(F.col("stamp")).cast("timestamp_ntz").alias("stamp"))


@query(
    "text_to_boolean",
    T + f"SELECT o_orderkey, CASE WHEN lower({trim_sql('flag')}) IN ('true','t','yes','y','1') THEN true "
    f"WHEN lower({trim_sql('flag')}) IN ('false','f','no','n','0') THEN false END AS flag FROM t",
)
def _(spark, folder):
    return texts(spark, folder).select("o_orderkey", X.to_boolean(F.col("flag")).alias("flag"))


@query(
    "number_text_helpers",
    T + f"SELECT o_orderkey, {number_sql('amount')} AS cleaned, {parse_sql(number_sql('amount'))} AS parsed, "
    f"regexp_full_match({number_sql('amount')}, '{FLOAT}') AS is_number, "
    f"coalesce(regexp_full_match({number_sql('amount')}, '{FLOAT}') AND (contains({number_sql('amount')}, '.') OR "
    f"{parse_sql(number_sql('amount'))} % 1 <> 0), false) AS is_float FROM t",
)
def _(spark, folder):
    a = F.col("amount")
    return texts(spark, folder).select(
        "o_orderkey", X.number_text(a).alias("cleaned"), X.parse_number(a).alias("parsed"),
        X.is_number(a).alias("is_number"), X.looks_like_float(a).alias("is_float"),
    )


_WIDE = "('true','yes','1','t','y','on','enabled','active','false','no','0','f','n','off','disabled','inactive')"


@query(
    "marker_helpers",
    T + f"SELECT o_orderkey, lower({trim_sql('amount')}) IN {ERRORS} AS is_error, lower({trim_sql('flag')}) IN {_WIDE} AS is_flag FROM t",
)
def _(spark, folder):
    return texts(spark, folder).select(
        "o_orderkey", X.is_error_marker(F.col("amount")).alias("is_error"), X.is_boolean_word(F.col("flag")).alias("is_flag")
    )


_RATIO = (
    "SELECT '{c}' AS \"column\", count(*) AS checked, CAST(sum(CASE WHEN regexp_full_match("
    + number_sql("{c}") + f", '{FLOAT}') THEN 1 ELSE 0 END) AS BIGINT) AS numeric "
    "FROM t WHERE " + readable_sql("{c}")
)


@query("numeric_ratio", T + "SELECT *, round(numeric / checked, 6) AS ratio FROM (" + union_all(_RATIO, ["amount", "flag", "stamp"]) + ")")
def _(spark, folder):
    return rounded(clean.numeric_ratio(texts(spark, folder), ["amount", "flag", "stamp"]))


@query("late_numeric_cast", T + f"SELECT o_orderkey, {parse_sql(trim_sql('amount'))} AS amount FROM t")
def _(spark, folder):
    return clean.late_numeric_cast(texts(spark, folder).select("o_orderkey", "amount"), {"amount": "numeric"})


_SCRUBBED = trim_sql(f"replace({trim_sql('quoted')}, chr(34), '')")


@query("scrub_output", T + f"SELECT o_orderkey, nullif({_SCRUBBED}, '') AS quoted FROM t")
def _(spark, folder):
    return clean.scrub_output(texts(spark, folder).select("o_orderkey", "quoted"))


# ---------------------------------------------------------------- type correction

_BLANKED = "CASE WHEN lower({t}) NOT IN " + MISSING + " THEN {t} END"


@query(
    "correct_types",
    T + f", b AS (SELECT o_orderkey, {_BLANKED.replace('{t}', trim_sql('amount'))} AS amount, "
    f"{_BLANKED.replace('{t}', trim_sql('worded'))} AS worded FROM t) "
    f"SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST({whole_sql('amount')} AS INTEGER) AS amount, worded FROM b",
)
def _(spark, folder):
    return clean.correct_types(texts(spark, folder).select("o_orderkey", "amount", "worded"))[0]


@query(
    "guarded_casts",
    T + f", b AS (SELECT o_orderkey, {_BLANKED.replace('{t}', trim_sql('amount'))} AS amount, {_BLANKED.replace('{t}', trim_sql('stamp'))} AS stamp FROM t) "
    "SELECT 'o_orderkey' AS \"column\", 'bigint' AS source, 'int' AS target, count(o_orderkey) AS survived, count(o_orderkey) AS non_null, "
    "true AS applied FROM b UNION ALL "
    f"SELECT 'amount', 'string', 'int', count({whole_sql('amount')}), count(amount), count({whole_sql('amount')}) > 0.7 * count(amount) FROM b UNION ALL "
    f"SELECT 'stamp', 'string', 'bigint', count({whole_sql('stamp')}), count(stamp), count({whole_sql('stamp')}) > 0.7 * count(stamp) FROM b",
)
def _(spark, folder):
    t = texts(spark, folder).select("o_orderkey", "amount", "stamp")
    plan = clean.correct_types(t)[1]
    return clean.cast_frame(t, plan).drop("rate")


@query("type_mismatches", "SELECT 'amount' AS \"column\", 'string' AS stored, 'numeric' AS inferred")
def _(spark, folder):
    t = texts(spark, folder).select("o_orderkey", "amount", "worded")
    return clean.type_mismatches(t, profile(t, duplicates=False))
