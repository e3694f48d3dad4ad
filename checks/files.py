"""Readers, writers, reports and streams."""

from pyspark.sql import functions as F

from checks.cleaning import MISSING, T, trim_sql
from checks.profiling import TAILS
from checks.registry import gaps, query, rounded, scratch, table, texts
from tablewright.operators import outliers as O
from tablewright.plans.analysis import analyze
from tablewright.plans.cleaning import CleaningOptions, clean_table
from tablewright.sources import reports
from tablewright.sources.tables import read_csv, read_csv_tolerant, read_scoring_csv
from tablewright.streaming.rowlocal import clean_rows, write_stream


@query("csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, folder):
    path = scratch(spark, "orders-csv")
    reports.write_csv(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return read_csv(spark, path)


@query("csv_line_breaks", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, folder):
    path = scratch(spark, "documents-csv")
    reports.write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return read_csv(spark, path)


@query("csv_tolerant_scan", "SELECT CAST(o_orderkey AS STRING) || ',x' AS id, o_orderpriority AS priority FROM orders")
def _(spark, folder):
    path = scratch(spark, "messy-csv")
    line = F.concat(F.lit('""'), F.col("o_orderkey").cast("string"), F.lit(',x"",'), F.col("o_orderpriority"))
    blank = F.when(F.col("o_orderkey") % 2 == 0, F.lit("   "))
    lines = table(spark, folder, "orders").select(F.explode(F.array_compact(F.array(line, blank))).alias("value"))
    head = spark.createDataFrame([("id,priority",)], "value string")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)
    return read_csv_tolerant(spark, path)


@query(
    "processed_sink",
    T + f"SELECT o_orderkey, nullif({trim_sql('replace(' + trim_sql('worded') + ', chr(34), chr(39))')}, '') AS worded FROM t",
)
def _(spark, folder):
    path = scratch(spark, "processed")
    reports.write_processed(texts(spark, folder).select("worded", "o_orderkey"), path, target="worded")
    return read_csv(spark, path)


@query("prediction_sink", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS prediction FROM orders")
def _(spark, folder):
    path = scratch(spark, "predictions")
    label = F.when(F.col("o_totalprice") > 250000, "high").otherwise("low")
    reports.write_predictions(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", label.alias("prediction")), path)
    return read_csv(spark, path)


@query("scoring_scan", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, folder):
    path = scratch(spark, "scoring")
    reports.write_csv(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return read_scoring_csv(spark, path, ["o_orderkey", "o_totalprice"])


@query("json_rows", "SELECT count(*) AS rows, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS nulls FROM orders")
def _(spark, folder):
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    rows = reports.finite_json(table(spark, folder, "orders").select("o_orderkey", odd.alias("v")))
    return rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("value").contains('"v":null'), 1)).alias("nulls"))


@query("analysis_report", "SELECT 'event_id' AS \"column\", CAST(0 AS BIGINT) AS missing_count UNION ALL SELECT 'event_type', 0 UNION ALL SELECT 'value', 0")
def _(spark, folder):
    path = scratch(spark, "analysis")
    reports.write_analysis(analyze(table(spark, folder, "events").select("event_id", "event_type", "value")), path)
    return spark.read.json(f"{path}/missingness").select("column", "missing_count")


def _run(spark, folder):
    g = gaps(spark, folder).drop("placed")
    g = g.unionByName(g.where("o_orderkey % 3 = 0"))
    return g, clean_table(g, CleaningOptions(decisions={("missing_values", "total"): "mean_imputation"}))


@query(
    "cleaning_report",
    "SELECT count(*) + count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS rows, CAST(5 AS BIGINT) AS columns, count(*) AS processed_rows, 'regression' AS problem_type FROM orders",
)
def _(spark, folder):
    g, result = _run(spark, folder)
    path = scratch(spark, "report")
    reports.write_report(reports.cleaning_report(g, result), path)
    return spark.read.json(path).select("rows", "columns", "processed_rows", "problem_type")


@query(
    "comprehensive_report",
    "SELECT count(*) + count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS rows_before, count(*) AS rows_after, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS rows_removed, "
    "1.0::DOUBLE AS quality_after FROM orders",
)
def _(spark, folder):
    g, result = _run(spark, folder)
    return reports.comprehensive_report(g, result).select("rows_before", "rows_after", "rows_removed", "quality_after")


@query(
    "export_report",
    "SELECT count(*) + count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS source_rows, CAST(5 AS INTEGER) AS source_columns, count(*) AS processed_rows, "
    "CAST(5 AS INTEGER) AS processed_columns, CAST(0 AS BIGINT) AS nulls FROM orders",
)
def _(spark, folder):
    g, result = _run(spark, folder)
    nulls = F.aggregate(F.col("columns")["null_count"], F.lit(0).cast("bigint"), lambda a, b: a + b)
    return reports.export_report(g, result.full).withColumn("nulls", nulls).drop("columns")


# ---------------------------------------------------------------- streams


@query(
    "stream_clean_rows",
    T + f"SELECT o_orderkey, CASE WHEN lower({trim_sql('worded')}) NOT IN {MISSING} THEN {trim_sql('worded')} END AS worded FROM t",
)
def _(spark, folder):
    source, sink = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    texts(spark, folder).select("o_orderkey", "worded").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    write_stream(clean_rows(stream), sink, sink + "-checkpoint").awaitTermination()
    return spark.read.parquet(sink)


@query(
    "stream_cap_outliers",
    f"WITH t AS ({TAILS}) SELECT l_orderkey, l_linenumber, round(least(greatest(price, lo), hi), 4) AS price FROM t, "
    "(SELECT list(price ORDER BY price)[CAST(floor(count(*) * 0.05) AS BIGINT) + 1] AS lo, list(price ORDER BY price)[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS hi FROM t)",
)
def _(spark, folder):
    source, sink = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    rows = spark.sql(TAILS.replace("lineitem", "{lineitem}"), lineitem=table(spark, folder, "lineitem")).drop("quantity")
    rows.write.parquet(source)
    stored = spark.read.parquet(source)
    bounds = O.cap_bounds(stored, ["price"])
    stream = spark.readStream.schema(stored.schema).parquet(source)
    write_stream(O.apply_caps(stream, bounds), sink, sink + "-checkpoint").awaitTermination()
    return rounded(spark.read.parquet(sink), 4)
