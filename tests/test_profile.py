"""Profiles, inference, decisions and the whole run."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean
from tablewright.operators import profile as P
from tablewright.operators import quality as Q
from tablewright.plans.cleaning import CleaningOptions, clean_table, dry_run


def inferred(spark, values, dtype="string", name="col"):
    rows = spark.createDataFrame([(v,) for v in values], f"`{name}` {dtype}")
    return P.profile(rows)[name].inferred_type


@pytest.mark.parametrize(
    "values,dtype,wanted",
    [
        ([None, None, None], "string", "unknown"),
        ([True, False, True], "boolean", "binary"),
        (["yes", "no", "yes", "no", "yes"], "string", "binary"),
        (["2024-01-01", "2024-02-01", "2024-03-05", "2024-04-09"], "string", "datetime"),
        ([1, 2, 3], "int", "numeric"),
        ([1.5, 2.5, 3.5], "double", "numeric"),
        (["100", "200", "300.5"], "string", "numeric"),
        (["red", "blue", "green", "red"], "string", "string"),
    ],
)
def test_inferred_types(spark, values, dtype, wanted):
    assert inferred(spark, values, dtype) == wanted


def test_text_and_identifier(spark):
    long = [f"This is a long sentence, number {i}, about nothing at all" for i in range(10)]
    assert inferred(spark, long, name="body") == "text"
    assert inferred(spark, [f"person{i}@example.org" for i in range(10)], name="col") == "identifier"


@pytest.mark.parametrize(
    "name,kind,unique,rows,wanted",
    [
        ("x", "identifier", 9, 10, "identifier"),
        ("uptime", "numeric", 5, 100, "target_candidate"),
        ("city", "string", 50, 100, "metadata"),
        ("x", "binary", 2, 100, "target_candidate"),
        ("x", "numeric", 20, 100, "target_candidate"),
        ("x", "numeric", 50, 101, "feature"),
    ],
)
def test_roles(name, kind, unique, rows, wanted):
    assert P.infer_role(name, kind, unique, rows) == wanted


def test_profile_ignores_partitioning(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("v"))

    def plain(table):
        # Means are sums of doubles, whose last digits depend on the order of additions.
        return [(c.name, c.unique_count, c.null_count, c.sample_values, c.inferred_type, c.inferred_role) for c in table.columns]

    assert plain(P.profile(rows.repartition(1))) == plain(P.profile(rows.repartition(17, "v")))


def test_duplicates_are_exact(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (None, 1), (2, 2), (2, 2), (2, 2)], "a int, b int")
    assert P.duplicate_rows(rows) == 3


def test_approximate_profile_needs_no_counts(spark):
    table = P.profile(spark.range(1000).select("id", (F.col("id") % 10).alias("k")), approximate=True)
    assert abs(table["k"].unique_count - 10) <= 1


def test_correct_types_keeps_columns_that_do_not_survive(spark):
    rows = spark.createDataFrame(
        [("$100.50", "10%", "yes", "x1"), ("$20.25", "5%", "no", "2"), ("$30.75", "n/a", "true", "y"), ("$1.10", "7%", "false", "z")],
        "price string, discount string, active string, amount_total string",
    )
    out, plan = clean.correct_types(rows)
    assert dict(out.dtypes) == {"price": "double", "discount": "int", "active": "boolean", "amount_total": "string"}
    assert {c.column for c in plan if not c.applied} <= {"amount_total"}


def test_rules():
    assert Q.imputation_rule("numeric", 3.0) == "median_imputation"
    assert Q.imputation_rule("numeric", 5.0) == "knn_imputation"
    assert Q.imputation_rule("numeric", 20.0) == "median_imputation"
    assert Q.imputation_rule("string", 9.0) == "mode_imputation"
    assert Q.imputation_rule("string", 10.0) == "constant_imputation"
    assert Q.imputation_options("numeric", 5, 99, 20.0) == ["median_imputation", "mean_imputation"]


def people(spark):
    """A small passenger list: quoted names, sparse cabin, missing ages."""
    return spark.range(0, 120, 1, 3).select(
        F.col("id").alias("passenger"),
        (F.col("id") % 2).cast("int").alias("survived"),
        F.concat(F.lit('"Doe, '), F.col("id").cast("string"), F.lit('"')).alias("full_name"),
        F.when(F.col("id") % 6 != 0, 20 + F.col("id") % 40).cast("string").alias("years"),
        F.when(F.col("id") % 10 == 0, "C1").alias("cabin"),
        F.when(F.col("id") % 7 == 0, "n/a").when(F.col("id") % 3 == 0, "S").otherwise("Q").alias("port"),
        F.when(F.col("id") == 3, 5000.0).otherwise((F.col("id") % 13).cast("double")).alias("fare"),
    )


def test_whole_run(spark):
    rows = people(spark)
    twice = rows.unionByName(rows.where("passenger < 20"))
    result = clean_table(twice, CleaningOptions(key="passenger", order_by="passenger"))
    assert result.summary["rows_before"] == 140 and result.summary["rows_after"] == 120
    assert result.summary["quality_after"] == 1.0
    assert "cabin" not in result.full.columns
    assert "full_name" in result.full.columns and "full_name" not in result.training.columns
    assert dict(result.full.dtypes)["years"] == "double"
    assert {"duplicates_removed", "column_removed", "value_imputed", "type_corrected"} <= {a.action_type for a in result.actions}
    again = clean_table(result.full, CleaningOptions(outlier_strategy="keep"))
    assert again.summary["rows_after"] == 120 and again.summary["columns_after"] == len(result.full.columns)


def test_run_honours_options(spark):
    rows = people(spark)
    kept = clean_table(rows, CleaningOptions(column_threshold=0.95, text_fill="constant", correct_types=False))
    assert "cabin" in kept.full.columns
    forced = clean_table(rows, CleaningOptions(key="passenger", decisions={("missing_values", "port"): "category_indicator"}))
    assert forced.full.where("port = 'Missing'").count() == rows.where("port = 'n/a'").count()
    with pytest.raises(ValueError):
        CleaningOptions(row_threshold=1.5)
    with pytest.raises(ValueError):
        CleaningOptions(outlier_strategy="shrug")


@pytest.mark.parametrize("rows", [[(1, "a", 2.0)], []])
def test_tiny_tables(spark, rows):
    table = spark.createDataFrame(rows, "id int, name string, value double")
    result = clean_table(table)
    assert result.full.count() == len(rows)


def test_dry_run_changes_nothing(spark):
    rows = people(spark)
    seen = dry_run(rows)
    assert [r["name"] if "name" in r else r[0] for r in seen["columns_to_drop"].collect()] == ["cabin"]
    assert rows.count() == 120
