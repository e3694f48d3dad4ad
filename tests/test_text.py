"""Row-local cleaning against the known small cases and a plain Python model."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as X
from tablewright.operators import clean


def column(spark, values, change):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", change(F.col("v")).alias("o")).orderBy("i").collect()]


def test_to_double(spark):
    texts = ["1.5", "$1,234.56", "€100.50", "£999.99", "75%", "  42  ", " -3.14 ", "\t10.0\n", "-.5", "1e10", "2.5e-3", "1E6", "", "  ", None]
    wanted = [1.5, 1234.56, 100.5, 999.99, 75.0, 42.0, -3.14, 10.0, -0.5, 1e10, 2.5e-3, 1e6, None, None, None]
    assert column(spark, texts, X.to_double) == wanted
    assert column(spark, ["12abc", "a-b", "N/A", "inf", "12d", "1.2.3x"], X.to_double) == [12.0, None, None, None, 12.0, None]


def test_to_integer(spark):
    assert column(spark, ["1.9", "2.1", "-3.5", "1,000,000", "ERROR", "42", "N/A", "12abc"], X.to_integer) == [1, 2, -3, 1000000, None, 42, None, None]
    assert column(spark, ["1e30", "-1e30"], X.to_integer) == [2**63 - 1, -(2**63)]
    assert column(spark, ["3e9", "-3e9", "7", None], lambda c: X.to_integer(c, 32)) == [2**31 - 1, -(2**31), 7, None]


def test_booleans_and_epochs(spark):
    assert column(spark, ["yes", " F ", "1", "maybe", None], X.to_boolean) == [True, False, True, None, None]
    seconds = column(spark, ["1500000000", "1500000000000", "5", "2020-01-01"], lambda c: F.unix_millis(X.epoch_to_timestamp(c)))
    assert seconds == [1500000000000, 1500000000000, None, None]
    iso = column(spark, ["2020-01-01"], lambda c: X.iso_to_timestamp(c).cast("date").cast("string"))
    assert iso == ["2020-01-01"]


def strip_model(value):
    """Plain restatement of deep quote stripping."""
    text = value.strip()
    for _ in range(10):
        for mark in ('"""', '""', '"', "'"):
            if len(text) > 2 * len(mark) and text.startswith(mark) and text.endswith(mark):
                text = text[len(mark) : -len(mark)].strip()
                break
        else:
            break
    return text.replace('"""', "").replace('""', "").strip() or None


def test_strip_quotes(spark):
    texts = [
        '"""a"""', "''x''", '""', ' "a""b" ', "é", "'\"q\"'", '"' * 7, "'" * 31 + "z" + "'" * 31, '" b "', '"a', "a\"", "'", '""é""',
    ]
    wanted = [strip_model(t) for t in texts]
    assert column(spark, texts, X.strip_quotes) == wanted
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    assert [r["v"] for r in clean.strip_quotes(rows).orderBy("i").collect()] == wanted


def test_cleaning_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(v,) for v in ['"a"', " n/a ", "b ", None, "''"]], "v string")
    once = clean.repair_texts(rows)
    assert sorted(map(str, once.collect())) == sorted(map(str, clean.repair_texts(once).collect()))


def test_blank_missing_leaves_clean_columns_alone(spark):
    rows = spark.createDataFrame([(" a ", " a "), ("NA", "b ")], "dirty string, untouched string")
    out = clean.blank_missing(rows).orderBy("untouched").collect()
    assert [r["untouched"] for r in out] == [" a ", "b "]
    assert [r["dirty"] for r in out] == ["a", None]


@pytest.mark.parametrize("word,expected", [("on", True), ("Enabled", True), ("inactive", True), ("x", False)])
def test_boolean_words(spark, word, expected):
    assert column(spark, [word], X.is_boolean_word) == [expected]
