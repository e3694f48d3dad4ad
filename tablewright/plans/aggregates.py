"""Whole-table aggregates for many columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 150  # expressions per aggregate, so that generated code stays compilable


def kind_of(dtype: T.DataType) -> str:
    """Physical kind of a column: numeric, datetime, boolean, string or other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [name for name, k in kinds(df).items() if k == kind]


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def measure(df: DataFrame, expressions: dict[str, Column]) -> dict:
    """Evaluate named whole-table aggregates; one job per ``BATCH`` of them.

    Only one row per batch reaches the driver.
    """
    names = list(expressions)
    found: dict = {}
    for i in range(0, len(names), BATCH):
        part = names[i : i + BATCH]
        row: Row = df.agg(*[expressions[n].alias(f"a{j}") for j, n in enumerate(part)]).first()
        found.update({n: row[j] for j, n in enumerate(part)})
    return found


def epoch_millis(c: Column) -> Column:
    """Milliseconds since the epoch of a date or timestamp, read in UTC."""
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1000)


def melt(df: DataFrame, names: list[str], as_type: str) -> DataFrame:
    """Long form ``(column, value)`` of columns of one kind; nulls are kept."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), col(n).cast(as_type).alias("value")) for n in names]
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")
