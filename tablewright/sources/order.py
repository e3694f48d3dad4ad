"""The order in which rows stand in their files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def has_file_order(df: DataFrame) -> bool:
    """Whether the rows of ``df`` still know their files: a scan, with filters and projections at most."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return False
    return True


def with_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    """``df`` with the number of each row, from 0, by file path, then by place in the file.

    A row is numbered inside the split that the reader gave it, and splits, one row each, pass on
    how many rows stand before them; so no row moves to be numbered, and the numbers are the
    same however files are split. Raises ValueError where rows don't come straight from files.
    """
    if not has_file_order(df):
        raise ValueError("rows have no place in a file; give an order key")
    stamped = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    splits = stamped.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    numbered = stamped.join(starts, ["_file", "_block"])
    return numbered.withColumn(name, F.col("_at") + F.col("_start")).drop("_file", "_block", "_at", "_start")
