"""The registry of queries and shared input expressions.

None of the test tables holds a null, a duplicate row or a dirty text, so inputs are made from
them by expressions both engines understand, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_folders = count()


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    base = shared_folder(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{base}/{name}-{spark.sparkContext.applicationId}-{next(_folders)}"


def rounded(df: DataFrame, places: int = 6, /, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, special.get(n, places)) for n in doubles}) if doubles else df


def r(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def union_all(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)


# ---------------------------------------------------------------- inputs

GAPS = """
  o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS cust,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 11 < 8 THEN NULL ELSE o_orderdate END AS placed
"""

_KEY = "CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING)"
TEXTS = f"""
  o_orderkey,
  CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN '  $' || {_KEY} || '.25 '
    WHEN 4 THEN {_KEY} || '%' WHEN 5 THEN '€' || {_KEY} WHEN 6 THEN {_KEY} || 'e3' WHEN 7 THEN 'abc' || {_KEY} || 'x'
    WHEN 8 THEN ' Error ' WHEN 9 THEN '-' || {_KEY} || '.75' WHEN 10 THEN {_KEY} || ',500' ELSE {_KEY} END AS amount,
  CASE o_orderkey % 6 WHEN 0 THEN '"' || o_orderpriority || '"' WHEN 1 THEN '""' || o_orderpriority || '""'
    WHEN 2 THEN '\"\"\"' || o_orderpriority || '\"\"\"' WHEN 3 THEN ' "' || o_orderpriority || '" '
    WHEN 4 THEN '""' ELSE o_orderpriority END AS quoted,
  CASE o_orderkey % 8 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' n/a ' WHEN 2 THEN '  ' WHEN 3 THEN '#ERROR'
    ELSE ' ' || o_orderpriority || ' ' END AS worded,
  CASE o_orderkey % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f' WHEN 4 THEN '1'
    WHEN 5 THEN '0' WHEN 6 THEN 'on' WHEN 7 THEN NULL ELSE 'maybe' END AS flag,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(1500000000 + o_orderkey AS STRING) WHEN 1 THEN CAST(1500000000000 + o_orderkey AS STRING)
    WHEN 2 THEN CAST(o_orderkey AS STRING) ELSE '2020-01-01' END AS stamp
"""


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nulls in every column but the key."""
    return spark.sql("SELECT " + GAPS + " FROM {orders}", orders=table(spark, folder, "orders"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as dirty texts."""
    return spark.sql("SELECT " + TEXTS + " FROM {orders}", orders=table(spark, folder, "orders"))
