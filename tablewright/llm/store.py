"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame

from tablewright.session import shared_folder

_tables = count()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    The lineage ends there: later jobs see the same rows even if executors are lost, and nothing
    above is computed twice.
    """
    spark = df.sparkSession
    base = shared_folder(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{base.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{next(_tables)}"
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table that ``written`` returned, once nothing that is still to be computed reads it."""
    context = stored.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
