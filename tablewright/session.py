"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, app: str = "tablewright", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    n = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder: a machine-local folder
    would not survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and re.match(r"local(\[|$)", context.master):
        folder = _own_folders.get(context.applicationId)
        if folder is None:
            folder = _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="tablewright-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, which a cluster must name.

    Left uncut, row numbers and borders would be computed again by each job and could disagree.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if folder is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
