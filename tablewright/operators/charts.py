"""Chart and heatmap data as long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.describe import column_statistics, summary_kinds
from tablewright.operators.profile import TableProfile, profile

CHART_SCHEMA = "column string, series string, position int, label string, low double, high double, value double"
HEATMAP_COLUMNS = 30  # fixed value: columns shown at most
PIE_LEVELS = 6

# Value ranges of the heatmaps: (low, high, centre); None means the largest value.
DOMAINS = {
    "pearson": (-1.0, 1.0, 0.0),
    "spearman": (-1.0, 1.0, 0.0),
    "cramers_v": (0.0, 1.0, None),
    "chi_square": (0.0, None, None),
    "missingness": (0.0, 100.0, None),
}


def chart_kinds(table: TableProfile) -> dict[str, list[str]]:
    """Chart kinds allowed per column; the first one is the default."""
    chosen = summary_kinds(table)
    out = {}
    for c in table.columns:
        bars = ["bar", "pie"] if c.unique_count <= PIE_LEVELS else ["bar"]
        if c.inferred_type == "numeric" and 0 < c.unique_count <= 2:
            out[c.name] = bars
        elif c.inferred_type == "numeric":
            out[c.name] = ["histogram", "line"]
        elif c.inferred_type in ("categorical", "binary", "boolean"):
            out[c.name] = bars
        elif c.inferred_type == "string":
            out[c.name] = (bars if c.name in chosen["categorical"] else []) + ["histogram", "line"]
        elif c.inferred_type == "datetime":
            out[c.name] = ["time", "line"]
    return out


def chart_data(df: DataFrame, table: TableProfile) -> DataFrame:
    """All series of all charts, one row per bar, bin or box number."""
    blocks = column_statistics(df, table)
    none = F.lit(None)
    parts = []

    def rows(frame: DataFrame, series: str, position, label, low, high, value) -> None:
        parts.append(
            frame.select(
                "column", F.lit(series).alias("series"), position.cast("int").alias("position"),
                label.cast("string").alias("label"), low.cast("double").alias("low"),
                high.cast("double").alias("high"), value.cast("double").alias("value"),
            )
        )

    for name, series in (("histogram", "histogram"), ("length_histogram", "length")):
        if name in blocks:
            c = F.col
            rows(blocks[name], series, c("bin"), none, c("start"), c("end"), c("count"))
    if "numeric" in blocks:
        five = ["min", "q1", "median", "q3", "max"]
        box = blocks["numeric"].select(
            "column",
            F.posexplode(F.array(*[F.struct(F.lit(f).alias("label"), F.col(f).alias("value")) for f in five])).alias("p", "s"),
        )
        rows(box, "box", F.col("p"), F.col("s.label"), none, none, F.col("s.value"))
    if "top_values" in blocks:
        t = blocks["top_values"]
        rows(t, "categories", F.col("place") - 1, F.col("value"), none, F.col("percentage"), F.col("count"))
    if "time_bins" in blocks:
        rows(blocks["time_bins"], "time", none, none, F.col("bucket_ms"), none, F.col("count"))
    if not parts:
        return df.sparkSession.createDataFrame([], CHART_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def dashboard(tables: dict[str, DataFrame], shown: str | None = None) -> DataFrame:
    """All charts of the original and the processed table, named by ``dataset``.

    ``tables`` maps a dataset's name to its table; each has its own profile, as cleaning may
    change what a column is drawn as. ``shown`` asks for one dataset, which must be there.
    """
    if shown is not None and shown not in tables:
        raise ValueError(f"there is no {shown} table")
    names = [shown] if shown is not None else list(tables)
    parts = [
        chart_data(tables[n], profile(tables[n], duplicates=False, outliers=False)).select(F.lit(n).alias("dataset"), "*")
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def heatmap_view(matrix: DataFrame, kind: str, value: str = "value", limit: int = HEATMAP_COLUMNS) -> DataFrame:
    """A matrix cut to the first columns by name, with its value range."""
    # Labels are column names of one table, so this list is as short as its schema.
    labels = sorted(r["x"] for r in matrix.select("x").distinct().collect())
    shown = labels[: max(1, limit)]
    low, high, centre = DOMAINS[kind]
    if high is None:
        top = matrix.agg(F.max(value)).first()[0]
        high = max(1.0, top if top is not None else 1.0)
    return matrix.where(F.col("x").isin(shown) & F.col("y").isin(shown)).withColumns(
        {
            "range_low": F.lit(low), "range_high": F.lit(high), "range_centre": F.lit(centre).cast("double"),
            "total_columns": F.lit(len(labels)), "truncated": F.lit(len(labels) > limit),
        }
    )
