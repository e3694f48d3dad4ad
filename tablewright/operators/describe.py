"""Summaries of numeric, categorical, text and time columns, and missingness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import trimmed
from tablewright.operators.profile import TableProfile, duplicate_rows, sample_skewness, value_counts
from tablewright.plans.aggregates import col, epoch_millis, kinds, measure, melt
from tablewright.plans.orderstats import interpolated_quantiles, numeric

# Limits of the summaries.
TOP_VALUES = 20
NUMERIC_BINS, TEXT_BINS = 32, 24
MIN_BINS, MAX_BINS = 5, 60
ROBUST_Z, ROBUST_SCALE = 3.5, 0.6745
DAY_MS = 86_400_000
BUCKET_MS = {"month": 30 * DAY_MS, "week": 7 * DAY_MS, "day": DAY_MS, "hour": 3_600_000, "minute": 60_000}

NUMERIC_SCHEMA = (
    "column string, n bigint, min double, max double, mean double, median double, std double, variance double, "
    "q1 double, q3 double, iqr double, skewness double, kurtosis double, mad double, "
    "iqr_outliers bigint, robust_outliers bigint"
)


# ---------------------------------------------------------------- numeric


def numeric_records(
    df: DataFrame, names: list[str], expressions: dict[str, Column] | None = None, outliers: bool = True
) -> list[dict]:
    """One record per column from three scans: moments, quartiles, then outlier counts."""
    value = {n: (expressions or {}).get(n, numeric(n)) for n in names}
    calls = {}
    for n, v in value.items():
        calls |= {
            (n, "n"): F.count(v), (n, "min"): F.min(v), (n, "max"): F.max(v), (n, "mean"): F.avg(v),
            (n, "var"): F.var_samp(v), (n, "skew"): F.skewness(v), (n, "kurt"): F.kurtosis(v),
        }
    seen = measure(df, calls)
    sizes = {n: seen[(n, "n")] for n in names}
    filled = [n for n in names if sizes[n]]
    quartiles = interpolated_quantiles(df, filled, [0.25, 0.5, 0.75], sizes, value)
    mads: dict = {}
    outside: dict = {}
    if outliers and filled:
        gaps = {n: F.abs(value[n] - F.lit(quartiles[n][1])) for n in filled}
        mads = {n: v[0] for n, v in interpolated_quantiles(df, filled, [0.5], sizes, gaps).items()}
        tests = {}
        for n in filled:
            q1, _, q3 = quartiles[n]
            reach = 1.5 * (q3 - q1)
            tests[(n, "iqr")] = F.count(F.when((value[n] < q1 - reach) | (value[n] > q3 + reach), 1))
            if mads[n] > 0:
                tests[(n, "z")] = F.count(F.when(gaps[n] * ROBUST_SCALE / mads[n] > ROBUST_Z, 1))
        outside = measure(df, tests)
    out = []
    for n in filled:
        size, var = sizes[n], seen[(n, "var")] or 0.0
        q1, median, q3 = quartiles[n]
        flat = var == 0.0
        shrink = (size - 1) / size
        out.append(
            {
                "column": n, "n": size, "min": seen[(n, "min")], "max": seen[(n, "max")], "mean": seen[(n, "mean")],
                "median": median, "std": math.sqrt(var), "variance": var, "q1": q1, "q3": q3, "iqr": q3 - q1,
                "skewness": 0.0 if flat else sample_skewness(seen[(n, "skew")], size),
                "kurtosis": 0.0 if flat else (seen[(n, "kurt")] + 3) * shrink**2 - 3,
                "mad": mads.get(n), "iqr_outliers": outside.get((n, "iqr")), "robust_outliers": outside.get((n, "z"), 0),
            }
        )
    return out


def numeric_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """Location, spread, shape and outlier counts per column (E2-E5, E7 of the inventory)."""
    rows = [tuple(r.values()) for r in numeric_records(df, names)]
    return df.sparkSession.createDataFrame(rows, NUMERIC_SCHEMA)


def bin_count(record: dict, limit: int) -> int:
    """Freedman-Diaconis bins, else Sturges, within the limits."""
    span = record["max"] - record["min"]
    n = record["n"]
    if n <= 1 or span < 2.220446049250313e-16:
        return 1
    width = 2.0 * abs(record["iqr"]) / n ** (1 / 3)
    wanted = math.ceil(span / width) if width > 0 else 0
    wanted = wanted or math.ceil(math.log2(n)) + 1
    return max(MIN_BINS, min(wanted, max(MIN_BINS, limit), MAX_BINS))


def histogram(
    df: DataFrame, records: list[dict], limit: int = NUMERIC_BINS, expressions: dict[str, Column] | None = None
) -> DataFrame:
    """``(column, bin, start, end, count)`` with equal-width bins, empty ones included.

    One pass counts all columns; the result holds at most 60 rows per column.
    """
    spans = {r["column"]: (r["min"], r["max"], bin_count(r, limit)) for r in records}
    if not spans:
        return df.sparkSession.createDataFrame([], "column string, bin int, start double, end double, count bigint")
    cells = []
    for n, (low, high, bins) in spans.items():
        v = (expressions or {}).get(n, numeric(n))
        width = (high - low) / bins
        at = F.lit(0) if bins == 1 else F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        cells.append(F.struct(F.lit(n).alias("column"), F.when(v.isNotNull(), at.cast("int")).alias("bin")))
    counted = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.column", "c.bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    frame = []
    for n, (low, high, bins) in spans.items():
        width = (high - low) / bins
        frame += [(n, i, low + i * width, high if bins == 1 else low + (i + 1) * width) for i in range(bins)]
    borders = df.sparkSession.createDataFrame(frame, "column string, bin int, start double, end double")
    return borders.join(counted, ["column", "bin"], "left").na.fill(0, ["count"])


def box_plot(df: DataFrame, names: list[str]) -> DataFrame:
    """Five numbers per column."""
    rows = [
        (r["column"], r["min"], r["q1"], r["median"], r["q3"], r["max"]) for r in numeric_records(df, names, outliers=False)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, min double, q1 double, median double, q3 double, max double")


# ---------------------------------------------------------------- categorical


def categorical_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """Cardinality, entropy (natural log), Gini impurity and imbalance per column."""
    n = F.col("n").cast("double")
    shape = value_counts(df, names).groupBy("column").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("cardinality"),
        F.sum(n * F.log(n)).alias("_nln"),
        F.sum(n * n).alias("_nn"),
        F.max("n").alias("_most"),
        F.min("n").alias("_least"),
    )
    total = F.col("total").cast("double")
    return shape.select(
        "column",
        "total",
        "cardinality",
        (F.log(total) - F.col("_nln") / total).alias("entropy"),
        (1 - F.col("_nn") / (total * total)).alias("gini"),
        F.when(F.col("cardinality") > 1, F.col("_most") / F.col("_least")).otherwise(1.0).alias("imbalance_ratio"),
    )


def top_values(df: DataFrame, names: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column with their share; ties in value order."""
    counted = value_counts(df, names)
    totals = counted.groupBy("column").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    best = counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.join(totals, "column").select(
        "column", "place", "value", F.col("n").alias("count"), (100.0 * F.col("n") / F.col("total")).alias("percentage")
    )


# ---------------------------------------------------------------- text


def text_lengths(names: list[str]) -> dict[str, Column]:
    """Byte lengths."""
    return {n: F.octet_length(col(n)).cast("double") for n in names}


def distinct_tokens(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct white-space separated tokens per column."""
    words = melt(df, names, "string").select(
        "column", F.explode(F.split(trimmed(F.col("value")), r"(?U)\s+")).alias("token")
    )
    return words.where("token != ''").distinct().groupBy("column").agg(F.count("*").alias("unique_tokens"))


def text_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """Byte lengths, blank shares and vocabulary size of text columns."""
    lengths = text_lengths(names)
    records = numeric_records(df, names, lengths, outliers=False)
    blanks = measure(
        df,
        {(n, "empty"): F.count(F.when(col(n) == "", 1)) for n in names}
        | {(n, "white"): F.count(F.when(trimmed(col(n)) == "", 1)) for n in names},
    )
    rows = [
        (
            r["column"], r["n"], int(r["min"]), int(r["max"]), r["mean"], r["median"],
            100.0 * blanks[(r["column"], "empty")] / r["n"], 100.0 * blanks[(r["column"], "white")] / r["n"],
        )
        for r in records
    ]
    base = df.sparkSession.createDataFrame(
        rows,
        "column string, n bigint, min_length bigint, max_length bigint, mean_length double, median_length double, "
        "empty_percentage double, whitespace_percentage double",
    )
    return base.join(distinct_tokens(df, names), "column", "left").na.fill(0, ["unique_tokens"])


def length_histogram(df: DataFrame, names: list[str]) -> DataFrame:
    lengths = text_lengths(names)
    return histogram(df, numeric_records(df, names, lengths, outliers=False), TEXT_BINS, lengths)


# ---------------------------------------------------------------- time


def granularity(range_days: Column) -> Column:
    return (
        F.when(range_days >= 730.0, "month")
        .when(range_days >= 120.0, "week")
        .when(range_days >= 2.0, "day")
        .when(range_days >= 0.1, "hour")
        .otherwise("minute")
    )


def datetime_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """First, last, range in days and the granularity of the time bins."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), epoch_millis(col(n)).alias("ms")) for n in names])
    ends = (
        df.select(F.explode(cells).alias("c"))
        .select("c.column", "c.ms")
        .groupBy("column")
        .agg(F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
        .where("min_ms is not null")
    )
    days = (F.col("max_ms") - F.col("min_ms")) / float(DAY_MS)
    return ends.select("column", "min_ms", "max_ms", days.alias("range_days"), granularity(days).alias("granularity"))


def time_bins(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, bucket_ms, count)``: fixed-width, epoch-aligned bins; empty bins are absent."""
    chosen = {r["column"]: r["granularity"] for r in datetime_summary(df, names).collect()}  # one row per column
    cells = []
    for n, g in chosen.items():
        ms = epoch_millis(col(n))
        cells.append(F.struct(F.lit(n).alias("column"), (ms - ms % BUCKET_MS[g]).alias("bucket_ms")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bucket_ms bigint, count bigint")
    return (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.column", "c.bucket_ms")
        .where("bucket_ms is not null")
        .groupBy("column", "bucket_ms")
        .agg(F.count("*").alias("count"))
    )


# ---------------------------------------------------------------- missingness and table summary


def missingness(df: DataFrame) -> DataFrame:
    """``(column, missing_count, missing_percentage)``."""
    seen = measure(df, {None: F.count(F.lit(1))} | {n: F.count(col(n)) for n in df.columns})
    rows = seen.pop(None)
    out = [(n, rows - filled, 100.0 * (rows - filled) / rows if rows else 0.0) for n, filled in seen.items()]
    return df.sparkSession.createDataFrame(out, "column string, missing_count bigint, missing_percentage double")


def co_missing(df: DataFrame) -> DataFrame:
    """``(x, y, count, percentage)`` of rows where both columns are null; the diagonal is each column's own rate.

    Rows are first folded to their null pattern, so the pairs of null positions are listed once
    per pattern and not per row.
    """
    names = df.columns
    pattern = F.array_compact(F.array(*[F.when(col(n).isNull(), F.lit(i)) for i, n in enumerate(names)]))
    patterns = df.select(pattern.alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    rows = df.count()
    both = (
        patterns.where(F.size("p") > 0)
        .select("p", "n", F.explode("p").alias("i"))
        .select("i", "n", F.explode("p").alias("j"))
        .groupBy("i", "j")
        .agg(F.sum("n").alias("count"))
    )
    grid = [(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names)]
    frame = df.sparkSession.createDataFrame(grid, "i int, j int, x string, y string")
    counted = frame.join(both, ["i", "j"], "left").na.fill(0, ["count"])
    return counted.select("x", "y", "count", (100.0 * F.col("count") / F.lit(float(max(1, rows)))).alias("percentage"))


def memory_estimate(df: DataFrame) -> Column:
    """Bytes of a row: byte length of texts, fixed widths otherwise."""
    widths = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "boolean": 1}
    total = F.lit(0).cast("bigint")
    for n, t in df.dtypes:
        size = F.octet_length(col(n)) if t == "string" else F.lit(widths.get(t, 8))
        total = total + F.coalesce(size.cast("bigint"), F.lit(0))
    return total


def table_summary(df: DataFrame, table: TableProfile | None = None) -> DataFrame:
    """One row: size, duplicates, missing cells, memory estimate."""
    nulls = F.lit(0).cast("bigint")
    for n in df.columns:
        nulls = nulls + F.count(F.when(col(n).isNull(), 1))
    rows = F.count(F.lit(1))
    copies = table.duplicate_count if table else duplicate_rows(df)
    cells = rows * F.lit(len(df.columns))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(F.sum(memory_estimate(df)), F.lit(0)).alias("memory_bytes"),
        F.lit(copies).cast("bigint").alias("duplicate_count"),
        F.coalesce(F.try_divide(F.lit(100.0 * copies), rows), F.lit(0.0)).alias("duplicate_percentage"),
        nulls.alias("missing_cells"),
        F.coalesce(F.try_divide(100.0 * nulls, cells), F.lit(0.0)).alias("missing_percentage"),
    )


def type_distribution(profiled: DataFrame) -> DataFrame:
    """Inferred types with their counts and shares, from a profile DataFrame."""
    total = profiled.count()
    return profiled.groupBy("inferred_type").agg(
        F.count("*").alias("count"), (100.0 * F.count("*") / F.lit(max(1, total))).alias("percentage")
    )


# ---------------------------------------------------------------- dispatch


def summary_kinds(table: TableProfile) -> dict[str, list[str]]:
    """Which summary blocks each column gets."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "text": [], "datetime": []}
    for c in table.columns:
        filled = c.rows - c.null_count
        few = filled > 0 and (c.unique_count <= 20 or c.unique_count / filled <= 0.1)
        if c.inferred_type == "numeric":
            out["numeric"].append(c.name)
        if c.inferred_type == "datetime":
            out["datetime"].append(c.name)
        if c.inferred_type == "string":
            out["text"].append(c.name)
        if (
            c.inferred_type in ("categorical", "binary", "boolean")
            or (c.inferred_type == "string" and few)
            or (c.inferred_type == "numeric" and c.unique_count <= 2)
        ):
            out["categorical"].append(c.name)
    return out


def column_statistics(df: DataFrame, table: TableProfile) -> dict[str, DataFrame]:
    """All summary blocks, the columns of one kind in one batch."""
    chosen = summary_kinds(table)
    kind = kinds(df)
    out: dict[str, DataFrame] = {}
    numbers = [n for n in chosen["numeric"] if kind[n] in ("numeric", "string")]
    if numbers:
        records = numeric_records(df, numbers)
        out["numeric"] = df.sparkSession.createDataFrame([tuple(r.values()) for r in records], NUMERIC_SCHEMA)
        out["histogram"] = histogram(df, records)
    if chosen["categorical"]:
        out["categorical"] = categorical_summary(df, chosen["categorical"])
        out["top_values"] = top_values(df, chosen["categorical"])
    if chosen["text"]:
        out["text"] = text_summary(df, chosen["text"])
        out["length_histogram"] = length_histogram(df, chosen["text"])
    times = [n for n in chosen["datetime"] if kind[n] == "datetime"]
    if times:
        out["datetime"] = datetime_summary(df, times)
        out["time_bins"] = time_bins(df, times)
    return out
