"""Writing tables and reports."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.clean import scrub_output
from tablewright.operators.profile import TableProfile, complexity
from tablewright.operators.select import target_last
from tablewright.plans.aggregates import col
from tablewright.plans.analysis import Analysis
from tablewright.plans.cleaning import CleaningResult
from tablewright.sources.tables import column_info


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with header, written by the executors; blanks around values stay."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").csv(path, header=True, sep=",", quote='"', escape='"', **spaces)


def write_processed(df: DataFrame, path: str, target: str | None = None) -> None:
    """Processed data: target last, quotes scrubbed."""
    write_csv(scrub_output(target_last(df, target) if target else df), path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """Scored rows; arrays, maps, structs and vectors as JSON, binary as base 64."""
    shown = {}
    for f in scored.schema:
        c, kind = col(f.name), f.dataType
        if isinstance(kind, VectorUDT):
            shown[f.name] = F.to_json(vector_to_array(c))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            shown[f.name] = F.to_json(c)
        elif isinstance(kind, T.BinaryType):
            shown[f.name] = F.base64(c)
    write_csv(scored.withColumns(shown) if shown else scored, path)


def finite_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, with NaN and infinities as null."""
    changed = {
        n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n)) for n, t in df.dtypes if t in ("double", "float")
    }
    return df.withColumns(changed).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_analysis(analysis: Analysis, path: str) -> None:
    """Every result of an analysis as a JSON folder of its own."""
    for name, frame in analysis.frames.items():
        write_report(frame, f"{path.rstrip('/')}/{name}")


def _composition(table: TableProfile) -> list[Row]:
    counts: dict[str, int] = {}
    for c in table.columns:
        counts[c.inferred_type] = counts.get(c.inferred_type, 0) + 1
    width = max(1, len(table.columns))
    return [Row(inferred_type=t, count=k, percentage=round(100.0 * k / width, 1)) for t, k in sorted(counts.items())]


_COMPOSITION = "array<struct<inferred_type:string,count:bigint,percentage:double>>"
_ACTIONS = "array<struct<action_type:string,target:string,description:string,details:string>>"


def cleaning_report(df: DataFrame, result: CleaningResult) -> DataFrame:
    """One row: summary, composition, quality, actions and the reasons for the task."""
    bands = complexity(result.profile)
    row = (
        result.summary["rows_before"], result.summary["columns_before"], result.summary["rows_after"],
        len(result.training.columns), result.task, result.target, _composition(result.profile),
        result.profile.duplicate_count, [c.name for c in result.profile.columns if c.has_outliers],
        [(a.action_type, a.target, a.description, a.details) for a in result.actions],
        bands["size_category"], bands["feature_complexity"],
    )
    return df.sparkSession.createDataFrame(
        [row],
        "rows bigint, columns bigint, processed_rows bigint, processed_columns bigint, problem_type string, "
        f"target_column string, composition {_COMPOSITION}, duplicate_count bigint, outlier_columns array<string>, "
        f"cleaning_actions {_ACTIONS}, size_category string, feature_complexity string",
    )


def comprehensive_report(df: DataFrame, result: CleaningResult) -> DataFrame:
    """The cleaning report plus before and after, decisions and column summaries."""
    s = result.summary
    final = dict(result.full.dtypes)
    removed_rows, removed_columns = s["rows_before"] - s["rows_after"], s["columns_before"] - s["columns_after"]
    row = (
        *[s[k] for k in ("rows_before", "rows_after", "columns_before", "columns_after", "issues_found", "issues_remaining")],
        removed_rows, 100.0 * removed_rows / max(1, s["rows_before"]),
        removed_columns, 100.0 * removed_columns / max(1, s["columns_before"]),
        s["quality_before"], s["quality_after"], 100.0 * (s["quality_after"] - s["quality_before"]),
        [c.name for c in result.profile.columns if c.null_percentage > 50.0],
        {f"{kind}:{name}" if name else kind: choice for (kind, name), choice in result.decisions.items()},
        [(n, t, final.get(n), n not in final) for n, t in df.dtypes],
        result.warnings, result.profile.target_candidates,
    )
    extra = df.sparkSession.createDataFrame(
        [row],
        "rows_before bigint, rows_after bigint, columns_before bigint, columns_after bigint, issues_found bigint, "
        "issues_remaining bigint, rows_removed bigint, rows_removed_percent double, columns_removed bigint, "
        "columns_removed_percent double, quality_before double, quality_after double, quality_improvement double, "
        "high_null_columns array<string>, decisions map<string,string>, "
        "column_summaries array<struct<name:string,original_type:string,final_type:string,removed:boolean>>, "
        "warnings array<string>, target_candidates array<string>",
    )
    # Both sides are single rows about the run.
    return cleaning_report(df, result).withColumn("_one", F.lit(1)).join(extra.withColumn("_one", F.lit(1)), "_one").drop("_one")


def export_report(source: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: row counts of both tables, and type and nulls of each processed column."""
    info = column_info(processed)
    shape = info.agg(F.collect_list(F.struct("name", "dtype", "null_count")).alias("columns"))
    return shape.select(
        F.lit(source.count()).alias("source_rows"), F.lit(len(source.columns)).alias("source_columns"),
        F.lit(processed.count()).alias("processed_rows"), F.lit(len(processed.columns)).alias("processed_columns"), "columns",
    )
