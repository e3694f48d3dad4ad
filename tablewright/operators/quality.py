"""Quality issues, scores, and the rules that decide what to do about them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import words as W
from tablewright.operators.profile import ColumnProfile, TableProfile, iqr_bounds
from tablewright.plans.aggregates import col, kinds, measure
from tablewright.plans.orderstats import numeric, values_at


@dataclass
class Issue:
    issue_type: str
    severity: str
    columns: list[str]
    description: str
    details: dict[str, str] = field(default_factory=dict)
    options: list[str] = field(default_factory=list)


ISSUE_SCHEMA = (
    "issue_type string, severity string, columns array<string>, description string, "
    "details map<string,string>, options array<string>"
)


def issue_frame(df: DataFrame, issues: list[Issue]) -> DataFrame:
    rows = [(i.issue_type, i.severity, i.columns, i.description, i.details, i.options) for i in issues]
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def outlier_ranges(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: bounds, the normal range inside them, outlier counts, extreme examples."""
    sizes = measure(df, {n: F.count(numeric(n)) for n in names})
    names = [n for n in names if sizes[n]]
    bounds = iqr_bounds(df, names, sizes)
    calls = {}
    for n, (lo, hi) in bounds.items():
        v = numeric(n)
        calls[(n, "min")] = F.min(F.when(v >= lo, v))
        calls[(n, "max")] = F.max(F.when(v <= hi, v))
        calls[(n, "low")] = F.count(F.when(v < lo, 1))
        calls[(n, "high")] = F.count(F.when(v > hi, 1))
    seen = measure(df, calls)
    ends = {
        n: [*range(min(3, seen[(n, "low")])), *range(sizes[n] - min(3, seen[(n, "high")]), sizes[n])] for n in names
    }
    at = values_at(df, {n: r for n, r in ends.items() if r}, sizes)
    rows = []
    for n, (lo, hi) in bounds.items():
        examples = [at[(n, r)] for r in ends[n]][:5]
        count = seen[(n, "low")] + seen[(n, "high")]
        rows.append((n, lo, hi, seen[(n, "min")], seen[(n, "max")], count, examples))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, lower_bound double, upper_bound double, normal_min double, normal_max double, "
        "outlier_count bigint, examples array<double>",
    )


def outlier_issues(df: DataFrame, table: TableProfile) -> list[Issue]:
    names = [c.name for c in table.columns if c.inferred_type == "numeric" and c.has_outliers and c.kind == "numeric"]
    if not names:
        return []
    details, parts = {}, []
    for r in outlier_ranges(df, names).collect():  # one row per flagged column
        shown = ", ".join(f"{v:.2f}" for v in r["examples"])
        usual = f"{r['normal_min']:.2f} to {r['normal_max']:.2f}"
        details[f"{r['column']}.normal_range"] = usual
        details[f"{r['column']}.outlier_count"] = str(r["outlier_count"])
        details[f"{r['column']}.outlier_examples"] = shown
        parts.append(f"{r['column']}: usually {usual}, {r['outlier_count']} outliers such as {shown}")
    options = ["keep_outliers", "cap_outliers", "remove_outliers"]
    return [Issue("outliers", "medium", names, "; ".join(parts), details, options)]


def imputation_options(kind: str, unique_count: int, rows: int, missing_pct: float) -> list[str]:
    """Ways to fill a column, the preferred one first."""
    if kind == "numeric":
        options = ["median_imputation", "mean_imputation"]
        return options + (["knn_imputation"] if rows >= 100 and missing_pct < 40.0 else [])
    if kind == "string":
        indicator = ["category_indicator"] if unique_count <= 10 else []
        return ["mode_imputation", *indicator, "constant_imputation"]
    if kind == "datetime":
        return ["forward_fill", "interpolation"]
    return ["constant_imputation"]


def suggested_neighbours(rows: int) -> int:
    return min(10, max(3, int(rows**0.5)))


def missing_issues(df: DataFrame, table: TableProfile) -> list[Issue]:
    """Columns with more than 10 and at most 50 percent nulls, identifiers excepted."""
    kind = kinds(df)
    out = []
    for c in table.columns:
        pct = c.null_percentage
        if c.name not in kind or not 10.0 < pct <= 50.0 or c.inferred_role == "identifier":
            continue
        details = {
            "column_name": c.name,
            "actual_dtype": kind[c.name],
            "inferred_type": c.inferred_type,
            "missing_count": str(c.null_count),
            "missing_percentage": repr(pct),
            "total_rows": str(table.rows),
            "unique_values": str(c.unique_count),
            "sample_values": ", ".join(c.sample_values[:5]) or "No non-null values",
        }
        options = imputation_options(kind[c.name], c.unique_count, table.rows, pct)
        if "knn_imputation" in options:
            details["suggested_neighbours"] = str(suggested_neighbours(table.rows))
        text = f"Column '{c.name}' misses {pct:.1f}% of its values ({c.null_count} of {table.rows} rows)"
        out.append(Issue("missing_values", "high" if pct > 30.0 else "medium", [c.name], text, details, options))
    return out


def find_issues(df: DataFrame, table: TableProfile) -> list[Issue]:
    return outlier_issues(df, table) + missing_issues(df, table)


# ---------------------------------------------------------------- scores


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, cells, filled cells, their share (0 for an empty table), columns with nulls."""
    filled, open_columns = F.lit(0).cast("bigint"), F.lit(0)
    for n in df.columns:
        filled = filled + F.count(col(n))
        open_columns = open_columns + (F.count(col(n)) < F.count(F.lit(1))).cast("int")
    rows = F.count(F.lit(1))
    cells = rows * F.lit(len(df.columns))
    return df.agg(
        rows.alias("rows"),
        cells.alias("cells"),
        filled.alias("filled"),
        F.coalesce(F.try_divide(filled.cast("double"), cells.cast("double")), F.lit(0.0)).alias("score"),
        open_columns.cast("bigint").alias("columns_with_nulls"),
    )


# ---------------------------------------------------------------- rules


def imputation_rule(kind: str, missing_pct: float) -> str:
    if kind == "numeric":
        return "knn_imputation" if 5.0 <= missing_pct < 20.0 else "median_imputation"
    return "mode_imputation" if missing_pct < 10.0 else "constant_imputation"


def problem_type_rule(table: TableProfile) -> str:
    """The first target candidate that settles the question; classification otherwise."""
    for c in table.columns:
        if c.inferred_role == "target_candidate":
            if c.unique_count <= 10 or c.inferred_type == "binary":
                return "classification"
            if c.inferred_type == "numeric":
                return "regression"
    return "classification"


def target_rule(table: TableProfile, task: str, configured: str | None = None) -> str | None:
    """The configured target if present, else the best candidate, else the last usable column."""
    names = [c.name for c in table.columns]
    if configured in names:
        return configured
    candidates = [c for c in table.columns if c.inferred_role == "target_candidate"]
    if candidates:

        def first(test) -> ColumnProfile | None:
            return next((c for c in candidates if test(c)), None)

        best = None
        if task == "classification":
            best = first(lambda c: c.inferred_type == "binary") or first(lambda c: c.unique_count <= 10)
        elif task == "regression":
            best = first(lambda c: c.inferred_type == "numeric" and c.unique_count > 10)
        return (best or candidates[0]).name
    if table.columns and table.columns[-1].inferred_role not in ("identifier", "metadata"):
        return table.columns[-1].name
    return next((c.name for c in table.columns if c.inferred_role != "identifier"), None)


def decide(df: DataFrame, issues: list[Issue], outlier_strategy: str = "cap", overrides: dict | None = None) -> dict:
    """A choice per issue, keyed ``(kind, column)``; overrides win."""
    kind = kinds(df)
    treatments = {"cap": "cap_outliers", "remove": "remove_outliers", "median": "median_replacement", "keep": "keep_outliers"}
    out: dict = {}
    for i in issues:
        if i.issue_type == "outliers":
            out[("outliers", None)] = treatments[outlier_strategy]
        elif i.issue_type == "missing_values":
            out[("missing_values", i.columns[0])] = imputation_rule(
                kind[i.columns[0]], float(i.details["missing_percentage"])
            )
        else:
            out[(i.issue_type, None)] = i.options[0] if i.options else "default"
    return out | (overrides or {})


def first_options(issues: list[Issue]) -> dict:
    """The first suggested option of every issue."""
    return {
        (i.issue_type, i.columns[0] if i.issue_type == "missing_values" else None): i.options[0] for i in issues if i.options
    }


def target_scores(options: DataFrame) -> DataFrame:
    """Score candidate targets ``(option, description)`` by the words they hold."""
    name, about = F.lower("option"), F.lower("description")

    def any_of(c, parts):
        return F.greatest(*[c.contains(p).cast("int") for p in parts])

    # Points per hint.
    points = (
        10 * any_of(name, W.TARGET_SCORE_WORDS)
        + 8 * any_of(about, W.TARGET_SCORE_WORDS)
        + 5 * about.contains("binary").cast("int")
        + 7 * (about.contains("categorical") & about.contains("unique: 2")).cast("int")
        - 15 * any_of(name, W.ID_SCORE_WORDS)
        - 12 * about.contains("identifier").cast("int")
        - 20 * about.contains("missing: 100").cast("int")
    )
    return options.withColumn("score", points)


def best_target(options: DataFrame) -> str | None:
    """The best scored option if any scores above zero, else the first one."""
    scored = [(r["option"], r["score"]) for r in target_scores(options).collect()]  # one row per column
    if not scored:
        return None
    top = max(scored, key=lambda r: r[1])
    return top[0] if top[1] > 0 else scored[0][0]


def target_options(df: DataFrame, table: TableProfile) -> DataFrame:
    """Candidate targets with the description the scoring reads."""
    rows = [
        (c.name, f"{c.inferred_type} column, role: {c.inferred_role}, unique: {c.unique_count}, missing: {c.null_percentage:.0f}%")
        for c in table.columns
    ]
    return df.sparkSession.createDataFrame(rows, "option string, description string")


def task_estimate(unique_count: int) -> str:
    return "binary" if unique_count <= 2 else "multiclass" if unique_count <= 10 else "regression"


def training_task_estimate(kind: str, unique_count: int) -> str:
    return "classification" if kind != "numeric" or unique_count <= 20 else "regression"
