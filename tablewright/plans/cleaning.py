"""The whole cleaning run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tablewright.operators import clean, impute, outliers, quality, select
from tablewright.operators.clean import Action
from tablewright.operators.profile import TableProfile, dataset_frame, flag_outliers, profile, profile_frame
from tablewright.plans.aggregates import kinds
from tablewright.session import cut_lineage

NUMERIC_FILLS = ("mean", "median", "zero", "knn", "drop")
TEXT_FILLS = ("mode", "constant", "drop")
OUTLIER_STRATEGIES = ("cap", "remove", "median", "keep")
_FILL_NAMES = {
    "mean": "mean_imputation", "median": "median_imputation", "knn": "knn_imputation", "zero": "zero",
    "drop": "drop", "mode": "mode_imputation", "constant": "constant_imputation",
}


@dataclass
class CleaningOptions:
    """Options of a run; the defaults follow the usual thresholds."""

    column_threshold: float = 0.7
    row_threshold: float = 0.8
    outlier_strategy: str = "cap"
    numeric_fill: str = "median"
    text_fill: str = "mode"
    correct_types: bool = True
    remove_duplicates: bool = True
    neighbours: int | None = None
    target: str | None = None
    task: str | None = None
    order_by: str | None = None
    key: str | None = None
    parse_iso: bool = False
    first_suggestions: bool = False
    columns: list[str] | None = None
    decisions: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("column_threshold", "row_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.neighbours is not None and self.neighbours < 1:
            raise ValueError("neighbours must be at least 1")
        for value, known in (
            (self.outlier_strategy, OUTLIER_STRATEGIES), (self.numeric_fill, NUMERIC_FILLS), (self.text_fill, TEXT_FILLS),
        ):
            if value not in known:
                raise ValueError(f"{value} is not one of {', '.join(known)}")


@dataclass
class CleaningResult:
    training: DataFrame
    full: DataFrame
    profile: TableProfile
    issues: list[quality.Issue]
    decisions: dict
    actions: list[Action]
    task: str
    target: str | None
    summary: dict
    warnings: list[str]


def _score(df: DataFrame) -> tuple[int, float, int]:
    r = quality.completeness(df).first()
    return r["rows"], r["score"], r["columns_with_nulls"]


def clean_table(df: DataFrame, options: CleaningOptions | None = None) -> CleaningResult:
    """Correct types, clean, profile, decide, drop dates, fill, treat outliers, split off identifiers.

    Jobs run only where the next step needs numbers. The typed and the cleaned table are cut
    off their lineage, since profile, fills and outlier bounds each read them again.
    """
    o = options or CleaningOptions()
    source = select.select_columns(df, o.columns)
    actions: list[Action] = []
    rows_before, score_before, _ = _score(source)
    work = source
    if o.correct_types:
        work, casts = clean.correct_types(source, parse_iso=o.parse_iso)
        for c in casts:
            done = "Converted" if c.applied else "Kept"
            text = f"{done} '{c.column}' ({c.source} to {c.target})"
            actions.append(Action("type_corrected", c.column, text, f"{100 * c.rate:.1f}% of values survive"))
        work = cut_lineage(work)
    first = profile(work, duplicates=False, outliers=False, numeric_samples=False)
    cleaned, log = clean.auto_clean(work, first, o.column_threshold, o.row_threshold, o.remove_duplicates)
    actions += log
    if log:
        cleaned = cut_lineage(cleaned)
        table = profile(cleaned, duplicates=False, numeric_samples=False)
    else:
        table = flag_outliers(cleaned, first)  # cleaning removed nothing, the rest still holds
    issues = quality.find_issues(cleaned, table)
    decisions = quality.first_options(issues) if o.first_suggestions else quality.decide(cleaned, issues, o.outlier_strategy)
    decisions |= o.decisions
    task = o.task or quality.problem_type_rule(table)
    target = quality.target_rule(table, task, o.target)
    actions.append(Action("problem_type_detected", "dataset", f"Task: {task}"))
    actions.append(Action("target_identified", target or "dataset", f"Target: {target}"))

    kept = select.drop_date_columns(cleaned, table.inferred, task, target)
    actions += [Action("column_removed", n, f"Dropped date column '{n}'") for n in cleaned.columns if n not in kept.columns]
    kept = clean.late_numeric_cast(kept, table.inferred)
    kind = kinds(kept)
    defaults = {"numeric": _FILL_NAMES[o.numeric_fill], "string": _FILL_NAMES[o.text_fill]}
    strategies = {}
    for c in table.columns:
        if c.name in kind and c.null_count:
            wanted = decisions.get(("missing_values", c.name))
            strategies[c.name] = wanted or defaults.get(kind[c.name], "forward_fill")
    filled, log = impute.impute(kept, strategies, table.inferred, o.order_by, o.key, o.neighbours)
    missing = {c.name: c.null_count for c in table.columns}
    actions += [replace(a, details=f"{missing[a.target]} cells") if a.target in missing else a for a in log]
    if strategies:
        filled = impute.final_fill(cut_lineage(filled))
    flagged = [c.name for c in table.columns if c.has_outliers and kinds(filled).get(c.name) == "numeric"]
    choice = decisions.get(("outliers", None), "keep_outliers")
    counts = None
    if flagged and outliers.CHOICES.get(choice, choice) == "cap":
        bounds = outliers.cap_bounds(filled, flagged)
        treated, found = outliers.apply_caps(filled, bounds), outliers.capped_counts(filled, bounds)
        counts = ", ".join(f"{n}: {k} values capped" for n, k in found.items())
    else:
        treated = outliers.treat_outliers(filled, flagged, choice)
    if flagged:
        actions.append(Action("outlier_handled", ", ".join(flagged), f"Outliers: {choice}", counts))
    training, full = select.split_identifiers(treated, table.inferred)
    rows_after, score_after, open_columns = _score(treated)
    columns_before, columns_after = len(source.columns), len(treated.columns)
    summary = {
        "rows_before": rows_before, "rows_after": rows_after,
        "columns_before": columns_before, "columns_after": columns_after,
        "issues_found": len(issues), "issues_remaining": open_columns,
        "quality_before": score_before, "quality_after": score_after,
    }
    warnings = []
    for what, before, after in (("rows", rows_before, rows_after), ("columns", columns_before, columns_after)):
        if before and (before - after) / before > 0.3:
            warnings.append(f"{100 * (before - after) / before:.1f}% of {what} were removed")
    return CleaningResult(training, full, table, issues, decisions, actions, task, target, summary, warnings)


SUMMARY_SCHEMA = (
    "rows_before bigint, rows_after bigint, columns_before bigint, columns_after bigint, issues_found bigint, "
    "issues_remaining bigint, quality_before double, quality_after double"
)


def summary_frame(df: DataFrame, result: CleaningResult) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(result.summary.values())], SUMMARY_SCHEMA)


def column_lineage(df: DataFrame, result: CleaningResult) -> DataFrame:
    """What became of each input column."""
    final = dict(result.full.dtypes)
    rows = [(n, t, final.get(n), n not in final) for n, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, original_type string, final_type string, removed boolean")


def dry_run(df: DataFrame, column_threshold: float = 0.7) -> dict[str, DataFrame]:
    """What a run would see and do, without changing anything."""
    table = profile(df)
    dropped = [
        (c.name, c.null_percentage)
        for c in table.columns
        if c.null_percentage > 100 * column_threshold and c.inferred_role != "identifier"
    ]
    task = quality.problem_type_rule(table)
    target = quality.target_rule(table, task)
    estimate = quality.task_estimate(table[target].unique_count) if target else None
    make = df.sparkSession.createDataFrame
    return {
        "profile": profile_frame(df, table),
        "dataset": dataset_frame(df, table),
        "columns_to_drop": make(dropped, "column string, null_percentage double"),
        "type_mismatches": clean.type_mismatches(df, table),
        "issues": quality.issue_frame(df, quality.find_issues(df, table)),
        "proposal": make([(target, task, estimate)], "target string, task string, estimate string"),
    }
