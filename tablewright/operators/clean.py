"""Dedupe, sparse columns and rows, text repair and type correction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as X
from tablewright.operators.profile import TableProfile, profile
from tablewright.plans.aggregates import col, columns_of, kinds, measure, melt


@dataclass
class Action:
    """One entry of a run's log."""

    action_type: str
    target: str
    description: str
    details: str | None = None


ACTION_SCHEMA = "action_type string, target string, description string, details string"

# Kinds of log entries.
ACTION_TYPES = [
    "column_removed", "rows_removed", "type_corrected", "value_imputed", "outlier_handled",
    "duplicates_removed", "target_identified", "problem_type_detected", "column_renamed",
    "value_cleaned", "data_normalized", "categories_encoded",
]


def action_frame(df: DataFrame, actions: list[Action]) -> DataFrame:
    rows = [(a.action_type, a.target, a.description, a.details) for a in actions]
    return df.sparkSession.createDataFrame(rows, ACTION_SCHEMA)


# ---------------------------------------------------------------- rows and columns


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each identical row; nulls equal nulls."""
    return df.dropDuplicates()


def null_shares(df: DataFrame) -> dict[str, float]:
    seen = measure(df, {None: F.count(F.lit(1))} | {n: F.count(col(n)) for n in df.columns})
    rows = seen.pop(None)
    return {n: (1 - filled / rows if rows else 0.0) for n, filled in seen.items()}


def sparse_columns(shares: dict[str, float], identifiers: set[str], threshold: float = 0.7) -> list[str]:
    return [n for n, share in shares.items() if share > threshold and n not in identifiers]


def drop_sparse_columns(df: DataFrame, identifiers: set[str] = frozenset(), threshold: float = 0.7) -> DataFrame:
    """Drop columns with a larger share of nulls than the threshold, identifiers excepted."""
    return df.drop(*sparse_columns(null_shares(df), set(identifiers), threshold))


def null_fraction(names: list[str]) -> Column:
    """Share of nulls in a row."""
    missing = F.lit(0)
    for n in names:
        missing = missing + col(n).isNull().cast("int")
    return missing / F.lit(max(1, len(names)))


def drop_sparse_rows(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Keep rows whose share of nulls is at most the threshold."""
    return df.where(null_fraction(df.columns) <= threshold)


def auto_clean(
    df: DataFrame,
    table: TableProfile | None = None,
    column_threshold: float = 0.7,
    row_threshold: float = 0.8,
    dedupe: bool = True,
) -> tuple[DataFrame, list[Action]]:
    """Duplicates, then sparse columns, then sparse rows, with a log."""
    identifiers = {c.name for c in table.columns if c.inferred_role == "identifier"} if table else set()
    log: list[Action] = []
    before = df.count()
    out = drop_duplicate_rows(df) if dedupe else df
    shares = measure(out, {None: F.count(F.lit(1))} | {n: F.count(col(n)) for n in out.columns})
    kept = shares.pop(None)
    if before > kept:
        log.append(Action("duplicates_removed", "dataset", f"Removed {before - kept} duplicate rows"))
    nulls = {n: (1 - filled / kept if kept else 0.0) for n, filled in shares.items()}
    for n in sparse_columns(nulls, identifiers, column_threshold):
        out = out.drop(n)
        log.append(Action("column_removed", n, f"Dropped column '{n}'", f"{100 * nulls[n]:.1f}% missing"))
    sparse = measure(out, {"n": F.count(F.when(null_fraction(out.columns) > row_threshold, 1))})["n"]
    if sparse:
        out = drop_sparse_rows(out, row_threshold)
        log.append(Action("rows_removed", "dataset", f"Removed {sparse} rows with too many missing values"))
    return out, log


# ---------------------------------------------------------------- text repair


def _rewrite(df: DataFrame, names: list[str], change) -> DataFrame:
    return df.withColumns({n: change(col(n)) for n in names}) if names else df


def strip_quotes(df: DataFrame) -> DataFrame:
    """Deep quote stripping of every text column, one projection per step."""
    names = columns_of(df, "string")
    for step in X.QUOTE_STEPS:
        df = _rewrite(df, names, step)
    return df


def repair_texts(df: DataFrame) -> DataFrame:
    """Strip quotes, then blank missing words.

    After quote stripping every value is trimmed, so blanking cannot change other values.
    """
    return _rewrite(strip_quotes(df), columns_of(df, "string"), X.blank_missing)


def blank_missing(df: DataFrame) -> DataFrame:
    """Missing-value words to null, in the text columns that hold any; others are untouched."""
    names = columns_of(df, "string")
    if not names:
        return df
    found = measure(df, {n: F.max(X.is_missing_word(col(n)).cast("int")) for n in names})
    return _rewrite(df, [n for n in names if found[n]], X.blank_missing)


def scrub_output(df: DataFrame) -> DataFrame:
    """Final quote removal before writing."""
    return _rewrite(df, columns_of(df, "string"), X.scrub_output)


def numeric_ratio(df: DataFrame, names: list[str]) -> DataFrame:
    """Per text column: share of numbers among values that are neither blank nor error words."""
    cells = melt(df, names, "string").where((X.trimmed(F.col("value")) != "") & ~X.is_error_marker(F.col("value")))
    return cells.groupBy("column").agg(
        F.count("*").alias("checked"),
        F.sum(X.is_number(F.col("value")).cast("long")).alias("numeric"),
        (F.sum(X.is_number(F.col("value")).cast("double")) / F.count("*")).alias("ratio"),
    )


# ---------------------------------------------------------------- type correction

INT_LOW, INT_HIGH = -(2**31), 2**31 - 1
SURVIVORS = 0.7  # a cast is applied when more than this share of the values survives


@dataclass
class Cast:
    """A planned or refused conversion."""

    column: str
    source: str
    target: str
    survived: int
    non_null: int
    applied: bool

    @property
    def rate(self) -> float:
        return self.survived / self.non_null if self.non_null else 0.0


CAST_SCHEMA = "column string, source string, target string, survived bigint, non_null bigint, rate double, applied boolean"


def cast_frame(df: DataFrame, casts: list[Cast]) -> DataFrame:
    rows = [(c.column, c.source, c.target, c.survived, c.non_null, c.rate, c.applied) for c in casts]
    return df.sparkSession.createDataFrame(rows, CAST_SCHEMA)


def plan_casts(df: DataFrame, table: TableProfile, parse_iso: bool = False) -> list[Cast]:
    """Choose a type per column and test it, from one aggregate over all columns."""
    kind = kinds(df)
    time_of = X.iso_to_timestamp if parse_iso else X.epoch_to_timestamp
    calls: dict = {}
    for c in table.columns:
        if c.name not in kind or c.inferred_role == "identifier":
            continue
        v, k = col(c.name), kind[c.name]
        if c.inferred_type == "numeric" and k == "string":
            number = X.parse_number(v)
            calls[(c.name, "n")] = F.count(v)
            calls[(c.name, "float")] = F.count(F.when(X.looks_like_float(v), 1))
            calls[(c.name, "number")] = F.count(number)
            calls[(c.name, "low")] = F.min(number)
            calls[(c.name, "high")] = F.max(number)
            calls[(c.name, "double")] = F.count(X.to_double(v))
            calls[(c.name, "integer")] = F.count(X.to_integer(v))
        elif c.inferred_type == "numeric" and dict(df.dtypes)[c.name] in ("bigint", "smallint", "tinyint"):
            calls[(c.name, "n")] = F.count(v)
            calls[(c.name, "low")] = F.min(v)
            calls[(c.name, "high")] = F.max(v)
        elif c.inferred_type == "datetime" and k == "string":
            calls[(c.name, "n")] = F.count(v)
            calls[(c.name, "time")] = F.count(time_of(v))
        elif c.inferred_type == "binary" and k == "string":
            calls[(c.name, "n")] = F.count(v)
            calls[(c.name, "boolean")] = F.count(X.to_boolean(v))
    seen = measure(df, calls)
    types = dict(df.dtypes)
    plan = []
    for c in table.columns:
        n = seen.get((c.name, "n"))
        if not n:
            continue
        source = types[c.name]
        small = (
            (c.name, "low") in seen
            and seen[(c.name, "low")] is not None
            and seen[(c.name, "low")] >= INT_LOW
            and seen[(c.name, "high")] <= INT_HIGH
        )
        if source == "string" and c.inferred_type == "numeric":
            floats = seen[(c.name, "float")]
            if floats > seen[(c.name, "number")] - floats:
                target, survived = "double", seen[(c.name, "double")]
            else:
                target, survived = ("int" if small else "bigint"), seen[(c.name, "integer")]
        elif source == "string":
            target = "timestamp" if c.inferred_type == "datetime" else "boolean"
            survived = seen[(c.name, "time" if c.inferred_type == "datetime" else "boolean")]
        else:
            target, survived = ("int" if small else "bigint"), n
        if target != source:
            plan.append(Cast(c.name, source, target, survived, n, survived / n > SURVIVORS))
    return plan


def apply_casts(df: DataFrame, plan: list[Cast], parse_iso: bool = False) -> DataFrame:
    """All accepted conversions in one projection."""
    convert = {
        "double": X.to_double,
        "bigint": X.to_integer,
        "int": lambda v: X.to_integer(v, 32),
        "timestamp": X.iso_to_timestamp if parse_iso else X.epoch_to_timestamp,
        "boolean": X.to_boolean,
    }
    changes = {}
    for c in plan:
        if c.applied:
            v = col(c.column)
            changes[c.column] = convert[c.target](v) if c.source == "string" else v.cast(c.target)
    return df.withColumns(changes) if changes else df


def correct_types(
    df: DataFrame, table: TableProfile | None = None, parse_iso: bool = False
) -> tuple[DataFrame, list[Cast]]:
    """Strip quotes, blank missing words, then convert the columns whose values survive it."""
    table = table or profile(df, duplicates=False, outliers=False, numeric_samples=False)
    repaired = repair_texts(df)
    plan = plan_casts(repaired, table, parse_iso)
    return apply_casts(repaired, plan, parse_iso), plan


def late_numeric_cast(df: DataFrame, inferred: dict[str, str]) -> DataFrame:
    """Columns inferred numeric that are still text become double where they parse."""
    text = set(columns_of(df, "string"))
    names = [n for n, t in inferred.items() if t == "numeric" and n in text]
    return _rewrite(df, names, lambda v: X.float_or_null(X.trimmed(v)))


# What a stored type must be for an inferred type.
_STORED_AS = {"numeric": "numeric", "datetime": "datetime", "date": "datetime", "binary": "boolean"}


def type_mismatches(df: DataFrame, table: TableProfile) -> DataFrame:
    """Columns stored as another kind than their values suggest."""
    kind, types = kinds(df), dict(df.dtypes)
    rows = [
        (c.name, types[c.name], c.inferred_type)
        for c in table.columns
        if c.name in kind and c.inferred_type in _STORED_AS and kind[c.name] != _STORED_AS[c.inferred_type]
    ]
    return df.sparkSession.createDataFrame(rows, "column string, stored string, inferred string")
