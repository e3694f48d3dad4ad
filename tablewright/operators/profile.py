"""Column and table profiles, type and role inference.

Statistics come from whole-table aggregates over all columns together; only their results,
one small record per column, reach the driver, where the inference rules run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import words as W
from tablewright.operators.select import sample_values
from tablewright.plans.aggregates import col, kinds, measure, melt
from tablewright.plans.orderstats import index_quantiles, numeric

PROFILE_SCHEMA = (
    "name string, dtype string, unique_count bigint, null_count bigint, null_percentage double, "
    "sample_values array<string>, inferred_type string, inferred_role string, "
    "characteristics map<string,string>"
)
_FLOAT = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
_DATES = [re.compile(p) for p in W.DATE_PATTERNS]
_IDS = [re.compile(p) for p in W.IDENTIFIER_PATTERNS]


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    kind: str
    rows: int
    unique_count: int
    null_count: int
    sample_values: list[str] = field(default_factory=list)
    inferred_type: str = "unknown"
    inferred_role: str = "feature"
    characteristics: dict[str, str] = field(default_factory=dict)

    @property
    def null_percentage(self) -> float:
        return 100.0 * self.null_count / self.rows if self.rows else 0.0

    @property
    def has_outliers(self) -> bool:
        return self.characteristics.get("has_outliers") == "true"


@dataclass
class TableProfile:
    rows: int
    columns: list[ColumnProfile]
    duplicate_count: int = 0

    @property
    def duplicate_percentage(self) -> float:
        return 100.0 * self.duplicate_count / self.rows if self.rows else 0.0

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    @property
    def inferred(self) -> dict[str, str]:
        return {c.name: c.inferred_type for c in self.columns}

    @property
    def target_candidates(self) -> list[str]:
        return [c.name for c in self.columns if c.inferred_role == "target_candidate"]

    def of_type(self, *types: str) -> list[str]:
        return [c.name for c in self.columns if c.inferred_type in types]


# ---------------------------------------------------------------- value counts


def value_counts(df: DataFrame, names: list[str], as_type: str = "string") -> DataFrame:
    """``(column, value, n)`` of the non-null values of several columns, in one shuffle."""
    cells = melt(df, names, as_type).where(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def count_shapes(counted: DataFrame) -> DataFrame:
    """Per column: distinct values, the mode (ties to the smaller value), spread of the counts."""
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").cast("string").alias("value")))
    return counted.groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        top["value"].alias("most_frequent"),
        F.avg("n").alias("count_mean"),
        F.stddev_pop("n").alias("count_std"),
        F.sum("n").alias("non_null"),
    )


def _family(df: DataFrame, kind: dict[str, str]) -> dict[str, list[str]]:
    """Columns by the type their values are counted in."""
    types = dict(df.dtypes)
    out: dict[str, list[str]] = {}
    for n, k in kind.items():
        if k == "numeric":
            t = types[n]
            out.setdefault("bigint" if t in ("tinyint", "smallint", "int", "bigint") else "double", []).append(n)
        elif k in ("string", "boolean"):
            out.setdefault(k, []).append(n)
        elif k == "datetime":
            out.setdefault("timestamp", []).append(n)
    return out


def distinct_shapes(df: DataFrame) -> DataFrame:
    """``count_shapes`` for every scalar column: one shuffle per value family."""
    parts = [count_shapes(value_counts(df, names, t)) for t, names in _family(df, kinds(df)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- duplicates


def duplicate_rows(df: DataFrame) -> int:
    """Rows minus distinct rows, exactly.

    Only an 8-byte hash is shuffled for the whole table. Rows whose hash occurs once are
    unique; the rows of the remaining hashes are compared in full.
    """
    names = [col(c) for c in df.columns]
    if any(t.startswith("map") for _, t in df.dtypes):
        names = [F.to_json(F.struct(col(c))) if t.startswith("map") else col(c) for c, t in df.dtypes]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(names)])
    cells = rows.columns
    hashed = rows.withColumn("h", F.xxhash64(*cells))
    repeated = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    suspects = hashed.join(repeated.select("h"), "h", "left_semi")
    counted = suspects.groupBy(*cells).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


# ---------------------------------------------------------------- inference


def _plain_number(text: str) -> bool:
    cleaned = text.strip()
    for mark in W.NUMBER_DECORATION:
        cleaned = cleaned.replace(mark, "")
    return bool(_FLOAT.match(cleaned))


def looks_boolean(kind: str, samples: list[str]) -> bool:
    if kind == "boolean":
        return True
    known = set(W.TRUE_WORDS_WIDE + W.FALSE_WORDS_WIDE)
    hits = sum(s.strip().lower() in known for s in samples[:5])
    return kind == "string" and len(samples) >= 3 and hits >= 3


def looks_datetime(samples: list[str]) -> bool:
    head = samples[:10]
    hits = 0
    for s in head:
        text = s.strip()
        if text and not _FLOAT.match(text):
            hits += any(p.search(text) for p in _DATES)
    return bool(head) and hits / len(head) > 0.7


def numeric_share(samples: list[str]) -> float | None:
    """Share of numbers among the samples that are neither blank nor an error word."""
    read = [s for s in samples if s.strip() and s.strip().lower() not in W.ERROR_WORDS]
    return sum(map(_plain_number, read)) / len(read) if read else None


def looks_numeric(name: str, kind: str, samples: list[str], wide: list[str]) -> bool:
    if kind == "numeric":
        return True
    if kind != "string":
        return False
    hinted = any(part in name.lower() for part in W.NUMERIC_NAME_PARTS)
    first, second = numeric_share(samples), numeric_share(wide)
    if first is not None and first >= (0.3 if hinted else 0.6):
        return True
    return second is not None and second >= (0.4 if hinted else 0.7)


def looks_identifier(name: str, unique_ratio: float, samples: list[str]) -> bool:
    if unique_ratio < 0.8:
        return False
    if unique_ratio > 0.9 and any(part in name.lower() for part in W.IDENTIFIER_NAME_PARTS):
        return True
    head = samples[:10]
    hits = sum(any(p.search(s) for p in _IDS) for s in head)
    return bool(head) and hits / len(head) > 0.7


def infer_type(
    name: str, kind: str, non_null: int, distinct: int, mean_length: float | None, samples: list[str], wide: list[str]
) -> str:
    if non_null == 0:
        return "unknown"
    if looks_boolean(kind, samples):
        return "binary"
    if looks_datetime(samples):
        return "datetime"
    if looks_numeric(name, kind, samples, wide):
        return "numeric"
    ratio = distinct / non_null
    if looks_identifier(name, ratio, samples):
        return "identifier"
    return "text" if kind == "string" and ratio > 0.7 and (mean_length or 0) > 30 else "string"


def infer_role(name: str, inferred_type: str, unique_count: int, rows: int) -> str:
    lower = name.lower()
    if inferred_type == "identifier":
        return "identifier"
    if any(part in lower for part in W.TARGET_NAME_PARTS):
        return "target_candidate"
    if any(part in lower for part in W.METADATA_NAME_PARTS):
        return "metadata"
    few_words = inferred_type == "string" and unique_count <= 10
    spread_number = inferred_type == "numeric" and 10 < unique_count < rows // 2
    return "target_candidate" if inferred_type == "binary" or few_words or spread_number else "feature"


def cardinality_band(unique_count: int) -> str:
    return "low" if unique_count < 10 else "medium" if unique_count < 50 else "high"


# ---------------------------------------------------------------- profile


def outlier_flags(df: DataFrame, names: list[str], sizes: dict[str, int]) -> dict[str, bool]:
    """Whether more than one value in twenty lies outside 1.5 IQR (index quartiles)."""
    tested = [n for n in names if sizes[n] >= 4]
    bounds = iqr_bounds(df, tested, sizes)
    outside = measure(
        df, {n: F.count(F.when((numeric(n) < lo) | (numeric(n) > hi), 1)) for n, (lo, hi) in bounds.items()}
    )
    return {n: n in outside and outside[n] > sizes[n] // 20 for n in names}


def iqr_bounds(df: DataFrame, names: list[str], sizes: dict[str, int] | None = None) -> dict[str, tuple[float, float]]:
    quartiles = index_quantiles(df, names, [0.25, 0.75], sizes)
    out = {}
    for n, (q1, q3) in quartiles.items():
        if q1 is not None:
            reach = 1.5 * (q3 - q1)
            out[n] = (q1 - reach, q3 + reach)
    return out


def _moments(df: DataFrame, kind: dict[str, str]) -> dict:
    calls = {("rows",): F.count(F.lit(1))}
    for n, k in kind.items():
        calls[(n, "filled")] = F.count(col(n))
        if k == "numeric":
            calls[(n, "size")] = F.count(numeric(n))
            calls[(n, "mean")] = F.avg(numeric(n))
            calls[(n, "std")] = F.stddev_samp(numeric(n))
            calls[(n, "skew")] = F.skewness(numeric(n))
        if k == "string":
            calls[(n, "length")] = F.avg(F.octet_length(col(n)))
    return measure(df, calls)


def sample_skewness(population: float | None, n: int) -> float:
    """Third moment over the cubed sample deviation, from Spark's population form."""
    if population is None or population != population or n < 2:
        return 0.0
    return population * ((n - 1) / n) ** 1.5


def profile(
    df: DataFrame,
    approximate: bool = False,
    duplicates: bool = True,
    outliers: bool = True,
    numeric_samples: bool = True,
    sample_key: list[str] | None = None,
    seed: int = 42,
) -> TableProfile:
    """Profile every column.

    ``approximate`` replaces exact distinct counts, which shuffle every distinct value, by
    sketches that need no shuffle; modes and count spreads are then left out. Inference needs
    neither outlier flags nor samples of numbers, so callers that want types only turn them off.
    """
    kind = kinds(df)
    seen = _moments(df, kind)
    rows = seen[("rows",)]
    filled = {n: seen[(n, "filled")] for n in kind}
    scalar = [n for n, k in kind.items() if k != "other"]
    shapes: dict[str, dict] = {}
    if approximate:
        found = measure(df, {n: F.approx_count_distinct(col(n), 0.01) for n in scalar})
        shapes = {n: {"distinct_values": found[n]} for n in scalar}
    elif scalar:
        shapes = {r["column"]: r.asDict() for r in distinct_shapes(df).collect()}  # one row per column
    drawn: dict[str, list[str]] = {n: [] for n in kind}
    if scalar:
        words = [n for n in scalar if kind[n] == "string"]
        others = [n for n in scalar if kind[n] != "string"]
        if words:
            drawn.update(sample_values(df, words, 100, seed, sample_key, filled))
        if others and numeric_samples:
            drawn.update(sample_values(df, others, 10, seed, sample_key, filled))
    numbers = [n for n, k in kind.items() if k == "numeric"]
    flags = outlier_flags(df, numbers, {n: seen[(n, "size")] for n in numbers}) if numbers and outliers else {}
    out = []
    for n, dtype in df.dtypes:
        shape = shapes.get(n, {})
        distinct = shape.get("distinct_values", 0)
        nulls = rows - filled[n]
        wide = drawn[n]
        inferred = infer_type(n, kind[n], filled[n], distinct, seen.get((n, "length")), wide[:10], wide)
        if kind[n] == "datetime" and filled[n]:
            inferred = "datetime"
        unique = distinct + (1 if nulls else 0)
        traits = {"cardinality": cardinality_band(unique)}
        if kind[n] == "numeric" and seen[(n, "size")]:
            size = seen[(n, "size")]
            skew = sample_skewness(seen[(n, "skew")], size)
            traits.update(
                mean=repr(seen[(n, "mean")]),
                std=repr(seen[(n, "std")] if size > 1 else 0.0),
                skewness=repr(skew),
                distribution="normal" if abs(skew) < 1.0 else "skewed",
            )
            if outliers:
                traits["has_outliers"] = str(flags[n]).lower()
        elif inferred == "string" and shape.get("most_frequent") is not None:
            traits["most_frequent"] = shape["most_frequent"]
            if distinct > 1:
                even = shape["count_std"] < shape["count_mean"]
                traits["frequency_distribution"] = "balanced" if even else "imbalanced"
        out.append(
            ColumnProfile(
                n, dtype, kind[n], rows, unique, nulls, wide[:10], inferred, infer_role(n, inferred, unique, rows), traits
            )
        )
    return TableProfile(rows, out, duplicate_rows(df) if duplicates else 0)


def flag_outliers(df: DataFrame, table: TableProfile) -> TableProfile:
    """Add the outlier flags a profile was made without."""
    numbers = [c.name for c in table.columns if c.kind == "numeric" and "mean" in c.characteristics]
    sizes = measure(df, {n: F.count(numeric(n)) for n in numbers})
    for n, flag in outlier_flags(df, numbers, sizes).items():
        table[n].characteristics["has_outliers"] = str(flag).lower()
    return table


def profile_frame(df: DataFrame, table: TableProfile) -> DataFrame:
    """The profile as a DataFrame, one row per column."""
    rows = [
        (c.name, c.dtype, c.unique_count, c.null_count, c.null_percentage, c.sample_values, c.inferred_type, c.inferred_role, c.characteristics)
        for c in table.columns
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def problem_types(table: TableProfile) -> list[str]:
    """Candidate tasks of a table."""
    found = []
    candidates = [c for c in table.columns if c.inferred_role == "target_candidate"]
    if any(c.inferred_type in ("binary", "string", "categorical") or c.unique_count <= 10 for c in candidates):
        found.append("classification")
    if any(c.inferred_type == "numeric" and c.unique_count > 10 for c in candidates):
        found.append("regression")
    if table.of_type("datetime"):
        found.append("time_series")
    return found or ["clustering"]


def complexity(table: TableProfile) -> dict:
    """Size, width, type and missingness bands."""
    features = sum(c.inferred_role == "feature" for c in table.columns)

    def band(value: int, steps: list[tuple[int, str]], last: str) -> str:
        return next((name for top, name in steps if value <= top), last)

    mean_nulls = sum(c.null_percentage for c in table.columns) / max(1, len(table.columns))
    return {
        "size_category": band(table.rows, [(9_999, "small"), (99_999, "medium"), (999_999, "large")], "very_large"),
        "feature_count": features,
        "feature_complexity": band(features, [(20, "low"), (200, "medium"), (1000, "high")], "very_high"),
        "mixed_types": len({c.inferred_type for c in table.columns}) > 3,
        "high_cardinality_features": sum(c.characteristics.get("cardinality") == "high" for c in table.columns),
        "missing_data_complexity": "high" if mean_nulls > 20.0 else "low",
    }


def dataset_frame(df: DataFrame, table: TableProfile) -> DataFrame:
    """One row about the whole table."""
    bands = complexity(table)
    return df.sparkSession.createDataFrame(
        [
            (
                table.rows,
                len(table.columns),
                table.duplicate_count,
                table.duplicate_percentage,
                table.target_candidates,
                problem_types(table),
                *bands.values(),
            )
        ],
        "row_count bigint, column_count bigint, duplicate_count bigint, duplicate_percentage double, "
        "target_candidates array<string>, problem_types array<string>, size_category string, "
        "feature_count bigint, feature_complexity string, mixed_types boolean, "
        "high_cardinality_features bigint, missing_data_complexity string",
    )
