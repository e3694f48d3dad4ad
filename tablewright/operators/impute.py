"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.clean import Action
from tablewright.operators.knn import knn_fill
from tablewright.operators.profile import value_counts
from tablewright.plans.aggregates import col, columns_of, kinds, measure
from tablewright.plans.orderstats import interpolated_quantiles, numeric
from tablewright.plans.ranks import join_same, range_splits, with_bucket
from tablewright.sources.order import has_file_order, with_row_number

MISSING, UNKNOWN = "Missing", "Unknown"  # fixed values: fill texts
FILE_ORDER = "_row_in_files"


def medians(df: DataFrame, names: list[str]) -> dict[str, float]:
    found = interpolated_quantiles(df, names, [0.5])
    return {n: v[0] for n, v in found.items() if v[0] is not None}


def means(df: DataFrame, names: list[str]) -> dict[str, float]:
    found = measure(df, {n: F.avg(numeric(n)) for n in names})
    return {n: v for n, v in found.items() if v is not None}


def modes(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Most frequent text per column; ties go to the smaller text."""
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col("value")))
    rows = value_counts(df, names).groupBy("column").agg(top["value"].alias("mode")).collect()
    return {r["column"]: r["mode"] for r in rows}  # one row per column


def _fill(df: DataFrame, values: dict[str, object], cast: str | None) -> DataFrame:
    changes = {
        n: F.coalesce(col(n).cast(cast) if cast else col(n), F.lit(v)) for n, v in values.items()
    }
    return df.withColumns(changes) if changes else df


def median_fill(df: DataFrame, names: list[str]) -> DataFrame:
    """Null to the exact median; the column becomes double."""
    return _fill(df, medians(df, names), "double")


def mean_fill(df: DataFrame, names: list[str]) -> DataFrame:
    """Null to the mean; the column becomes double."""
    return _fill(df, means(df, names), "double")


def mode_fill(df: DataFrame, names: list[str]) -> DataFrame:
    return _fill(df, modes(df, names), "string")


def indicator_fill(df: DataFrame, names: list[str]) -> DataFrame:
    """Null to the category ``Missing``."""
    return _fill(df, dict.fromkeys(names, MISSING), "string")


def constant_fill(df: DataFrame, names: list[str]) -> DataFrame:
    return _fill(df, dict.fromkeys(names, UNKNOWN), "string")


def zero_fill(df: DataFrame, names: list[str]) -> DataFrame:
    return _fill(df, dict.fromkeys(names, 0.0), "double")


def drop_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.na.drop(subset=names)


def final_fill(df: DataFrame) -> DataFrame:
    """Whatever is left: numbers to 0, everything else to ``Unknown``; times stay missing rather than become text."""
    kind = kinds(df)
    open_ = measure(df, {n: F.count(F.when(col(n).isNull(), 1)) for n, k in kind.items() if k not in ("other", "datetime")})
    changes = {}
    for n, nulls in open_.items():
        if nulls:
            number = kind[n] == "numeric"
            changes[n] = F.coalesce(col(n).cast("double" if number else "string"), F.lit(0.0 if number else UNKNOWN))
    return df.withColumns(changes) if changes else df


# ---------------------------------------------------------------- order-dependent fills


def _key(df: DataFrame, order_by: str) -> Column:
    if kinds(df)[order_by] == "datetime":
        return F.unix_micros(col(order_by).cast("timestamp"))
    return col(order_by)


def _with_neighbours(df: DataFrame, names: list[str], order_by: str, partition_by: list[str]) -> DataFrame:
    """Add ``_prev_i``/``_next_i``: the nearest filled cell at or before / at or after each row.

    A cell is ``(value, key)``. Rows are cut into key ranges; a window finds neighbours within a
    range, and one small row per range and group carries the last and first cell across ranges.
    Null groups are groups, and rows with a null key stand before all others.
    """
    key = _key(df, order_by)
    splits = range_splits(df, key, df.count())
    keyed = with_bucket(df.withColumn("_k", key), F.col("_k"), splits)
    groups = [*partition_by, "bucket"]
    # Looking ahead is looking back in descending order: frames that grow are computed once per
    # row, frames that shrink would be scanned again for every row.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*groups).orderBy("_k").rowsBetween(*so_far)
    ahead = Window.partitionBy(*groups).orderBy(F.col("_k").desc()).rowsBetween(*so_far)
    cells = {
        i: F.when(col(n).isNotNull(), F.struct(col(n).alias("value"), F.col("_k").alias("key")))
        for i, n in enumerate(names)
    }
    near = keyed.withColumns(
        {f"_prev_{i}": F.last(c, True).over(back) for i, c in cells.items()}
        | {f"_next_{i}": F.last(c, True).over(ahead) for i, c in cells.items()}
    )
    if not splits:
        return near.drop("bucket")
    # F.max over (key, value) picks the last cell of a range; null cells do not take part.
    edge = {}
    for i, n in enumerate(names):
        by_key = F.when(col(n).isNotNull(), F.struct(F.col("_k").alias("key"), col(n).alias("value")))
        edge[f"_last_{i}"], edge[f"_first_{i}"] = F.max(by_key), F.min(by_key)
    edges = keyed.groupBy(*groups).agg(*[e.alias(a) for a, e in edge.items()])
    earlier = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(*partition_by).orderBy("bucket").rowsBetween(*earlier)
    after = Window.partitionBy(*partition_by).orderBy(F.col("bucket").desc()).rowsBetween(*earlier)
    carried = edges.select(
        *groups,
        *[F.last(f"_last_{i}", True).over(before).alias(f"_carry_back_{i}") for i in cells],
        *[F.last(f"_first_{i}", True).over(after).alias(f"_carry_ahead_{i}") for i in cells],
    )
    joined = join_same(near, carried, groups)

    def cell(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(F.col(name)["value"].alias("value"), F.col(name)["key"].alias("key")))

    merged = joined.withColumns(
        {f"_prev_{i}": F.coalesce(F.col(f"_prev_{i}"), cell(f"_carry_back_{i}")) for i in cells}
        | {f"_next_{i}": F.coalesce(F.col(f"_next_{i}"), cell(f"_carry_ahead_{i}")) for i in cells}
    )
    return merged.drop("bucket", *[c for c in joined.columns if c.startswith("_carry_")])


def _in_file_order(fill, df: DataFrame, names: list[str], partition_by: list[str] | None) -> DataFrame:
    return fill(with_row_number(df, FILE_ORDER), names, FILE_ORDER, partition_by).drop(FILE_ORDER)


def forward_backward_fill(
    df: DataFrame, names: list[str], order_by: str | None = None, partition_by: list[str] | None = None
) -> DataFrame:
    """The previous filled value in key order, else the next one. The key must be unique.

    Without a key, rows are in the order of their files, which only rows straight from files have.
    """
    if order_by is None:
        return _in_file_order(forward_backward_fill, df, names, partition_by)
    near = _with_neighbours(df, names, order_by, partition_by or [])
    out = near.withColumns(
        {n: F.coalesce(col(n), F.col(f"_prev_{i}")["value"], F.col(f"_next_{i}")["value"]) for i, n in enumerate(names)}
    )
    return out.select(*map(col, df.columns))


def interpolate(df: DataFrame, names: list[str], order_by: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Linear in the order key between the neighbours; ends take the nearest value.

    Without a key, the row's number in its files is one.

    Numeric columns become double; timestamps stay timestamps.
    """
    if order_by is None:
        return _in_file_order(interpolate, df, names, partition_by)
    near = _with_neighbours(df, names, order_by, partition_by or [])
    kind, types = kinds(df), dict(df.dtypes)
    changes = {}
    for i, n in enumerate(names):
        prev, nxt = F.col(f"_prev_{i}"), F.col(f"_next_{i}")
        timed = kind[n] == "datetime"

        def level(c: Column, timed: bool = timed) -> Column:
            return (F.unix_micros(c.cast("timestamp")) if timed else c).cast("double")

        a, b = level(prev["value"]), level(nxt["value"])
        share = (F.col("_k") - prev["key"]).cast("double") / (nxt["key"] - prev["key"]).cast("double")
        between = F.coalesce(a + (b - a) * share, a, b)
        filled = F.timestamp_micros(F.round(between).cast("bigint")).cast(types[n]) if timed else between
        changes[n] = F.coalesce(col(n) if timed else col(n).cast("double"), filled)
    return near.withColumns(changes).select(*map(col, df.columns))


# ---------------------------------------------------------------- dispatch

# Fallback fill per inferred type.
FALLBACK = {"numeric": "median_imputation", "categorical": "mode_imputation", "binary": "mode_imputation", "datetime": "forward_fill"}


def neighbours_for(rows: int) -> int:
    return min(max(1, min(10, int(rows**0.5))), max(1, rows // 2))


def impute(
    df: DataFrame,
    strategies: dict[str, str],
    inferred: dict[str, str] | None = None,
    order_by: str | None = None,
    key: str | None = None,
    k: int | None = None,
) -> tuple[DataFrame, list[Action]]:
    """Fill each column by its strategy, judged by the stored kind of the column.

    All constants come from at most one job per statistic and are applied in one projection;
    neighbour and order-dependent fills follow. Without an order key, times in rows straight from
    files are filled in the order of the files.
    """
    kind, columns = kinds(df), df.columns
    if order_by is None and any(k == "datetime" for k in kind.values()) and has_file_order(df):
        df, order_by = with_row_number(df, FILE_ORDER), FILE_ORDER
    inferred = inferred or {}
    plan: dict[str, list[str]] = {}
    for n, wanted in strategies.items():
        if kind[n] == "numeric":
            known = ("knn_imputation", "mean_imputation", "zero", "drop")
            act = wanted if wanted in known else "median_imputation"
        elif kind[n] == "string":
            known = ("category_indicator", "constant_imputation", "drop")
            act = wanted if wanted in known else "mode_imputation"
        elif kind[n] == "datetime":
            act = wanted if wanted in ("interpolation", "drop") else "forward_fill"
        else:
            act = FALLBACK.get(inferred.get(n, ""), "constant_imputation")
        if act in ("forward_fill", "interpolation") and order_by is None:
            # a time has no constant to stand for it, and filling must not change its type
            act = "none" if kind[n] == "datetime" else "constant_imputation"
        plan.setdefault(act, []).append(n)
    out = df
    simple = [
        ("drop", drop_missing), ("median_imputation", median_fill), ("mean_imputation", mean_fill), ("zero", zero_fill),
        ("mode_imputation", mode_fill), ("category_indicator", indicator_fill), ("constant_imputation", constant_fill),
    ]
    if plan.get("knn_imputation"):  # first, so that distances use observed values only
        rows = df.count()
        for n in plan["knn_imputation"]:
            others = [c for c in columns if c != n and kind[c] == "numeric"]
            out = knn_fill(out, n, k or neighbours_for(rows), key, others)
    for act, fill in simple:
        if plan.get(act):
            out = fill(out, plan[act])
    if plan.get("forward_fill"):
        out = forward_backward_fill(out, plan["forward_fill"], order_by)
    if plan.get("interpolation"):
        out = interpolate(out, plan["interpolation"], order_by)
    def entry(act: str, n: str) -> Action:
        if act == "none":
            return Action("value_kept_missing", n, f"Left '{n}' missing: its fill needs an order key")
        return Action("value_imputed", n, f"Filled '{n}' by {act}")

    return out.select(*map(col, columns)), [entry(act, n) for act, names in plan.items() for n in names]


def scoring_fill(df: DataFrame, names: list[str], stored: dict[str, float] | None = None) -> DataFrame:
    """At scoring time: stored training means, else the means of the batch; other columns zero values."""
    numbers = set(columns_of(df, "numeric"))
    values = stored or means(df, [n for n in names if n in numbers])
    out = _fill(df, {n: v for n, v in values.items() if n in names}, "double")
    kind = kinds(df)
    zero = {"string": "", "boolean": False}
    rest = {n: zero[kind[n]] for n in names if kind[n] in zero}
    return _fill(out, rest, None)
