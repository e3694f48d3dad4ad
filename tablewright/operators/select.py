"""Projection, row ranges, previews and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.aggregates import col, measure
from tablewright.plans.ranks import range_splits, with_bucket

SHALLOW_ROWS = 100_000  # a sorted prefix of this length may pass through one task


def require_columns(df: DataFrame, names: list[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def select_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Keep the named columns; none named keeps all."""
    if not names:
        return df
    require_columns(df, names)
    return df.select(*map(col, names))


def exclude_columns(df: DataFrame, names: list[str], target: str | None = None) -> DataFrame:
    """Drop the named columns; unknown names and the target are refused."""
    require_columns(df, names)
    if target is not None and target in names:
        raise ValueError(f"the target column {target} cannot be excluded")
    return df.drop(*names)


def row_range(df: DataFrame, start: int, end: int, order_by: str) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) in the order of a unique key of any kind; null keys come first.

    A range near the top is a bounded top-k. For a deep one the table is cut into key ranges whose
    counts tell which hold the wanted rows: those inside pass a filter, and only the two at the
    ends are ordered within.
    """
    count = max(0, end - start)
    if start + count <= SHALLOW_ROWS:
        return df.orderBy(col(order_by)).offset(start).limit(count)
    cut = with_bucket(df, col(order_by), range_splits(df, col(order_by), df.count()))
    inside, ends, before = [], [], 0
    for bucket, n in sorted(tuple(r) for r in cut.groupBy("bucket").count().collect()):  # one row per range
        if start <= before and before + n <= end:
            inside.append(bucket)
        elif before < end and start < before + n:
            ends.append((bucket, max(0, start - before), end - before))
        before += n
    whole = cut.where(F.col("bucket").isin(inside)).drop("bucket") if inside else df.limit(0)
    for bucket, low, high in ends:
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(col(order_by)))
        part = cut.where(F.col("bucket") == bucket).withColumn("_place", place)
        whole = whole.unionByName(part.where((F.col("_place") > low) & (F.col("_place") <= high)).drop("bucket", "_place"))
    return whole


def page(df: DataFrame, start: int, count: int, order_by: str) -> tuple[DataFrame, int]:
    """A page of rows and the total; start and count are clamped to the table."""
    total = df.count()
    first = min(start, max(total - 1, 0))
    size = min(count, total - first)
    return row_range(df, first, first + size, order_by), total


def target_last(df: DataFrame, target: str) -> DataFrame:
    """The target as the last column."""
    require_columns(df, [target])
    return df.select(*[col(c) for c in df.columns if c != target], col(target))


def drop_date_columns(df: DataFrame, inferred: dict[str, str], task: str, target: str | None) -> DataFrame:
    """Drop inferred dates, except the target, for classification and regression."""
    if task not in ("classification", "regression"):
        return df
    return df.drop(*[n for n, t in inferred.items() if t == "datetime" and n != target])


def split_identifiers(df: DataFrame, inferred: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A training table without inferred identifiers, and the full table."""
    return df.drop(*[n for n, t in inferred.items() if t == "identifier"]), df


def preview_rows(df: DataFrame, names: list[str], order_by: str, rows: int = 5, width: int = 5) -> DataFrame:
    """The first rows of up to five affected columns."""
    shown = [n for n in names if n in df.columns][:width]
    return df.orderBy(col(order_by)).limit(rows).select(*map(col, shown))


def sample_values(
    df: DataFrame,
    names: list[str] | None = None,
    k: int = 10,
    seed: int = 42,
    key: list[str] | None = None,
    sizes: dict[str, int] | None = None,
) -> dict[str, list[str]]:
    """Up to ``k`` non-null values per column as text, the rows with the smallest hash first.

    The hash covers the key columns (all columns by default), so the sample depends neither on
    row order nor on partitioning. Rows above a hash threshold chosen from the column's size are
    dropped inside the scan; a column that falls short is read again with a higher threshold.
    """
    names = names or df.columns
    sizes = sizes or measure(df, {n: F.count(col(n)) for n in names})
    hashed = F.xxhash64(*[col(c) for c in (key or df.columns)], F.lit(seed))
    want = {n: min(k, sizes[n]) for n in names}
    shares = {n: min(1.0, (4 * k + 24) / sizes[n]) for n in names if sizes[n]}
    out: dict[str, list[str]] = {n: [] for n in names}
    open_ = list(shares)
    while open_:
        calls = {}
        for n in open_:
            keep = col(n).isNotNull()
            if shares[n] < 1.0:
                keep = keep & (hashed < int(-(2**63) + shares[n] * 2**64))
            entry = F.when(keep, F.struct(hashed.alias("h"), col(n).cast("string").alias("v")))
            calls[n] = F.slice(F.array_sort(F.collect_set(entry)), 1, k)
        for n, entries in measure(df, calls).items():
            out[n] = [e["v"] for e in entries]
        open_ = [n for n in open_ if len(out[n]) < want[n] and shares[n] < 1.0]
        shares = {n: min(1.0, shares[n] * 16) for n in open_}
    # Rows that are copies of each other share a hash; they stand for as many draws.
    for n in names:
        drawn = out[n]
        if drawn and len(drawn) < want[n]:
            out[n] = [drawn[i % len(drawn)] for i in range(want[n])]
    return out


def column_listing(
    profile: DataFrame,
    search: str | None = None,
    types: list[str] | None = None,
    sort_by: str = "name",
    direction: str = "asc",
) -> DataFrame:
    """Filter and sort profiled columns; ``total`` counts all, ``filtered`` the kept ones."""
    shown = profile
    text = (search or "").strip().lower()
    if text:
        shown = shown.where(F.lower("name").contains(text))
    wanted = [t.lower() for t in types or []]
    if wanted and "all" not in wanted:
        shown = shown.where(F.lower("inferred_type").isin(wanted))
    keys = {"nulls": "null_percentage", "cardinality": "unique_count", "type": "inferred_type"}
    order = F.col(keys.get(sort_by, "name"))
    total, filtered = profile.count(), shown.count()
    return (
        shown.withColumns({"total": F.lit(total), "filtered": F.lit(filtered)})
        .select("name", "dtype", "inferred_type", "inferred_role", "unique_count", "null_percentage", "total", "filtered")
        .orderBy(order.desc() if direction.lower() == "desc" else order.asc(), "name")
    )

