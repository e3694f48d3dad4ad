"""Capping, removing and replacing outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.profile import iqr_bounds
from tablewright.plans.aggregates import col, measure
from tablewright.plans.orderstats import index_quantiles, interpolated_quantiles, numeric


def cap_bounds(df: DataFrame, names: list[str], low: float = 0.05, high: float = 0.95) -> dict[str, tuple[float, float]]:
    """Index quantiles used as caps; store them to cap other batches or a stream alike."""
    found = index_quantiles(df, names, [low, high])
    return {n: (a, b) for n, (a, b) in found.items() if a is not None}


def apply_caps(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clamp columns to stored bounds; row-local."""
    capped = {
        n: F.when(col(n).isNotNull(), F.least(F.greatest(numeric(n), F.lit(lo)), F.lit(hi)))
        for n, (lo, hi) in bounds.items()
    }
    return df.withColumns(capped) if capped else df


def capped_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    return measure(
        df, {n: F.count(F.when((numeric(n) < lo) | (numeric(n) > hi), 1)) for n, (lo, hi) in bounds.items()}
    )


def cap_outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """Clamp to the 5th and 95th index percentile."""
    return apply_caps(df, cap_bounds(df, names))


def remove_outliers(df: DataFrame, names: list[str], at_once: bool = False) -> DataFrame:
    """Drop rows outside 1.5 IQR; nulls stay.

    Columns are applied one after the other, each on the rows the former left, unless
    ``at_once`` takes all bounds from the full table in a single pass.
    """
    steps = [names] if at_once else [[n] for n in names]
    out = df
    for step in steps:
        for n, (lo, hi) in iqr_bounds(out, step).items():
            out = out.where(col(n).isNull() | numeric(n).between(lo, hi))
    return out


def replace_outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """Values outside 1.5 IQR become the median."""
    bounds = iqr_bounds(df, names)
    medians = interpolated_quantiles(df, list(bounds), [0.5])
    changed = {
        n: F.when((numeric(n) < lo) | (numeric(n) > hi), F.lit(medians[n][0])).otherwise(numeric(n))
        for n, (lo, hi) in bounds.items()
    }
    return df.withColumns(changed) if changed else df


# Names of the treatments.
CHOICES = {"cap_outliers": "cap", "remove_outliers": "remove", "median_replacement": "median", "keep_outliers": "keep"}


def treat_outliers(df: DataFrame, names: list[str], choice: str) -> DataFrame:
    """Dispatch on a choice; unknown choices keep the table as it is."""
    act = CHOICES.get(choice, choice)
    if act == "cap":
        return cap_outliers(df, names)
    if act == "remove":
        return remove_outliers(df, names)
    if act == "median":
        return replace_outliers(df, names)
    return df
