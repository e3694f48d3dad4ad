"""The whole exploration of a table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tablewright.operators import associate, correlate, describe, quality
from tablewright.operators.profile import TableProfile, dataset_frame, profile, profile_frame
from tablewright.plans.aggregates import kinds
from tablewright.plans.orderstats import numeric

SIDE_BY_SIDE = 4  # parts of an analysis that run at a time


@dataclass
class Analysis:
    """Named long-form results; views are filters over them."""

    profile: TableProfile
    frames: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def analyze(df: DataFrame, approximate: bool = False, cache: bool = False) -> Analysis:
    """Profile, issues, summaries, missingness, correlations and associations.

    Every statistic scans just the columns it needs, so a columnar source is read again rather
    than cached whole. ``cache`` persists the table, with spilling, while statistics are
    computed; it pays when the table is the costly result of other work and fits the cluster.
    """
    source = df.persist(StorageLevel.MEMORY_AND_DISK) if cache else df
    try:
        table = profile(source, approximate=approximate)
        kind = kinds(source)
        numbers = [n for n in table.of_type("numeric") if kind[n] in ("numeric", "string")]
        read = {n: numeric(n) for n in numbers if kind[n] == "string"}
        numbered = source.withColumns(read) if read else source  # text that holds numbers, as numbers
        words = [n for n in table.of_type("categorical", "binary", "boolean", "string")]
        # The parts do not wait for each other's many small jobs.
        parts: list[Callable[[], dict[str, DataFrame]]] = []
        if numbers and words:
            parts.append(lambda: {"group_tests": associate.group_tests(numbered, numbers, words)})
        parts.append(lambda: describe.column_statistics(source, table))
        if len(numbers) > 1:
            parts.append(lambda: {"spearman": correlate.spearman(numbered, numbers)})
            parts.append(lambda: {"pearson": correlate.pearson(numbered, numbers)})
        if len(words) > 1:
            parts.append(lambda: {"categorical_association": associate.categorical_association(source, words)})
        parts.append(lambda: {"issues": quality.issue_frame(df, quality.find_issues(source, table))})
        parts.append(lambda: {"missingness": describe.missingness(source), "co_missing": describe.co_missing(source)})
        frames = {
            "columns": profile_frame(df, table),
            "dataset": dataset_frame(df, table),
            "summary": describe.table_summary(source, table),
        }
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            for found in pool.map(lambda part: part(), parts):
                frames |= found
        if "pearson" in frames:
            frames["top_pairs"] = correlate.top_pairs(frames["pearson"])
        return Analysis(table, frames)
    finally:
        if cache:
            source.unpersist()
