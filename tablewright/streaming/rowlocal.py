"""Row-local operators on streams.

Cleaning with stored decisions needs no state: planned casts, stored outlier bounds and fitted
models are applied per row, so the same projection runs on a stream and on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.clean import Cast, apply_casts, repair_texts
from tablewright.operators.outliers import apply_caps
from tablewright.plans.aggregates import col


def clean_rows(
    df: DataFrame,
    casts: list[Cast] | None = None,
    caps: dict[str, tuple[float, float]] | None = None,
    fills: dict[str, object] | None = None,
    parse_iso: bool = False,
) -> DataFrame:
    """Repair texts, convert, fill and cap rows by decisions taken on a table before."""
    out = apply_casts(repair_texts(df), casts or [], parse_iso)
    if fills:
        out = out.withColumns({n: F.coalesce(col(n), F.lit(v)) for n, v in fills.items()})
    return apply_caps(out, caps or {})


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Write all rows available now, exactly once across restarts."""
    return (
        df.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
