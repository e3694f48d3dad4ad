"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` points of a ring of 64-bit positions; a row's key hashes to a
position and belongs to the next point clockwise. A shard takes rows up to its capacity only.
Rows beyond it continue clockwise to the next point whose shard has room, so balance is
guaranteed and a change in the number of shards moves few rows.

The walk never looks at rows: it needs the number of rows per arc, a table as large as the ring,
and answers with stretches of each arc (``arc, first rank, end rank, shard``). Rows learn their
rank within their arc from a window over cells, small parts of an arc that split a key which
fills a third of the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.store import written

REPLICAS = 64
CELLS = 16


def ring(shards: int, replicas: int = REPLICAS) -> tuple[np.ndarray, list[int]]:
    """Sorted positions of the virtual nodes (signed 64 bits) and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{r}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards)
        for r in range(replicas)
    )
    return np.array([p for p, _ in points], dtype=np.int64), [s for _, s in points]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard: (1 + slack) times the mean, or with no slack shares one apart at most."""
    if slack > 0:
        return [int(np.ceil((1 + slack) * rows / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Stretches ``(arc, lo, hi, shard, slot of lo)`` that place every row of every arc.

    In each round all rows that wait at a full shard move on together; a shard takes those at its
    points in ring order. Each round fills a shard or places everything, so there are no more
    rounds than shards.
    """
    free, taken, n = list(room), [0] * len(room), len(owners)
    waiting = [(arc, 0, c, arc) for arc, c in enumerate(counts) if c]
    placed = []
    while waiting:
        rest = []
        for arc, lo, hi, at in sorted(waiting, key=lambda x: (x[3], x[0], x[1])):
            shard = owners[at]
            take = min(hi - lo, free[shard])
            if take:
                placed.append((arc, lo, lo + take, shard, taken[shard]))
                free[shard] -= take
                taken[shard] += take
            if take < hi - lo:
                rest.append((arc, lo + take, hi, at))
        if rest and not any(free):
            raise ValueError("the shards hold fewer rows than there are")
        waiting = []
        for arc, lo, hi, at in rest:
            step = next(k for k in range(1, n + 1) if free[owners[(at + k) % n]])
            waiting.append((arc, lo, hi, (at + step) % n))
    return placed


def ring_shards(
    df: DataFrame, key: Column, shards: int, replicas: int = REPLICAS, slack: float = 0.0, cells: int = CELLS
) -> DataFrame:
    """``df`` with ``home_shard`` (where an unbounded ring puts the row), ``shard`` and ``slot``.

    ``slot`` counts the rows of a shard without gaps from 0. With ``slack`` 0 the shards' row
    counts differ by one at most; a larger slack moves fewer rows when shards come or go.
    Null keys share one position; equal keys may be dealt over several shards when theirs is
    full. An empty table gives an empty result. Columns of ``df`` are kept and must not be called
    ``home_shard``, ``shard``, ``slot`` or begin with ``_ring``. Which of an arc's rows overflow
    depends on the order of the stored rows.
    """
    points, owners = ring(shards, replicas)

    @F.pandas_udf(T.IntegerType())
    def arc(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, position.to_numpy(), side="left") % len(points)).astype("int32"))

    spark = df.sparkSession
    rows = written(
        df.withColumns({"_ring_arc": arc(F.xxhash64(key)), "_ring_cell": F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int")}),
        "ring",
    )
    counted = rows.groupBy("_ring_arc", "_ring_cell").agg(F.count(F.lit(1)).alias("_ring_n"))
    held = [0] * len(points)
    # at most one number per virtual node and cell
    starts = []
    for a, c, n in sorted(tuple(r) for r in counted.collect()):
        starts.append((a, c, held[a]))
        held[a] += n
    placed = walk(held, owners, capacities(sum(held), shards, slack))
    begin = spark.createDataFrame(starts, "_ring_arc int, _ring_cell int, _ring_begin long")
    stretch = spark.createDataFrame(
        [(a, lo, hi, s, at, owners[a]) for a, lo, hi, s, at in placed],
        "_ring_arc int, _ring_lo long, _ring_hi long, shard int, _ring_at long, home_shard int",
    )
    order = Window.partitionBy("_ring_arc", "_ring_cell").orderBy(F.xxhash64(key))
    ranked = (
        rows.withColumn("_ring_rank", F.row_number().over(order))
        .join(F.broadcast(begin), ["_ring_arc", "_ring_cell"])
        .withColumn("_ring_rank", F.col("_ring_begin") + F.col("_ring_rank") - 1)
    )
    inside = (F.col("_ring_rank") >= F.col("_ring_lo")) & (F.col("_ring_rank") < F.col("_ring_hi"))
    found = ranked.alias("r").join(F.broadcast(stretch).alias("s"), (F.col("r._ring_arc") == F.col("s._ring_arc")) & inside)
    return found.select(
        *[F.col(f"r.`{c}`") for c in df.columns],
        "home_shard",
        "shard",
        (F.col("_ring_at") + F.col("_ring_rank") - F.col("_ring_lo")).alias("slot"),
    )
