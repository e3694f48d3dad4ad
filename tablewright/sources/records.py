"""Records of CSV files, cut in parallel though quoted values may hold line breaks.

Whether a line begins inside quotes depends on every line before it, but each line is a function
of that one bit, and functions compose. So every input split folds its lines to one function, a
running composition over the splits of a file (one row each) gives the bit at each border, and a
second pass cuts the lines of every split into records. Only the pieces of records that cross a
border are shuffled. No task reads more than its split.

A quote opens a value only where a value begins; elsewhere outside quotes it is an ordinary
character. Doubled quotes inside a value stand for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A function of the bit "inside quotes": twice the outcome of outside, plus that of inside.
SAME, SWAP = 1, 2
# States along a line: outside, inside, behind a closing quote; a line starts like a closed value.
OUTSIDE, INSIDE, CLOSED = 0, 1, 2


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, block, turn``: the lines, the split that each lies in, and what the line does to the bit."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), _turn(F.col("value")).alias("turn"))


def _turn(line: Column) -> Column:
    parts = F.split(line, '"', -1)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)  # the text before each quote

    def ends_inside(start: int) -> Column:
        def step(state: Column, text: Column) -> Column:
            begins = text.endswith(",") | ((text == "") & (state == CLOSED))
            return F.when(state == INSIDE, F.lit(CLOSED)).when(begins, F.lit(INSIDE)).otherwise(F.lit(OUTSIDE))

        return (F.aggregate(before, F.lit(start), step) == INSIDE).cast("int")

    quoted = 2 * ends_inside(CLOSED) + ends_inside(INSIDE)
    return F.when(line.contains('"'), quoted).otherwise(F.lit(SAME)).cast("tinyint")


def crosses_lines(lines: DataFrame) -> bool:
    """Whether any value holds a line break."""
    return bool(lines.where(F.col("turn") >= 2).head(1))


def _states(turns: np.ndarray, start: int) -> np.ndarray:
    """The bit after each line, given the one before the first."""
    at = np.arange(len(turns))
    fixed = (turns != SAME) & (turns != SWAP)
    last = np.maximum.accumulate(np.where(fixed, at, -1))
    swaps = np.cumsum(turns == SWAP)
    base = np.where(last >= 0, turns[last] & 1, start)
    return (base + swaps - np.where(last >= 0, swaps[last], 0)) & 1


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, slice]]:
    """The rows of each split in a batch."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], slice(start, i)
            start = i


def _folded(lines: DataFrame) -> DataFrame:
    """``file, block, turn, stays``: one row a split; ``stays`` if a value open before it isn't closed in it."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            turns = batch.column(2).to_numpy(zero_copy_only=False)
            for key, rows in _runs(batch, ["file", "block"]):
                outside, inside, stays = found.get(key, (0, 1, True))
                both = [_states(turns[rows], s) for s in (outside, inside)]
                found[key] = [int(both[0][-1]), int(both[1][-1]), stays and bool(both[1].all())]
        if found:
            columns = [[k[0] for k in found], [k[1] for k in found], [2 * o + i for o, i, _ in found.values()], [s for *_, s in found.values()]]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "turn", "stays"])

    return lines.select("file", "block", "turn").mapInArrow(fold, "file string, block long, turn int, stays boolean")


def _borders(folded: DataFrame) -> DataFrame:
    """``file, block, origin`` of the splits that begin inside a value: ``origin`` is the split in which it opens."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("turn") == SWAP).cast("long")).over(before), F.lit(0))
    numbered = folded.withColumn("swaps", swaps)
    fixed = F.when(~F.col("turn").isin(SAME, SWAP), F.struct((F.col("turn") % 2).alias("bit"), "swaps"))
    known = numbered.withColumn("known", F.last(fixed, ignorenulls=True).over(before))
    bit = F.when(F.col("known").isNull(), F.col("swaps")).otherwise(F.col("known.bit") + F.col("swaps") - F.col("known.swaps"))
    begun = known.withColumn("inside", bit % 2 == 1)
    after = F.when(F.col("inside"), F.col("turn") % 2).otherwise(F.floor(F.col("turn") / 2)) == 1
    opens = F.when(after & ~(F.col("inside") & F.col("stays")), F.col("block"))
    return begun.withColumn("origin", F.last(opens, ignorenulls=True).over(before)).where("inside").select("file", "block", "origin")


def records(lines: DataFrame) -> DataFrame:
    """``value, header``: whole records in no order; the first of each file is its header. Blank lines between records go.

    The splits that begin inside a value are sent to all tasks, one short row each.
    """
    borders = F.broadcast(_borders(_folded(lines)).withColumnsRenamed({"file": "_file", "block": "_block"}))
    on = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    placed = lines.join(borders, on, "left").select("value", "file", "block", "turn", "origin")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, held, origin, first = None, 0, [], None, False
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            names = ["value", "header", "file", "origin", "block", "closed"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            values, turns = batch.column(0).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            origins = batch.column(4)
            for key, rows in _runs(batch, ["file", "block"]):
                if key != at:
                    if held:
                        out.append(("\n".join(held), first, *at[:1], at[1] if origin is None else origin, at[1], False))
                    at, held, first = key, [], key[1] == 0
                    origin = origins[rows.start].as_py()
                    state = int(origin is not None)
                for value, bit in zip(values[rows], _states(turns[rows], state).tolist(), strict=True):
                    held.append(value)
                    if not bit:
                        if origin is not None:
                            out.append(("\n".join(held), False, *at[:1], origin, at[1], True))
                        elif len(held) > 1 or value.strip():
                            out.append(("\n".join(held), first, None, None, None, None))
                            first = False
                        held, origin = [], None
                    state = bit
                if len(out) >= 4096:
                    yield sent()
        if held:
            out.append(("\n".join(held), first, *at[:1], at[1] if origin is None else origin, at[1], False))
        if out:
            yield sent()

    found = placed.mapInArrow(cut, "value string, header boolean, file string, origin long, block long, closed boolean")
    pieces = found.where("origin is not null").groupBy("file", "origin")
    ordered = F.sort_array(F.collect_list(F.struct("block", "value")))
    joined = pieces.agg(F.array_join(F.transform(ordered, lambda p: p.value), "\n").alias("value"), F.max("header").alias("header"))
    whole = found.where("origin is null").select("value", "header").unionByName(joined.select("value", "header"))
    return whole.select(F.regexp_replace("value", "\r$", "").alias("value"), "header")
