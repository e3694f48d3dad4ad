"""Ranks and running totals that never gather a table, or a large group, in one task.

Rows are first folded to distinct ``(group, value)`` pairs with a count, so a value that fills
a third of a table is one row. When more than ``BUCKET_ROWS`` rows are ranked, values are cut
into range buckets at approximate quantiles; each bucket gets the total of the buckets before
it, and a window runs inside each bucket only. The bucket of a row depends on its value alone,
so recomputed tasks place it the same way.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import cut_lineage

BUCKET_ROWS = 500_000
SAMPLED, MOST_TEXT_BUCKETS = 32, 2048
MOST_BROADCAST = 10_000  # groups that a broadcast may hold
NULL_BUCKET = -1.0  # null keys sort first


def is_text(df: DataFrame, key: Column) -> bool:
    kind = df.select(key.alias("k")).schema["k"].dataType
    return isinstance(kind, (T.StringType, T.BinaryType, T.CharType, T.VarcharType))


def position(df: DataFrame, key: Column) -> Column:
    """A double that never falls when the key, a number or a time, rises; null for null."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(key.cast("timestamp")).cast("double")
    return key.cast("double")


def range_splits(df: DataFrame, key: Column, rows: int) -> list:
    """Inner bucket borders for ``rows`` rows; empty when one bucket is enough.

    Borders of texts are whole keys, drawn by hash from the distinct ones, ``SAMPLED`` for each
    bucket and ``MOST_TEXT_BUCKETS`` buckets at most; a common beginning doesn't fold buckets.
    """
    buckets = -(-rows // BUCKET_ROWS)
    if buckets <= 1:
        return []
    if is_text(df, key):
        buckets = min(buckets, MOST_TEXT_BUCKETS)
        share = min(1.0, SAMPLED * buckets / rows)
        keys = df.select(key.cast("binary").alias("key")).where(F.xxhash64("key") <= min(2**63 - 1, int(share * 2**64) - 2**63))
        sample = sorted(bytes(r["key"]) for r in keys.where("key is not null").distinct().collect())
        return sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []
    shares = [i / buckets for i in range(1, buckets)]
    keyed = df.select(position(df, key).alias("key"))
    return sorted(set(keyed.approxQuantile("key", shares, 0.25 / buckets)))


def _borders_reached(key: Column, borders: list[bytes]) -> Column:
    """How many of the rising borders a key has reached, by binary search."""
    listed = F.array(*[F.unhex(F.lit(b.hex())) for b in borders])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        reached = (s["low"] < s["high"]) & (F.get(listed, middle) <= key)
        low = F.when(reached, middle + 1).otherwise(s["low"])
        return F.struct(low.alias("low"), F.when(reached, s["high"]).otherwise(F.least(middle, s["high"])).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(borders).bit_length())), start, halve)["low"]


def with_bucket(df: DataFrame, key: Column, splits: list) -> DataFrame:
    """Add ``bucket``, increasing with the key; null keys have the first bucket of all, NaN the last."""
    if not splits:
        return df.withColumn("bucket", F.lit(0.0))
    if isinstance(splits[0], bytes):
        reached = _borders_reached(key.cast("binary"), splits).cast("double")
        return df.withColumn("bucket", F.when(key.isNull(), NULL_BUCKET).otherwise(reached))
    cut = Bucketizer(
        splits=[-float("inf"), *splits, float("inf")],
        inputCol="_key",
        outputCol="_bucket",
        handleInvalid="keep",
    )
    at = df.withColumn("_key", position(df, key))
    null = F.col("_key").isNull()
    placed = cut.transform(at.withColumns({"_null": null, "_key": F.coalesce("_key", F.lit(0.0))}))
    return placed.withColumn("bucket", F.when(F.col("_null"), NULL_BUCKET).otherwise(F.col("_bucket"))).drop("_key", "_null", "_bucket")


def join_same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on equal names in which null equals null."""
    renamed = right.withColumnsRenamed({n: f"_same_{i}" for i, n in enumerate(names)})
    on = [left[n].eqNullSafe(renamed[f"_same_{i}"]) for i, n in enumerate(names)]
    return left.join(renamed, on).drop(*[f"_same_{i}" for i in range(len(names))])


def join_groups(rows: DataFrame, facts: DataFrame, names: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Rows joined with ``facts``, one row per group; no task takes the rows of a large group.

    ``weight`` in ``facts`` is about the number of rows of a group. Few groups are broadcast. Of many,
    those above ``BUCKET_ROWS`` are broadcast, which are few, and the rest meet their rows by a shuffle.
    """
    facts = cut_lineage(facts)
    if len(facts.select(F.lit(1)).take(MOST_BROADCAST + 1)) <= MOST_BROADCAST:
        return rows.join(F.broadcast(facts), names, how)
    large = facts.where(F.col(weight) > BUCKET_ROWS)
    small = facts.where(F.col(weight) <= BUCKET_ROWS)
    rest = rows.join(F.broadcast(large.select(*names)), names, "left_anti")
    return rows.join(F.broadcast(large), names, how).unionByName(rest.join(small, names, how))


def running_totals(
    df: DataFrame, groups: list[str], key: str, weight: str, splits: list, total: str | None = None
) -> DataFrame:
    """Add ``before``: the weight of all rows of the group with a smaller key; null is the smallest.

    ``(groups, key)`` must be unique. Null groups are groups. ``total``, if given, names a column
    for the weight of the whole group.
    """
    sums = {total: F.sum(weight).over(Window.partitionBy(*groups))} if total else {}
    if not splits:
        w = Window.partitionBy(*groups).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({"before": F.coalesce(F.sum(weight).over(w), F.lit(0)), **sums})
    cut = with_bucket(df, F.col(key), splits)
    # At most one row per group and bucket, so the window over a group is bounded.
    per_bucket = cut.groupBy(*groups, "bucket").agg(F.sum(weight).alias("_in"))
    w = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *groups, "bucket", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_offset"),
        *[F.sum("_in").over(Window.partitionBy(*groups)).alias(n) for n in sums],
    )
    inner = (
        Window.partitionBy(*groups, "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        join_same(cut, offsets, [*groups, "bucket"])
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .drop("bucket", "_offset")
    )


def rank_values(
    counted: DataFrame, groups: list[str], key: str, weight: str, splits: list[float]
) -> DataFrame:
    """``(groups, key, ties, before, rank)``: the average rank of each distinct value."""
    totals = counted.groupBy(*groups, key).agg(F.sum(weight).alias("ties"))
    ranked = running_totals(totals, groups, key, "ties", splits)
    return ranked.withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2)


def group_quantiles(
    df: DataFrame, groups: list[str], value: str, shares: list[float], rows: int, splits: list[float] | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Interpolated quantiles per group as array ``quantiles``, exact at any group size.

    ``splits`` are the range borders of the values and ``cells`` their counts ``n`` per group,
    where the caller has them already.
    """
    data = df.where(F.col(value).isNotNull())
    if rows <= BUCKET_ROWS:  # the aggregation buffers together hold at most this many values
        return data.groupBy(*groups).agg(
            F.percentile(value, F.array(*map(F.lit, shares))).alias("quantiles")
        )
    splits = range_splits(data, F.col(value), rows) if splits is None else splits
    if cells is None:
        counted = data.groupBy(*groups, value).agg(F.count("*").alias("ties"))
    else:
        counted = cells.select(*groups, value, F.col("n").alias("ties"))
    placed = running_totals(counted, groups, value, "ties", splits, total="_n")
    picks = []
    for i, q in enumerate(shares):
        spot = F.lit(q) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("ties"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    found = placed.groupBy(*groups, "_n").agg(*picks)
    out = []
    for i, q in enumerate(shares):
        spot = F.lit(q) * (F.col("_n") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(low + (high - low) * (spot - F.floor(spot)))
    return found.select(*groups, F.array(*out).alias("quantiles"))
