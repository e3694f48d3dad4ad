"""Correlation matrices in long form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distributions import correlation_p
from tablewright.plans.aggregates import measure
from tablewright.plans.orderstats import numeric
from tablewright.plans.ranks import range_splits, rank_values

MATRIX_SCHEMA = "x string, y string, value double, p_value double, n bigint"


def _matrix(df: DataFrame, names: list[str], found: dict[tuple[str, str], tuple[float | None, int]]) -> DataFrame:
    """Both triangles and the diagonal; pairs without a usable estimate are 0 with p = 1."""
    rows = [(n, n, 1.0, 0.0, None) for n in names]
    for (a, b), (r, size) in found.items():
        usable = size >= 3 and r is not None and r == r
        value, p = (r, correlation_p(r, size)) if usable else (0.0, 1.0)
        rows += [(a, b, value, p, size), (b, a, value, p, size)]
    return df.sparkSession.createDataFrame(rows, MATRIX_SCHEMA)


def pearson_pairs(df: DataFrame, names: list[str]) -> dict[tuple[str, str], tuple[float | None, int]]:
    """Correlation and size of each pair over the rows where both are filled, in one scan."""
    calls = {}
    for a, b in combinations(names, 2):
        x, y = numeric(a), numeric(b)
        calls[(a, b, "r")] = F.corr(x, y)
        calls[(a, b, "n")] = F.regr_count(x, y)
    seen = measure(df, calls)
    return {(a, b): (seen[(a, b, "r")], seen[(a, b, "n")]) for a, b in combinations(names, 2)}


def pearson(df: DataFrame, names: list[str]) -> DataFrame:
    return _matrix(df, names, pearson_pairs(df, names))


def _ranked_once(df: DataFrame, names: list[str], rows: int) -> dict[tuple[str, str], tuple[float | None, int]]:
    """Pairs of columns that are filled in every row: each column is ranked once, ties averaged.

    A row is copied once per column to find its ranks, which meet again by the row's number;
    all pairs are then one aggregate. The number only has to tell the rows of one job apart.
    """
    numbered = df.select(F.monotonically_increasing_id().alias("row"), *[numeric(n).alias(f"v{i}") for i, n in enumerate(names)])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"v{i}").alias("v")) for i in range(len(names))]))
    long = numbered.select("row", cells.alias("c")).select("row", "c.column", "c.v")
    counted = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    ranks = rank_values(counted, ["column"], "v", "n", range_splits(long, F.col("v"), rows * len(names)))
    placed = long.join(ranks.select("column", "v", "rank"), ["column", "v"])
    wide = placed.groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(names))])
    pairs = list(combinations(range(len(names)), 2))
    seen = measure(wide, {p: F.corr(f"r{p[0]}", f"r{p[1]}") for p in pairs})
    return {(names[i], names[j]): (seen[(i, j)], rows) for i, j in pairs}


def spearman_pairs(df: DataFrame, names: list[str]) -> dict[tuple[str, str], tuple[float | None, int]]:
    """Rank correlation per pair, ranks taken over the pair's complete rows, ties averaged.

    Columns without a gap are ranked once for all their pairs. A pair with gaps has ranks of its
    own: its rows are folded to distinct value pairs with a count, each side is ranked on its
    distinct values, and the moments of the ranks are weighted sums.
    """
    sizes = measure(df, {None: F.count(F.lit(1))} | {n: F.count(numeric(n)) for n in names})
    whole = [n for n in names if sizes[n] == sizes[None]]
    out: dict = {p: (None, 0) for p in combinations(names, 2)}
    if len(whole) > 1 and sizes[None]:
        out |= _ranked_once(df, whole, sizes[None])
    pairs = [p for p in out if not set(p) <= set(whole)]
    if not pairs:
        return out
    cells = [
        F.struct(F.lit(i).alias("pair"), numeric(a).alias("x"), numeric(b).alias("y")) for i, (a, b) in enumerate(pairs)
    ]
    rows = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    total = sizes[None] * len(pairs)
    counted = rows.groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    xs = rank_values(counted, ["pair"], "x", "n", range_splits(rows, F.col("x"), total))
    ys = rank_values(counted, ["pair"], "y", "n", range_splits(rows, F.col("y"), total))
    joined = counted.join(xs.select("pair", "x", F.col("rank").alias("rx")), ["pair", "x"]).join(
        ys.select("pair", "y", F.col("rank").alias("ry")), ["pair", "y"]
    )
    n, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = joined.groupBy("pair").agg(
        F.sum("n").alias("size"), F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy")
    )
    for r in sums.collect():  # one row per pair
        centre = r["size"] * ((r["size"] + 1) / 2.0) ** 2
        scale = ((r["xx"] - centre) * (r["yy"] - centre)) ** 0.5
        out[pairs[r["pair"]]] = ((r["xy"] - centre) / scale if scale > 0 else None, r["size"])
    return out


def spearman(df: DataFrame, names: list[str]) -> DataFrame:
    return _matrix(df, names, spearman_pairs(df, names))


def top_pairs(matrix: DataFrame, k: int = 20) -> DataFrame:
    """The strongest pairs by absolute value."""
    return (
        matrix.where((F.col("x") < F.col("y")) & (F.col("n") >= 3))
        .orderBy(F.abs("value").desc(), "x", "y")
        .limit(k)
    )
