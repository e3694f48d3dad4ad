"""Exact order statistics that stay distributed.

Spark's exact percentile keeps every distinct value of a column in one aggregation buffer.
That is fine for a bounded number of rows only, so beyond ``DIRECT_ROWS`` a value is located
by narrowing: an approximate percentile brackets the wanted rank, one scan counts what lies
below and inside the bracket, and the step repeats on the bracket until its content fits.
Counts prove every bracket, so the result is exact whatever the sketch returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as X
from tablewright.plans.aggregates import col, measure

DIRECT_ROWS = 50_000
SKETCH_ACCURACY = 10_000


def _number(c: Column) -> Column:
    kind = F.typeof(c)  # known when the query is planned, so one branch is left
    text = X.float_or_null(X.trimmed(c.cast("string")))
    value = c.try_cast("double")
    real = F.when(kind.isin("float", "double"), F.when(~F.isnan(value), value)).otherwise(value)
    return F.when(kind == "string", text).otherwise(real)


def numeric(name: str) -> Column:
    """A column as double; NaN, and text that is no plain number, read as missing."""
    return _number(col(name))


def counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    return measure(df, {n: F.count(numeric(n)) for n in names})


def values_at(
    df: DataFrame,
    wanted: dict[str, list[int]],
    sizes: dict[str, int],
    expressions: dict[str, Column] | None = None,
    direct_rows: int | None = None,
) -> dict[tuple[str, int], float]:
    """The values at the given 0-based ranks of each column's sorted non-null values."""
    limit = direct_rows or DIRECT_ROWS
    value = {n: (expressions or {}).get(n, numeric(n)) for n in wanted}
    # One open bracket per rank: values in [low, high], `below` values smaller than low.
    open_ = {
        (n, r): (-math.inf, math.inf, 0, sizes[n]) for n, ranks in wanted.items() for r in set(ranks)
    }
    done: dict[tuple[str, int], float] = {}
    while open_:
        small = {k: b for k, b in open_.items() if b[3] <= limit}
        done.update(_read_small(df, value, small))
        open_ = {k: b for k, b in open_.items() if k not in small}
        if not open_:
            break
        open_, found = _narrow(df, value, open_)
        done.update(found)
    return done


def _inside(c: Column, low: float, high: float) -> Column:
    kept = c
    if low != -math.inf:
        kept = F.when(c >= low, kept)
    if high != math.inf:
        kept = F.when(c <= high, kept)
    return kept


def _read_small(df: DataFrame, value: dict, brackets: dict) -> dict:
    """Read ranks from brackets that are known to fit one aggregation buffer."""
    groups: dict = {}
    for (n, r), bracket in brackets.items():
        groups.setdefault((n, bracket), []).append(r)
    names = {g: f"v{i}" for i, g in enumerate(groups)}
    slim = df.select(*[_inside(value[n], b[0], b[1]).alias(names[(n, b)]) for n, b in groups])
    # The half step keeps the discrete percentile clear of rounding at the rank boundary.
    calls = {}
    for (n, (low, high, below, inside)), ranks in groups.items():
        shares = ", ".join(f"{(r - below + 0.5) / inside!r}D" for r in ranks)
        v = names[(n, (low, high, below, inside))]
        calls[(n, tuple(ranks))] = F.expr(f"percentile_disc(array({shares})) within group (order by {v})")
    found = measure(slim, calls)
    return {(n, r): x for (n, ranks), values in found.items() for r, x in zip(ranks, values)}


def _narrow(df: DataFrame, value: dict, brackets: dict) -> tuple[dict, dict]:
    step = 2.0 / SKETCH_ACCURACY
    # Ranks that share a bracket share one sketch.
    groups: dict = {}
    for (n, r), bracket in brackets.items():
        groups.setdefault((n, bracket), []).append(r)
    sketches = {}
    for (n, bracket), ranks in groups.items():
        low, high, below, inside = bracket
        centres = [(r - below + 0.5) / inside for r in ranks]
        shares = [s for p in centres for s in (max(0.0, p - step), min(1.0, p + step))]
        sketches[(n, bracket)] = F.percentile_approx(_inside(value[n], low, high), shares, SKETCH_ACCURACY)
    ends = {}
    for (n, bracket), found in measure(df, sketches).items():
        for i, r in enumerate(groups[(n, bracket)]):
            ends[(n, r)] = (found[2 * i], found[2 * i + 1])
    checks = {}
    for (n, r), (low, high, _, _) in brackets.items():
        a, b = ends[(n, r)]
        c = value[n]
        checks[(n, r, "below")] = F.count(F.when(c < a, 1))
        checks[(n, r, "low")] = F.count(F.when(c == a, 1))
        checks[(n, r, "upto")] = F.count(F.when(c <= b, 1))
        checks[(n, r, "high")] = F.count(F.when(c == b, 1))
    seen = measure(df, checks)
    still, found = {}, {}
    for (n, r), (low, high, below, inside) in brackets.items():
        a, b = ends[(n, r)]
        under, at_low = seen[(n, r, "below")], seen[(n, r, "low")]
        upto, at_high = seen[(n, r, "upto")], seen[(n, r, "high")]
        if under <= r < under + at_low:
            found[(n, r)] = a
        elif upto - at_high <= r < upto:
            found[(n, r)] = b
        elif r < under:  # the sketch missed on this side: keep the proven part
            still[(n, r)] = (low, math.nextafter(a, -math.inf), below, under - below)
        elif r >= upto:
            still[(n, r)] = (math.nextafter(b, math.inf), high, upto, below + inside - upto)
        else:
            still[(n, r)] = (
                math.nextafter(a, math.inf),
                math.nextafter(b, -math.inf),
                under + at_low,
                upto - at_high - under - at_low,
            )
    return still, found


def index_quantiles(
    df: DataFrame, names: list[str], shares: list[float], sizes: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """``sorted[floor(n * q)]`` of each column."""
    sizes = sizes or counts(df, names)
    ranks = {n: [min(int(sizes[n] * q), sizes[n] - 1) for q in shares] for n in names if sizes[n]}
    at = values_at(df, ranks, sizes)
    return {n: [at[(n, r)] for r in ranks[n]] if sizes[n] else [None] * len(shares) for n in names}


def interpolated_quantiles(
    df: DataFrame,
    names: list[str],
    shares: list[float],
    sizes: dict[str, int] | None = None,
    expressions: dict[str, Column] | None = None,
) -> dict[str, list[float | None]]:
    """Linear interpolation at position ``q * (n - 1)``."""
    sizes = sizes or counts(df, names)
    value = {n: (expressions or {}).get(n, numeric(n)) for n in names}
    out: dict[str, list[float | None]] = {n: [None] * len(shares) for n in names}
    direct = [n for n in names if 0 < sizes[n] <= DIRECT_ROWS]
    out.update(measure(df, {n: F.percentile(value[n], F.array(*map(F.lit, shares))) for n in direct}))
    large = [n for n in names if sizes[n] > DIRECT_ROWS]
    if large:
        spots = {n: [q * (sizes[n] - 1) for q in shares] for n in large}
        ranks = {n: [f(p) for p in spots[n] for f in (math.floor, math.ceil)] for n in large}
        at = values_at(df, ranks, sizes, expressions)
        for n in large:
            pairs = [(at[(n, math.floor(p))], at[(n, math.ceil(p))], p - math.floor(p)) for p in spots[n]]
            out[n] = [a + (b - a) * w for a, b, w in pairs]
    return out
