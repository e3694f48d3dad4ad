"""Order MinHash: document fingerprints that are sensitive to edit distance.

A text is the sequence of its word k-mers, and the o-th time a k-mer occurs it is an element of
its own. Every element hashes to a place on a ring; the ring of one hash, turned by j / m, is the
j-th of m orders. In each order the ``l`` minimal elements are selected, put back in the order
they have in the text, and hashed as a tuple. Two texts agree in one of the m numbers about as
often as they share the minimal k-mers *and* their order.

All of it is array functions inside a row. Hash and place share one long: the upper 36 bits are
the hash, the lower 28 the place in the text, so sorting longs orders elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, TUPLE, ORDERS = 5, 2, 32
PLACE_BITS = 28
BLANK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of the word k-mers in text order; fewer words make one k-mer, none an empty array."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")

    def rolled(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, several).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.slice(w, 1, 0))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), rolled)


def elements(hashes: Column) -> Column:
    """Occurrence-numbered k-mers as sorted longs of hash and place."""

    def numbered(h: Column) -> Column:
        first_only = F.transform(h, lambda x, i: _packed(F.xxhash64(x, F.lit(0)), i))

        def runs(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_hash(F.get(s, i)) != _hash(F.get(s, i - 1))))

            def spread(b: Column) -> Column:
                def one(begin: Column, r: Column) -> Column:
                    run = F.slice(s, begin + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - begin)
                    return F.transform(run, lambda x, o: _packed(F.xxhash64(F.get(h, _place(x).cast("int")), o), _place(x)))

                return F.flatten(F.transform(b, one))

            return _let(starts, spread)

        repeated = _let(F.sort_array(F.transform(h, lambda x, i: _packed(x, i))), runs)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), first_only).otherwise(repeated)

    return _let(hashes, lambda h: F.sort_array(numbered(h)))


def signature(text: Column, k: int = K, size: int = TUPLE, orders: int = ORDERS) -> Column:
    """``orders`` 32-bit numbers (a power of two up to 128); an empty array for a text without words.

    Equal texts have equal signatures, null counts as empty. Case and kind of white space matter
    as little as they do to words: case does, white space does not.
    """
    bits = orders.bit_length() - 1
    if orders != 1 << bits or bits > 7:
        raise ValueError("orders must be a power of two up to 128")

    def sector(x: Column) -> Column:
        return F.shiftright(x, 64 - bits) if bits else F.lit(0)

    def select(e: Column) -> Column:
        # the first few of each sector of the ring hold the minimal elements of every order
        few = F.filter(e, lambda x, i: (i < size) | (sector(x) != sector(F.get(e, i - size))))

        def one(c: Column, j: Column) -> Column:
            turned = F.slice(F.concat(F.filter(c, lambda x: sector(x) >= j), c), F.lit(1), F.least(F.lit(size), F.size(c)))
            in_text = F.sort_array(F.transform(turned, lambda x: F.struct(_place(x).alias("p"), _hash(x).alias("h"))))
            return F.xxhash64(F.transform(in_text, lambda t: t.h)).bitwiseAND(F.lit(0xFFFFFFFF))

        turns = F.sequence(F.lit(-(orders // 2)), F.lit((orders - 1) // 2))
        numbers = _let(few, lambda c: F.transform(turns, lambda j: one(c, j)))
        return F.when(F.size(e) > 0, numbers).otherwise(F.slice(e, 1, 0))

    return _let(elements(kmers(F.coalesce(text, F.lit("")), k)), select)


def shown(numbers: Column) -> Column:
    """A signature as text: eight hex digits a number."""
    return F.lower(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal numbers of two signatures: 1 for two empty ones, 0 if one is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def with_next(
    docs: DataFrame, key: str, columns: list[str], tie: Column, ranges: int, derived: dict[str, Column] | None = None
) -> DataFrame:
    """``docs`` with ``next_<column>``: the values in the row after, by descending key, then ``tie``; after the last row comes the first.

    ``derived`` columns are added to the rows and their neighbours alike, once a row. Null keys come last. Rows are dealt to ranges of (key, tie), whose borders are ``ranges`` rows
    of a sample by hash of 16 times as many. Only the largest row of each range is copied to
    the range above it, so a window within ranges is enough and no task sees the whole order.
    An empty table stays empty; the only row of a table follows itself.
    """
    spark, place = docs.sparkSession, F.struct(F.col(key).alias("key"), tie.alias("tie"))
    share = min(1.0, 16 * ranges / max(1, docs.count()))
    drawn = docs.select(place.alias("p")).where(F.xxhash64("p.key", "p.tie") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    sample = drawn.distinct().collect()
    points = sorted({(r.p.key is not None, r.p.key, r.p.tie) for r in sample}, key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
    borders = [points[i * len(points) // ranges][1:] for i in range(1, ranges)] if len(points) >= ranges else [p[1:] for p in points[1:]]
    kind = docs.select(place.alias("p")).schema["p"].dataType
    listed = F.array(*[F.struct(F.lit(k).cast(kind["key"].dataType).alias("key"), F.lit(t).alias("tie")) for k, t in borders]) if borders else F.array()
    bucket = F.size(F.filter(listed, lambda b: b <= place)) if borders else F.lit(0)
    dealt = docs.withColumns({"_next_range": bucket, "_next_place": place})
    largest = sorted((r[0], r[1]) for r in dealt.groupBy("_next_range").agg(F.max("_next_place")).collect())  # a row per range
    derived = derived or {}
    columns = [*columns, *derived]
    if not largest:
        return docs.withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    above = [(*p, largest[(i + 1) % len(largest)][0]) for i, (_, p) in enumerate(largest)]
    closing = spark.createDataFrame(above, T.StructType([*[T.StructField(f"_next_{f.name}", f.dataType) for f in kind.fields], T.StructField("_next_to", T.IntegerType())]))
    on = F.col("_next_place.key").eqNullSafe(F.col("_next_key")) & (F.col("_next_place.tie") == F.col("_next_tie"))
    copies = dealt.join(F.broadcast(closing), on).dropDuplicates(["_next_to"]).withColumn("_next_range", F.col("_next_to"))
    both = dealt.withColumn("_next_real", F.lit(True)).unionByName(copies.select(*dealt.columns, F.lit(False).alias("_next_real")))
    both = both.withColumns(derived)
    order = Window.partitionBy("_next_range").orderBy("_next_real", "_next_place")
    following = [F.lag(c).over(order).alias(f"next_{c}") for c in columns]
    return both.select("*", *following).where("_next_real").select(*docs.columns, *derived, *[f"next_{c}" for c in columns])


def edited(text: Column, following: Column) -> Column:
    """A text whose last half, rounded down, is replaced by as many first characters of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
