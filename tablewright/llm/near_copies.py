"""Near copies: SimHash fingerprints within 3 bits, and five-word shingle sets with a Jaccard similarity of 0.8 or more.

Vantage-point trees over the fingerprints of ``simhash`` link texts first, exactly; what they connect is one
component from the start. Similar sets then connect those that lie farther apart in bits.

In any common order of all shingles, two sets that similar share one of the first
``n - ceil(0.8 n) + 1`` shingles of each. Only these prefixes are shuffled; sets that meet in a
prefix and fit in size are compared in full, so no pair is missed and none is let in unproved.
The order is that of the hashes, with shingles that recur in a sample of the documents last: it
decides only how many pairs are compared. A shingle that many prefixes hold is compared with drawn
members first, as what these connect needs no comparison of its own.

Before texts are sent, two sets are compared by their parity bitmaps, two bits a shingle: sets
that differ in n shingles differ in at most n bits, so a pair whose bitmaps differ in more bits than
similar sets can is dropped, and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.components import components
from tablewright.llm.simhash import near_edges, simhash
from tablewright.llm.store import discard, written

WIDTH = 5
SHARE, LEAST = 1 / 16, 2000  # of the documents, and at least so many, show which shingles recur
RECURS, MOST_RECURRING = 3, 500_000
CROWD = 32  # prefixes that meet in all pairs after the first draw
DRAWS = 6
MOST_BITS = 1 << 16


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles, by the words of ``simhash``; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    shingles = [b" ".join(words)] if len(words) <= WIDTH else set(map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False)))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8").view("<i8"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _recurring(texts: DataFrame) -> np.ndarray:
    """Shingles of at least ``RECURS`` different sampled texts, sorted; the most frequent if there are more than ``MOST_RECURRING``."""
    share = min(1.0, max(SHARE, LEAST / max(1, texts.count())))
    some = texts.where(F.xxhash64("h") <= min(2**63 - 1, int(share * 2**64) - 2**63))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), name or 0))], names=["t", "h"])

    spoken = some.select("h", "text").mapInArrow(spread, "t long, h long").groupBy("t")
    counted = spoken.agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where((F.col("n") >= RECURS) & (F.col("lo") != F.col("hi")))
    return np.sort(counted.orderBy(F.desc("n"), "t").limit(MOST_RECURRING).select("t").toArrow()["t"].to_numpy())


def held(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of some numbers are in a sorted list."""
    if not len(last):
        return np.zeros(len(found), bool)
    return last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found


def parity(found: np.ndarray) -> bytes:
    """A bitmap of at least two bits a shingle, up to ``MOST_BITS``: whether an odd number of shingles falls on a bit."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(found) - 1).bit_length()))
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """The number of shingles that two sets differ in, at least; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _prefixes(texts: DataFrame, key: T.DataType) -> DataFrame:
    """``k, h, s, fp, size, prefix, bits``: key, text hash, a hash of the set, the text's SimHash, the set's size, prefix and bitmap."""
    last = _recurring(texts)
    schema = T.StructType(
        [T.StructField("k", key), T.StructField("h", T.LongType()), T.StructField("s", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType())]
        + [T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                names, prints, sizes, heads, maps = [], [], [], [], []
                for text in some.column(2):
                    found = shingle_set(text.as_py())
                    names.append(xxhash.xxh64_intdigest(found.tobytes()))
                    prints.append(simhash(text.as_py()))
                    sizes.append(len(found))
                    late = held(found, last)
                    heads.append(np.concatenate([found[~late], found[late]])[: len(found) - (4 * len(found) + 4) // 5 + 1])
                    maps.append(parity(found))
                columns = [pa.array(np.array(names, "<u8").view("<i8")), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns], names=schema.names)

    return texts.select("k", "h", "text").mapInArrow(cut, schema)


def _both(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs ``u, v`` with the columns that ``facts`` has of each set."""
    for side in ("u", "v"):
        pairs = pairs.join(facts.select(F.col("s").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def _proved(pairs: DataFrame, bitmaps: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``u, v, u_c, v_c`` whose sets are similar."""
    schema = pairs.schema

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_pylist() for c in ("u_bits", "v_bits", "u_size", "v_size"))
            keep = [9 * least_difference(w, x) <= y + z for w, x, y, z in zip(a, b, n, m, strict=True)]
            yield batch.select(schema.names).filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, keep = batch.slice(at, 256), []
                for u, v, a, b in zip(*(some.column(c) for c in ("u", "v", "u_text", "v_text")), strict=True):
                    sides = []
                    for name, text in ((u.as_py(), a), (v.as_py(), b)):
                        if name not in seen:
                            if len(seen) >= 64:
                                seen.clear()
                            seen[name] = shingle_set(text.as_py())
                        sides.append(seen[name])
                    keep.append(similar(*sides))
                yield some.select(schema.names).filter(pa.array(keep, pa.bool_()))

    close = written(_both(pairs, bitmaps, ["size", "bits"]).mapInArrow(may, schema), "close")
    return written(_both(close, bodies, ["text"]).mapInArrow(compare, schema), "proved")


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct pairs ``u, v`` at one shingle that fit in size and lie in different components ``u_c, v_c``."""
    a, b = (x.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("s", "size", "c")]) for x, p in ((left, "a"), (right, "b")))
    fits = (5 * F.least("a_size", "b_size") >= 4 * F.greatest("a_size", "b_size")) & (F.col("a_c") != F.col("b_c"))
    met, first = a.join(b, on).where(fits), F.col("a_s") > F.col("b_s")
    sides = [F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("s", "c")] + [F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")) for c in ("s", "c")]
    return met.select(*[c.alias(n) for c, n in zip(sides, ("u", "u_c", "v", "v_c"), strict=True)]).select("u", "v", "u_c", "v_c").distinct()


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs of all members of a shingle, dealt by shingle and size: similar sets lie in one band of sizes or in neighbours."""
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(1.25)) + 1e-9)
    near = F.explode(F.array(band - 1, band, band + 1))
    return _pairs(members.withColumn("band", band), members.withColumn("band", near), ["t", "band"])


def close_prints(prints: DataFrame) -> DataFrame:
    """``(u, v)``: each set that fingerprints within 3 bits join to others, and the smallest of them, left out itself.

    A set has a fingerprint for each of its texts, as these also show how often shingles occur.
    """
    held_by = written(prints.select("s", "fp").distinct(), "simhash")
    stars = components(near_edges(written(held_by.select("fp").distinct(), "fingerprints")))
    rooted = held_by.join(stars.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").select("s", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("s").alias("v"))
    return components(rooted.join(least, "root").where("s > v").select(F.col("s").alias("u"), "v"))


def similar_sets(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """``(u, v)``: each set that a chain of close fingerprints or similar sets joins to others, and the smallest of them, left out itself.

    Each turn pairs the members of a shingle with a drawn one; what got connected is one component
    from then on, and shingles whose members are all connected are done. From the second turn on
    shingles with few members, and at last all that are left, are compared in all pairs that are
    still apart.
    """
    tokens = prints.select("s", "size", F.explode("prefix").alias("t"))
    met = tokens.groupBy("t").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo != hi").select("t")
    stars = close_prints(prints)
    met = tokens.join(met, "t").select("t", "s", "size").distinct().join(stars.withColumnsRenamed({"u": "s", "v": "c"}), "s", "left")
    open_ = written(met.select("t", "s", "size", F.coalesce("c", "s").alias("c")), "shared")
    # one text a set
    one = prints.join(open_.select("s").distinct(), "s", "left_semi").groupBy("s", "size", "bits")
    one = one.agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("one")).select("s", "size", "bits", F.col("one.k").alias("one_k"), F.col("one.h").alias("one_h"))
    bitmaps = written(one, "bitmaps")
    chosen = texts.join(bitmaps.select("s", "one_k", "one_h"), (F.col("h") == F.col("one_h")) & F.col("k").eqNullSafe(F.col("one_k")))
    bodies = written(chosen.select("s", "text").dropDuplicates(["s"]), "bodies")
    for turn in range(DRAWS + 1):
        drawn = F.min_by(F.struct("s", "size", "c"), F.xxhash64("s", F.lit(turn))).alias("drawn")
        mixed = open_.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), drawn).where("lo != hi")
        all_now = F.lit(True) if turn == DRAWS else (F.col("n") <= CROWD) & F.lit(turn > 0)
        mixed = written(mixed.select("t", "drawn", all_now.alias("all_now")), "mixed")
        if mixed.isEmpty():
            break
        before, open_ = open_, written(open_.join(mixed.select("t", "all_now"), "t"), "open")
        discard(before)
        pairs = _pairs(open_.where("not all_now"), mixed.where("not all_now").select("t", "drawn.*"), ["t"])
        if turn:
            pairs = pairs.unionByName(_all_pairs(open_.where("all_now"))).distinct()
        found = _proved(pairs, bitmaps, bodies)
        joined = components(found.select(F.greatest("u_c", "v_c").alias("u"), F.least("u_c", "v_c").alias("v")))
        moved = joined.select(F.col("u").alias("c"), F.col("v").alias("to"))
        earlier = stars.join(moved, stars["v"] == moved["c"], "left").select("u", F.coalesce("to", "v").alias("v"))
        stars = written(earlier.unionByName(joined), "stars")
        renamed = open_.where("not all_now").drop("all_now").join(moved, "c", "left")
        before, open_ = open_, written(renamed.select("t", "s", "size", F.coalesce("to", "c").alias("c")), "open")
        discard(before)
    discard(bodies)
    return stars


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group that close fingerprints or similar texts connect: that of the smallest key.

    Null and blank texts are copies of each other. Rows with that key in one group are told apart
    by a hash of their text; of fully repeated rows one stays. Null keys count as larger than all.
    Columns of ``docs`` must not begin with ``_near``.
    """
    hashed = F.xxhash64(F.col(text))
    texts = docs.select(F.col(key).alias("k"), hashed.alias("h"), F.col(text).alias("text"))
    prints = written(_prefixes(texts, docs.schema[key].dataType), "prefixes")
    stars = similar_sets(prints, texts)
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("first")
    least = prints.groupBy("s").agg(first).join(stars.select(F.col("u").alias("s"), "v"), "s", "left")
    kept = least.groupBy(F.coalesce("v", "s")).agg(F.min("first").alias("first")).select(F.col("first.k").alias("_near_key"), F.col("first.h").alias("_near_kept"))
    marked = docs.withColumn("_near_text", hashed)
    on = marked[key].eqNullSafe(kept["_near_key"]) & (marked["_near_text"] == kept["_near_kept"])
    return marked.join(kept, on, "left_semi").dropDuplicates([key, "_near_text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
