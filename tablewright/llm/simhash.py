"""Near-duplicates by SimHash: exact neighbours of fingerprints from vantage-point trees.

Fingerprints that differ in ``radius`` bits or fewer differ in ``radius // 2`` bits or fewer in
one of their halves. So each half gets a vantage-point tree in the Hamming distance of that half.
A tree's inner node holds a vantage fingerprint and a distance; what is no farther goes one way,
the rest the other. Its leaves are the shards: a fingerprint lives in one, and is also sent to
those that its ball of radius // 2 bits overlaps by the triangle bound. There all pairs are
compared in full, which makes the result exact whatever the tree looks like: the sample that the
tree is fitted on only decides how even the shards are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.components import components
from tablewright.llm.store import written

RADIUS = 3
SHINGLE = 3
LEAF = 1024  # fingerprints of a shard, on average
MOST_LEVELS = 14
PER_LEAF = 16  # sampled fingerprints a leaf: 2 MB on the driver at most
BLOCK_MEMBERS, BLOCK_QUERIES = 8192, 131072


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The 64-bit SimHash of a text's word shingles as a signed long; 0 without words.

    A-Z are lowered, words end at ASCII white space, shingles count as often as they occur, and a
    text of fewer words is one shingle. A bit is set if it is set in over half of the hashes.
    Null counts as an empty text.
    """

    @F.pandas_udf(T.LongType())
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return hashed(text)


def simhash(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


@dataclass
class HalfTree:
    """A complete binary tree in heap order over one half of the bits."""

    shift: int
    levels: int
    vantage: np.ndarray
    within: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, shift: int, levels: int) -> HalfTree:
        halves = half(sample, shift)
        vantage, within = np.zeros((1 << levels) - 1, np.uint32), np.zeros((1 << levels) - 1, np.int16)
        parts = {0: halves}
        for node in range((1 << levels) - 1):
            mine = parts.pop(node, halves[:0])
            if len(mine):
                # of a few candidates the one whose distances spread most
                tries = mine[np.linspace(0, len(mine) - 1, min(len(mine), 8)).astype(int)]
                point = max(tries, key=lambda p: np.bitwise_count(mine ^ p).var())
                far = np.bitwise_count(mine ^ point).astype(np.int16)
                vantage[node] = point
                cuts = np.unique(far)
                within[node] = min(cuts, key=lambda c: abs(2 * int((far <= c).sum()) - len(mine)))
                parts[2 * node + 1], parts[2 * node + 2] = mine[far <= within[node]], mine[far > within[node]]
        return cls(shift, levels, vantage, within)

    def route(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves that the balls around the fingerprints overlap."""
        halves, rows = half(prints, self.shift), np.arange(len(prints))
        nodes = np.zeros(len(prints), np.int64)
        for _ in range(self.levels):
            far = np.bitwise_count(halves[rows] ^ self.vantage[nodes]).astype(np.int16)
            near, away = far - radius <= self.within[nodes], far + radius > self.within[nodes]
            rows, nodes = np.concatenate([rows[near], rows[away]]), np.concatenate([2 * nodes[near] + 1, 2 * nodes[away] + 2])
        return rows, nodes - ((1 << self.levels) - 1)


def half(prints: np.ndarray, shift: int) -> np.ndarray:
    return (prints.view(np.uint64) >> np.uint64(shift)).astype(np.uint32)


def placements(trees: list[HalfTree], prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each tree: its number, rows, leaves, and whether the leaf is the row's home.

    A pair in two leaves meets twice by symmetry, so rows go only to leaves from their home on.
    """
    for number, tree in enumerate(trees):
        home = np.empty(len(prints), np.int64)
        rows, leaves = tree.route(prints, 0)
        home[rows] = leaves
        rows, leaves = tree.route(prints, radius // 2)
        kept = leaves >= home[rows]
        rows, leaves = rows[kept], leaves[kept]
        yield number, rows, leaves, leaves == home[rows]


def spanning(members: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (larger, smaller) that connect what any pairs of members and queries connect.

    One edge a query and one a member at most, however dense they are.
    """
    root = np.arange(len(members))
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    step = max(1, (1 << 21) // max(1, len(members)))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        close = np.bitwise_count(some[:, None] ^ members[None, :]) <= radius
        q, m = np.nonzero(close)
        if not len(q):
            continue
        first = np.full(len(some), -1)
        first[q[::-1]] = m[::-1]
        found = np.flatnonzero(first >= 0)
        edges += zip(some[found].tolist(), members[first[found]].tolist(), strict=True)
        while (root[root] != root).any():
            root[:] = root[root]
        apart = root[m] != root[first[q]]
        for a, b in {(int(x), int(y)) for x, y in zip(m[apart], first[q[apart]], strict=True)}:
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                edges.append((int(members[a]), int(members[b])))
    return [(max(a, b), min(a, b)) for a, b in edges if a != b]


def near_edges(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Edges ``u > v`` (signed longs) that connect the distinct values of ``fp`` as all close pairs do.

    The tree depth follows the number of fingerprints up to ``MOST_LEVELS``; a shard that is
    larger than a block is cut into blocks of members and of queries, so no task holds a shard
    that grows with the data.
    """
    spark, total = prints.sparkSession, prints.count()
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(1, total) / leaf)))))
    # by hash, so that each task sends its share only; fingerprints are distinct, so the share holds
    share = min(1.0, (PER_LEAF << levels) / max(1, total))
    sample = prints.where(F.xxhash64("fp") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    points = np.array([r.fp for r in sample.collect()], dtype=np.int64).view(np.uint64)
    trees = [HalfTree.fit(points, shift, levels) for shift in (0, 32)]
    sizes_schema = "tree int, leaf int, members long, queries long"

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (2, 1 << levels)
        members, queries = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, _, leaves, home in placements(trees, values, radius):
                queries[number] += np.bincount(leaves, minlength=shape[1])
                members[number] += np.bincount(leaves[home], minlength=shape[1])
        tree, at = np.nonzero(queries)
        columns = (tree.astype(np.int32), at.astype(np.int32), members[tree, at], queries[tree, at])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "leaf", "members", "queries"])

    counted = prints.mapInArrow(sizes, sizes_schema).groupBy("tree", "leaf").agg(F.sum("members").alias("m"), F.sum("queries").alias("q"))
    blocks = np.ones((2, 2, 1 << levels), np.int64)  # members, queries; bounded by the number of leaves
    for tree, at, m, q in counted.collect():
        blocks[0, tree, at], blocks[1, tree, at] = max(1, -(-m // BLOCK_MEMBERS)), max(1, -(-q // BLOCK_QUERIES))
    dealt_schema = "tree int, leaf int, mblock int, qblock int, member boolean, fp long"
    names = ["tree", "leaf", "mblock", "qblock", "member", "fp"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(begin, 4096).to_numpy(zero_copy_only=False)
                salt = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for number, rows, leaves, home in placements(trees, values.view(np.uint64), radius):
                    for member in (True, False):
                        r, at = (rows[home], leaves[home]) if member else (rows, leaves)
                        mine, other = blocks[0 if member else 1, number, at], blocks[1 if member else 0, number, at]
                        own = (salt[r] % mine.astype(np.uint64)).astype(np.int32)
                        again = np.repeat(np.arange(len(r)), other)
                        turn = (np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)).astype(np.int32)
                        mb, qb = (own[again], turn) if member else (turn, own[again])
                        columns = (np.full(len(again), number, np.int32), at[again].astype(np.int32), mb, qb, np.full(len(again), member), values[r[again]])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def linked(shard: pa.Table) -> pa.Table:
        values, member = shard.column("fp").to_numpy().view(np.uint64), shard.column("member").to_numpy(zero_copy_only=False).astype(bool)
        found = spanning(values[member], values[~member], radius)
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": pairs.max(axis=1), "v": pairs.min(axis=1)})

    rows = prints.mapInArrow(dealt, dealt_schema)
    return rows.groupBy("tree", "leaf", "mblock", "qblock").applyInArrow(linked, "u long, v long").distinct()


def near_groups(prints: DataFrame, key: str, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """``prints`` (a stored table with ``fp``), ``component_id``, the smallest ``key`` reachable, and ``_near_root``, its smallest fingerprint.

    Copies are folded to one fingerprint first. Null keys count as larger than all; a component
    of null keys has a null id. Repeated rows stay as they are.
    """
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("_near_least")), "prints")
    stars = components(near_edges(distinct.select("fp"), radius, leaf))
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("_near_root")), "fp", "left")
    rooted = rooted.withColumn("_near_root", F.coalesce("_near_root", "fp"))
    least = rooted.groupBy("_near_root").agg(F.min("_near_least").alias("component_id"))
    return prints.join(rooted.join(least, "_near_root").select("fp", "_near_root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: the key, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and blank texts have fingerprint zero and are linked like any other; repeated rows stay,
    other columns are ignored, and an empty table gives no rows.
    """
    prints = written(docs.select(key, fingerprint(F.col(text)).alias("fp")), "simhash")
    return near_groups(prints, key, radius).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest key.

    Rows with that key in one component are told apart by a hash of their text; of fully repeated
    rows one stays. Columns of ``docs`` must not begin with ``_near``.
    """
    hashed = F.xxhash64(F.col(text))
    prints = written(docs.select(F.col(key).alias("_near_key"), hashed.alias("_near_text"), fingerprint(F.col(text)).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("_near_key").isNull().alias("none"), "_near_key", "_near_text")).alias("first")
    kept = near_groups(prints, "_near_key", radius).groupBy("_near_root").agg(first).select("first._near_key", "first._near_text")
    marked = docs.withColumn("_near_text", hashed)
    on = marked[key].eqNullSafe(kept["_near_key"]) & (marked["_near_text"] == kept["_near_text"])
    return marked.join(kept, on, "left_semi").dropDuplicates([key, "_near_text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
