"""Exact nearest neighbours from k-d trees over all features.

Donors with the same features filled share a tree, fitted on a bounded sample; its leaves are
boxes, and boxes that hold too many donors are cut into chunks, so a block never exceeds a fixed
size. A query meets boxes best first, in three rounds: the nearest box, which bounds the distance
of its k-th neighbour, then a few more, which tighten the bound, then all boxes that the bound
still reaches. A block returns at most k donors per query, and the best k of all blocks win. Inside a
block the donors lie in the small leaves of a tree of their own, which a query visits likewise.

Copies cannot inflate a block: of donors with the same features only the first k by key can
ever be chosen, and queries with the same features are answered once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.aggregates import col, columns_of, measure
from tablewright.plans.orderstats import numeric
from tablewright.session import cut_lineage

BLOCK_DONORS = 32_000
BLOCK_QUERIES = 16_000
LEAF_DONORS = 64  # of the tree inside a block
SLAB_CELLS = 1_000_000  # distances held at once inside a block
SAMPLE_ROWS = 65_536  # donors that the trees are fitted on; every donor is placed
MOST_BOXES = 4096  # boxes that tasks and the driver hold; beyond that boxes grow and are cut into chunks
NEXT_BOXES = 4  # boxes of the second round
OTHERS = -1  # the box of donors whose filled features the sample doesn't show; always visited


def _pair_distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Distances of query rows to donor rows, row by row; features missing on either side are left out."""
    shape = np.broadcast_shapes(q.shape, d.shape)
    total, shared = np.zeros(shape[:-1]), np.zeros(shape[:-1])
    for j in range(shape[-1]):
        gap = q[..., j] - d[..., j]
        both = ~np.isnan(gap)
        gap = np.where(both, gap, 0.0)
        shared += both
        total += np.abs(gap) if metric == "manhattan" else gap * gap
    return _rooted(total, shared, metric)


def _distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all query rows to all donor rows."""
    return _pair_distances(q[:, None], d[None], metric)


def _rooted(total: np.ndarray, shared: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return total
    if metric == "euclidean":
        return np.sqrt(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total / shared), np.inf)


def _first(row: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by row, then keys, and the place of each entry among those of its row."""
    order = np.lexsort((*keys[::-1], row))
    sorted_ = row[order]
    return order, np.arange(len(row)) - np.searchsorted(sorted_, sorted_)


_EMPTY = pd.DataFrame(
    {
        "qid": pd.Series(dtype=object),
        "distance": pd.Series(dtype=float),
        "tie": pd.Series(dtype="int64"),
        "y": pd.Series(dtype=float),
    }
)


class Leaves:
    """The donors of a block in the leaves of a k-d tree, so that a query meets a few leaves and not the block."""

    def __init__(self, donors: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        place = Trees(donors, max(1, len(donors) // max(LEAF_DONORS, 4 * k))).place(donors)
        self.order = np.argsort(place, kind="stable")
        self.rows = donors[self.order]
        self.start = np.flatnonzero(np.diff(place[self.order], prepend=-2))
        self.size = np.diff(self.start, append=len(donors))
        self.low, self.high = (end.reduceat(self.rows, self.start, axis=0) for end in (np.fmin, np.fmax))

    def _meet(self, q: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, donor and distance of all pairs of a query and a donor of a leaf."""
        n = self.size[leaf]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[leaf], n)
        row = np.repeat(row, n)
        return row, self.order[at], _pair_distances(q[row], self.rows[at], self.metric)

    def nearest(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, donor and distance of the k nearest donors within the bound of each query; equal ones in donor order.

        The nearest leaf bounds the k-th distance; then all leaves that it still reaches are met.
        """
        reach = _box_bounds(q, self.low, self.high, self.metric)
        own, every = reach.argmin(axis=1), np.arange(len(q))
        row, donor, gap = self._meet(q, every, own)
        order, place = _first(row, gap)
        limit = bound.copy()
        kth = order[place == self.k - 1]
        limit[row[kth]] = np.minimum(limit[row[kth]], gap[kth])
        near = reach <= limit[:, None] * (1 + 1e-9)
        near[every, own] = False
        rows, leaves = np.nonzero(near)
        keep = gap <= limit[row]
        parts = [(row[keep], donor[keep], gap[keep])]
        cells = np.cumsum(self.size[leaves]) // SLAB_CELLS
        for slab in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(cells)) + 1):
            row, donor, gap = self._meet(q, rows[slab], leaves[slab])
            keep = gap <= limit[row]
            parts.append((row[keep], donor[keep], gap[keep]))
        row, donor, gap = (np.concatenate(p) for p in zip(*parts, strict=True))
        order, place = _first(row, gap, donor)
        order = order[place < self.k]
        return row[order], donor[order], gap[order]


def _block_search(width: int, k: int, metric: str):
    """The best k donors of one block for each of its queries, in bounded numpy slabs."""
    features = [f"f{j}" for j in range(width)]

    def search(donors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [_EMPTY]
        if len(donors) and len(queries):
            donors = donors.sort_values("tie", kind="stable")
            leaves = Leaves(donors[features].to_numpy(dtype=float), k, metric)
            tie, y = donors["tie"].to_numpy(), donors["y"].to_numpy(dtype=float)
            q, qid = queries[features].to_numpy(dtype=float), queries["qid"].to_numpy()
            bound = queries["bound"].fillna(np.inf).to_numpy(dtype=float) * (1 + 1e-9)
            slab = max(1, SLAB_CELLS // max(len(leaves.start), int(leaves.size.max())))
            for at in range(0, len(q), slab):
                row, donor, gap = leaves.nearest(q[at : at + slab], bound[at : at + slab])
                if len(row):
                    parts.append(pd.DataFrame({"qid": qid[at + row], "distance": gap, "tie": tie[donor], "y": y[donor]}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    return search


def _search_blocks(donors: DataFrame, queries: DataFrame, width: int, k: int, metric: str) -> DataFrame:
    on = ["range", "chunk", "qchunk"]
    return (
        donors.groupBy(*on)
        .cogroup(queries.groupBy(*on))
        .applyInPandas(_block_search(width, k, metric), "qid string, distance double, tie long, y double")
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "tie")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _spread(placed: DataFrame, chunks: dict[int, int], column: str, name: str) -> DataFrame:
    """Add a chunk number from a hash of ``column``; ``chunks`` gives the count per range."""
    parts = _lookup(chunks)
    return placed.withColumn(name, F.pmod(F.xxhash64(column), parts).cast("int"))


def _lookup(chunks: dict[int, int]) -> Column:
    """Chunk count of a row's range; one everywhere except in the crowded ranges."""
    crowded = {r: c for r, c in chunks.items() if c > 1}
    if not crowded:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in crowded.items() for x in pair])
    return F.coalesce(table[F.col("range")], F.lit(1))


def _chunk_counts(placed: DataFrame, size: int) -> dict[int, int]:
    # One row per box, so at most MOST_BOXES + 1 rows.
    rows = placed.groupBy("range").agg(F.count("*").alias("n")).collect()
    return {r["range"]: max(1, -(-r["n"] // size)) for r in rows}


class Trees:
    """k-d trees by the features that are filled; a box is a leaf of one of them."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.nodes: list[tuple] = []  # (feature, border, left, right), or (box,)
        self.roots: dict[bytes, int] = {}
        self.boxes = 0
        if not sample.size:
            return
        filled = ~np.isnan(sample)
        patterns, of, sizes = np.unique(filled, axis=0, return_inverse=True, return_counts=True)
        for p, pattern in enumerate(patterns):
            share = max(1, boxes * int(sizes[p]) // max(1, len(sample)))
            self.roots[pattern.tobytes()] = self._grow(sample[of.ravel() == p], np.flatnonzero(pattern), share)

    def _grow(self, rows: np.ndarray, features: np.ndarray, boxes: int) -> int:
        """A tree of at most ``boxes`` leaves, halved at the median of the feature that spreads most."""
        at = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(rows[:, features], axis=0) if boxes > 1 and len(features) and len(rows) > 1 else np.zeros(1)
        j = features[int(spread.argmax())] if spread.max() > 0 else -1
        border = self._border(rows[:, j]) if j >= 0 else None
        if border is None:
            self.nodes[at] = (self.boxes,)
            self.boxes += 1
            return at
        low = rows[:, j] <= border
        left = self._grow(rows[low], features, boxes // 2)
        self.nodes[at] = (j, border, left, self._grow(rows[~low], features, boxes - boxes // 2))
        return at

    @staticmethod
    def _border(values: np.ndarray) -> float:
        """A value near the median with rows on both sides."""
        middle = float(np.partition(values, len(values) // 2)[len(values) // 2])
        below = values[values < middle]
        return middle if middle < values.max() and (values <= middle).sum() <= 0.75 * len(values) or not len(below) else float(below.max())

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The box of each row."""
        out = np.full(len(rows), OTHERS, np.int32)
        if not self.roots:
            return out
        filled = ~np.isnan(rows)
        patterns, of = np.unique(filled, axis=0, return_inverse=True)
        for p, pattern in enumerate(patterns):
            root = self.roots.get(pattern.tobytes())
            open_ = [] if root is None else [(root, np.flatnonzero(of.ravel() == p))]
            while open_:
                node, mine = open_.pop()
                if len(self.nodes[node]) == 1:
                    out[mine] = self.nodes[node][0]
                elif len(mine):
                    j, border, left, right = self.nodes[node]
                    low = rows[mine, j] <= border
                    open_ += [(left, mine[low]), (right, mine[~low])]
        return out


def _box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """No donor of a box is nearer to a query than this; boxes are NaN in features their donors lack."""
    total = np.zeros((len(q), len(low)))
    shared = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        x = q[:, j][:, None]
        gap = np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0.0)
        both = ~np.isnan(gap)
        gap = np.where(both, gap, 0.0)
        shared += both
        total += gap if metric == "manhattan" else gap * gap
    return _rooted(total, shared, metric)


def nearest(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, donor and distance of the k nearest donors within the bound of each query; equal ones in donor order.

        The nearest leaf bounds the k-th distance; then all leaves that it still reaches are met.
        """
        reach = _box_bounds(q, self.low, self.high, self.metric)
        own, every = reach.argmin(axis=1), np.arange(len(q))
        row, donor, gap = self._meet(q, every, own)
        order, place = _first(row, gap)
        limit = bound.copy()
        kth = order[place == self.k - 1]
        limit[row[kth]] = np.minimum(limit[row[kth]], gap[kth])
        near = reach <= limit[:, None] * (1 + 1e-9)
        near[every, own] = False
        rows, leaves = np.nonzero(near)
        keep = gap <= limit[row]
        parts = [(row[keep], donor[keep], gap[keep])]
        cells = np.cumsum(self.size[leaves]) // SLAB_CELLS
        for slab in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(cells)) + 1):
            row, donor, gap = self._meet(q, rows[slab], leaves[slab])
            keep = gap <= limit[row]
            parts.append((row[keep], donor[keep], gap[keep]))
        row, donor, gap = (np.concatenate(p) for p in zip(*parts, strict=True))
        order, place = _first(row, gap, donor)
        order = order[place < self.k]
        return row[order], donor[order], gap[order]


def _block_search(width: int, k: int, metric: str):
    """The best k donors of one block for each of its queries, in bounded numpy slabs."""
    features = [f"f{j}" for j in range(width)]

    def search(donors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [_EMPTY]
        if len(donors) and len(queries):
            donors = donors.sort_values("tie", kind="stable")
            leaves = Leaves(donors[features].to_numpy(dtype=float), k, metric)
            tie, y = donors["tie"].to_numpy(), donors["y"].to_numpy(dtype=float)
            q, qid = queries[features].to_numpy(dtype=float), queries["qid"].to_numpy()
            bound = queries["bound"].fillna(np.inf).to_numpy(dtype=float) * (1 + 1e-9)
            slab = max(1, SLAB_CELLS // max(len(leaves.start), int(leaves.size.max())))
            for at in range(0, len(q), slab):
                row, donor, gap = leaves.nearest(q[at : at + slab], bound[at : at + slab])
                if len(row):
                    parts.append(pd.DataFrame({"qid": qid[at + row], "distance": gap, "tie": tie[donor], "y": y[donor]}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    return search


def _search_blocks(donors: DataFrame, queries: DataFrame, width: int, k: int, metric: str) -> DataFrame:
    on = ["range", "chunk", "qchunk"]
    return (
        donors.groupBy(*on)
        .cogroup(queries.groupBy(*on))
        .applyInPandas(_block_search(width, k, metric), "qid string, distance double, tie long, y double")
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "tie")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _spread(placed: DataFrame, chunks: dict[int, int], column: str, name: str) -> DataFrame:
    """Add a chunk number from a hash of ``column``; ``chunks`` gives the count per range."""
    parts = _lookup(chunks)
    return placed.withColumn(name, F.pmod(F.xxhash64(column), parts).cast("int"))


def _lookup(chunks: dict[int, int]) -> Column:
    """Chunk count of a row's range; one everywhere except in the crowded ranges."""
    crowded = {r: c for r, c in chunks.items() if c > 1}
    if not crowded:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in crowded.items() for x in pair])
    return F.coalesce(table[F.col("range")], F.lit(1))


def _chunk_counts(placed: DataFrame, size: int) -> dict[int, int]:
    # One row per box, so at most MOST_BOXES + 1 rows.
    rows = placed.groupBy("range").agg(F.count("*").alias("n")).collect()
    return {r["range"]: max(1, -(-r["n"] // size)) for r in rows}


class Trees:
    """k-d trees by the features that are filled; a box is a leaf of one of them."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.nodes: list[tuple] = []  # (feature, border, left, right), or (box,)
        self.roots: dict[bytes, int] = {}
        self.boxes = 0
        if not sample.size:
            return
        filled = ~np.isnan(sample)
        patterns, of, sizes = np.unique(filled, axis=0, return_inverse=True, return_counts=True)
        for p, pattern in enumerate(patterns):
            share = max(1, boxes * int(sizes[p]) // max(1, len(sample)))
            self.roots[pattern.tobytes()] = self._grow(sample[of.ravel() == p], np.flatnonzero(pattern), share)

    def _grow(self, rows: np.ndarray, features: np.ndarray, boxes: int) -> int:
        """A tree of at most ``boxes`` leaves, halved at the median of the feature that spreads most."""
        at = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(rows[:, features], axis=0) if boxes > 1 and len(features) and len(rows) > 1 else np.zeros(1)
        j = features[int(spread.argmax())] if spread.max() > 0 else -1
        border = self._border(rows[:, j]) if j >= 0 else None
        if border is None:
            self.nodes[at] = (self.boxes,)
            self.boxes += 1
            return at
        low = rows[:, j] <= border
        left = self._grow(rows[low], features, boxes // 2)
        self.nodes[at] = (j, border, left, self._grow(rows[~low], features, boxes - boxes // 2))
        return at

    @staticmethod
    def _border(values: np.ndarray) -> float:
        """A value near the median with rows on both sides."""
        middle = float(np.partition(values, len(values) // 2)[len(values) // 2])
        below = values[values < middle]
        return middle if middle < values.max() and (values <= middle).sum() <= 0.75 * len(values) or not len(below) else float(below.max())

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The box of each row."""
        out = np.full(len(rows), OTHERS, np.int32)
        if not self.roots:
            return out
        filled = ~np.isnan(rows)
        patterns, of = np.unique(filled, axis=0, return_inverse=True)
        for p, pattern in enumerate(patterns):
            root = self.roots.get(pattern.tobytes())
            open_ = [] if root is None else [(root, np.flatnonzero(of.ravel() == p))]
            while open_:
                node, mine = open_.pop()
                if len(self.nodes[node]) == 1:
                    out[mine] = self.nodes[node][0]
                elif len(mine):
                    j, border, left, right = self.nodes[node]
                    low = rows[mine, j] <= border
                    open_ += [(left, mine[low]), (right, mine[~low])]
        return out


def _box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """No donor of a box is nearer to a query than this; boxes are NaN in features their donors lack."""
    total = np.zeros((len(q), len(low)))
    shared = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        x = q[:, j][:, None]
        gap = np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0.0)
        both = ~np.isnan(gap)
        gap = np.where(both, gap, 0.0)
        shared += both
        total += gap if metric == "manhattan" else gap * gap
    if metric == "manhattan":
        return total
    if metric == "euclidean":
        return np.sqrt(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total / shared), np.inf)


def nearest(
    queries: DataFrame, donors: DataFrame, width: int, k: int, metric: str = "shared", report: list[dict] | None = None
) -> DataFrame:
    """``(qid, distance, tie, y, place)``: the k nearest donors of each query, exactly.

    ``queries`` holds a unique string ``qid`` and ``f0..``; ``donors`` holds ``f0..``, a long
    ``tie`` that orders equal distances, and ``y``. Metric ``shared`` is the root mean square
    over the features both sides have; ``euclidean`` and ``manhattan`` expect complete rows.
    ``report``, if given, gets the queries, donors and visited pairs of each round, which takes a
    pass over the visits.
    """
    features = [f"f{j}" for j in range(width)]
    same = Window.partitionBy(*features).orderBy("tie")
    doubles = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features]
    donors = donors.select(*doubles, "tie", F.col("y").cast("double").alias("y"))
    donors = donors.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k).drop("_nth")
    donors = cut_lineage(donors)  # read by every step below
    total = donors.count()
    wanted = min(MOST_BOXES, -(-total // BLOCK_DONORS))
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    drawn = donors.where(F.xxhash64("tie", *features) <= min(2**63 - 1, int(share * 2**64) - 2**63)) if wanted > 1 else donors.limit(1)
    rows = drawn.select(*features).collect() if features else []
    sample = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), width)
    trees = Trees(sample, wanted)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(f).to_numpy(zero_copy_only=False) for f in features]
        return np.stack(columns, axis=1).astype(float) if columns else np.zeros((batch.num_rows, 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = pa.array(trees.place(matrix(batch)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, box], names=[*batch.schema.names, "range"])

    columns = ", ".join(f"{f} double" for f in features) + (", " if features else "")
    donors = cut_lineage(donors.mapInArrow(placed, columns + "tie long, y double, range int"))
    edges = [F.min(f).alias(f"low_{f}") for f in features] + [F.max(f).alias(f"high_{f}") for f in features]
    held = donors.groupBy("range").agg(F.count("*").alias("n"), *edges).collect()  # at most MOST_BOXES + 1 rows
    held = sorted(held, key=lambda r: (r["range"] == OTHERS, r["range"]))
    chunks = {r["range"]: max(1, -(-r["n"] // BLOCK_DONORS)) for r in held} or {0: 1}
    numbers = np.array(list(chunks), np.int32)

    def edge(row, name: str, open_: float) -> list[float]:
        if row["range"] == OTHERS:
            return [open_] * width
        return [np.nan if row[f"{name}_{f}"] is None else row[f"{name}_{f}"] for f in features]

    low = np.array([edge(r, "low", -np.inf) for r in held], float).reshape(len(held), width) if held else np.full((1, width), np.nan)
    high = np.array([edge(r, "high", np.inf) for r in held], float).reshape(len(held), width) if held else np.full((1, width), np.nan)
    donors = _spread(donors, chunks, "tie", "chunk")

    def visits(asked: DataFrame, begin: int, end: int | None) -> DataFrame:
        """``(qid, f.., bound, range)``: the boxes from the ``begin``-th nearest on that a query's ``bound`` reaches."""

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    reach = _box_bounds(matrix(some), low, high, metric)
                    if OTHERS in chunks:  # any distance is possible there; the last box, so that others go first
                        reach[:, -1] = 0.0
                    bound = some.column("bound").to_numpy(zero_copy_only=False).astype(float)
                    wanted_ = reach <= np.where(np.isnan(bound), np.inf, bound)[:, None] * (1 + 1e-9)
                    left, every = np.minimum(reach, np.finfo(float).max), np.arange(len(reach))
                    taken = np.zeros(reach.shape, bool)
                    for turn in range(min(begin if end is None else end, len(numbers))):
                        best = left.argmin(axis=1)
                        taken[every, best] = end is None or turn >= begin
                        left[every, best] = np.inf
                    row, column = np.nonzero(wanted_ & (~taken if end is None else taken))
                    boxes = pa.array(numbers[column], pa.int32())
                    kept = some.select(["qid", *features, "bound"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*kept.columns, boxes], names=["qid", *features, "bound", "range"])

        return asked.select("qid", *features, "bound").mapInArrow(reached, "qid string, " + columns + "bound double, range int")

    def run(visited: DataFrame) -> DataFrame:
        """Search the blocks of visits, repeating donors per query chunk."""
        visited = cut_lineage(visited.withColumn("chunk", F.explode(F.sequence(F.lit(0), _lookup(chunks) - 1))))
        qchunks = _chunk_counts(visited, BLOCK_QUERIES)
        if report is not None:
            sizes = donors.groupBy("range", "chunk").agg(F.count("*").alias("n"))
            seen = visited.join(sizes, ["range", "chunk"]).agg(F.sum("n").alias("n")).first()["n"] or 0
            report.append({"queries": visited.select("qid").distinct().count(), "donors": total, "pairs": seen})
        asked = _spread(visited, qchunks, "qid", "qchunk")
        copies = donors.withColumn("qchunk", F.explode(F.sequence(F.lit(0), _lookup(qchunks) - 1)))
        return _search_blocks(copies, asked, width, k, metric)

    def bounded(found: DataFrame) -> DataFrame:
        least = _top(found, k).groupBy("qid").agg(F.max("distance").alias("bound"), F.count("*").alias("met"))
        least = least.where((F.col("met") >= k) & (F.col("bound") < math.inf)).select("qid", "bound")
        return queries.join(least, "qid", "left")

    queries = queries.select("qid", *doubles)
    first = run(visits(queries.withColumn("bound", F.lit(None).cast("double")), 0, 1))
    if len(chunks) == 1:
        return _top(first, k)
    # Read twice below and costly to search again.
    first = cut_lineage(first)
    second = cut_lineage(run(visits(bounded(first), 1, 1 + NEXT_BOXES)))
    some = first.unionByName(second)
    return _top(some.unionByName(run(visits(bounded(some), 1 + NEXT_BOXES, None))), k)


def _features(df: DataFrame, names: list[str]) -> dict[str, Column]:
    return {f"f{j}": numeric(n) for j, n in enumerate(names)}


def knn_fill(
    df: DataFrame, target: str, k: int, key: str | None = None, features: list[str] | None = None
) -> DataFrame:
    """Null cells of ``target`` become the inverse-distance mean of the k nearest rows.

    Distances use the other numeric columns, unscaled. Equal distances are taken in key order
    (a row hash without a key). A cell without usable neighbours gets the column mean, or 0.
    The column becomes double.
    """
    names = features or [n for n in columns_of(df, "numeric") if n != target]
    tie = col(key).cast("long") if key else F.xxhash64(*map(col, df.columns))
    cells = _features(df, names)
    vector = list(cells)
    odd = F.isnan(col(target).cast("double"))
    present = df.where(col(target).isNotNull() & ~odd)  # the null test reaches the scan
    absent = df.where(col(target).isNull() | odd)
    stats = measure(df, {"mean": F.avg(numeric(target)), "nulls": F.count(F.when(numeric(target).isNull(), 1))})
    mean = stats["mean"] if stats["mean"] is not None else 0.0
    whole = present.withColumn(target, numeric(target))
    if not stats["nulls"]:
        return whole
    donors = present.select(*[c.alias(a) for a, c in cells.items()], tie.alias("tie"), numeric(target).alias("y"))
    # The text of the feature vector identifies a distinct query exactly.
    qid = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells.values()]) if cells else F.lit("")
    asked = absent.withColumn("_qid", qid)
    queries = asked.select(F.col("_qid").alias("qid"), *[c.alias(a) for a, c in cells.items()]).dropDuplicates(["qid"])
    found = nearest(queries, donors, len(vector), k)
    weight = F.when(F.col("distance") < 1e-10, F.lit(1e10)).otherwise(1.0 / F.col("distance"))
    guesses = found.groupBy(F.col("qid").alias("_qid")).agg(
        F.sum(F.col("y") * weight).alias("_wy"), F.sum(weight).alias("_w")
    )
    guess = F.when(F.col("_w") > 0, F.col("_wy") / F.col("_w")).otherwise(F.lit(mean))
    filled = asked.join(guesses, "_qid", "left").withColumn(target, F.coalesce(guess, F.lit(mean)))
    return whole.unionByName(filled.select(*map(col, df.columns)))


def knn_predict(
    train: DataFrame,
    rows: DataFrame,
    features: list[str],
    label: str,
    k: int = 5,
    weights: str = "uniform",
    metric: str = "euclidean",
    classify: bool = False,
    key: str | None = None,
) -> DataFrame:
    """Score rows by their k nearest training rows; adds ``prediction``.

    Classes are numeric labels; votes that tie go to the smaller label.
    """
    cells = _features(train, features)
    tie = col(key).cast("long") if key else F.xxhash64(*map(col, train.columns))
    donors = train.select(*[c.alias(a) for a, c in cells.items()], tie.alias("tie"), numeric(label).alias("y"))
    asked = rows.withColumn("_qid", F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells.values()]))
    queries = asked.select(F.col("_qid").alias("qid"), *[c.alias(a) for a, c in cells.items()]).dropDuplicates(["qid"])
    found = nearest(queries, donors, len(features), k, metric)
    if weights == "distance":
        # An exact match outweighs every other neighbour.
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))
        w = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    else:
        w = F.lit(1.0)
    voted = found.withColumn("w", w).select(F.col("qid").alias("_qid"), "y", "w")
    if classify:
        votes = voted.groupBy("_qid", "y").agg(F.sum("w").alias("votes"))
        best = F.min(F.struct((-F.col("votes")).alias("m"), F.col("y")))
        answer = votes.groupBy("_qid").agg(best["y"].alias("prediction"))
    else:
        answer = voted.groupBy("_qid").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("prediction"))
    return asked.join(answer, "_qid", "left").drop("_qid")
