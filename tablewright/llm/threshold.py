"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt to shards. In a shard every dimension has a list of all vectors, sorted by their
component; a query walks each list from its better end (from the top where its own weight is
positive), takes the full product of every vector that it meets, and stops once the bound, the
product with the last component read of every list, can't beat the k-th result. Lists of equal
components are in order of ids, so that a bound equal to the k-th score stops it too where ids
decide.

First a query meets the shard that its own hash names; the k-th score found there is a floor for
all other shards, most of whose lists are then read less far. The best of all shards are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.store import written

SHARD_ROWS, QUERY_ROWS = 8192, 2048
STEP = 16  # entries read of the heaviest list before the second look at the bound; twice as many before each next
EXACT = 1 << 53  # products below are exact as doubles
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Lists:
    """The sorted lists of a shard, whose rows are in order of ids."""

    vectors: np.ndarray  # rows x dimensions
    falling: np.ndarray  # dimension by dimension: rows by falling component, ties by id
    rising: np.ndarray  # the same by rising component

    @classmethod
    def of(cls, vectors: np.ndarray) -> Lists:
        columns = np.ascontiguousarray(vectors.T)
        return cls(vectors, *(np.argsort(sign * columns, axis=1, kind="stable").astype(np.int32) for sign in (-1, 1)))

    def top(self, query: np.ndarray, k: int, own: tuple[int, int], floor: int) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best ``(score, row)`` of at least ``floor``, and how many entries of all lists were read.

        Rows from ``own[0]`` to before ``own[1]`` are the query's own and take no part.
        """
        rows, used = len(self.vectors), np.flatnonzero(query)
        weights = query[used]
        if not len(used):  # all products are zero: ids decide
            some = [r for r in range(min(rows, k + own[1] - own[0])) if not own[0] <= r < own[1]]
            return [(0, r) for r in some[:k]] if floor <= 0 else [], 0
        lists = [(self.falling if w > 0 else self.rising)[d] for d, w in zip(used.tolist(), weights.tolist(), strict=True)]
        share = np.abs(weights) / np.abs(weights).max()  # heavier lists move the bound more and are read faster
        unseen = np.ones(rows, bool)
        unseen[own[0] : own[1]] = False
        best: list[tuple[int, int]] = []
        read, until, step = np.zeros(len(used), np.int64), np.ones(len(used), np.int64), STEP
        while unseen.any():
            met = np.zeros(rows, bool)
            met[np.concatenate([entries[i:j] for entries, i, j in zip(lists, read, until, strict=True)])] = True
            fresh = np.flatnonzero(met & unseen)
            unseen &= ~met
            if len(fresh):
                scores = product(self.vectors[fresh], query)
                keep = scores >= max(floor, -best[-1][0] if len(best) == k else LOWEST)
                best = sorted(best + list(zip((-scores[keep]).tolist(), fresh[keep].tolist(), strict=True)))[:k]
            last = np.array([entries[j - 1] for entries, j in zip(lists, until, strict=True)])
            bound = int(product(self.vectors[last, used][None, :], weights)[0])
            if bound < floor or len(best) == k and bound < -best[-1][0]:
                break
            if len(best) == k and bound == -best[-1][0] < HIGHEST and best[-1][1] <= last.max():
                break
            read, until, step = until, np.minimum(rows, until + np.ceil(step * share).astype(np.int64)), 2 * step
        return [(-s, r) for s, r in best], int(until.sum())


def product(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact; numbers beyond a long stop at its end."""
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).sum())
    if largest < EXACT:
        return (vectors @ query).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(row, query, strict=True)) for row in vectors.tolist()]
    return np.array([min(max(x, LOWEST), HIGHEST) for x in exact], np.int64)


def scaled(vector: Column, factor: int = 256) -> Column:
    """Whole numbers floor(factor * x) as doubles; null for a vector that is null or holds null, NaN or infinity."""
    doubles = F.transform(vector, lambda x: F.floor(factor * x.cast("double")).cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(1 << 52)))
    return F.when(F.coalesce(finite, F.lit(False)), doubles)


def top_products(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """``query_id, rank, <key>, score`` of the ``k`` candidates with the highest inner products.

    ``vector`` holds whole numbers as doubles; rows where it is null take no part, empty vectors
    have products of zero. Ties go to the smaller key, then to nulls. A candidate with the query's
    key is the query's own and left out; a null key is nobody's. Vectors are compared with those of
    the same length. A query that repeats (key and vector) is asked once; candidates that repeat
    are rows of their own. Scores beyond a long stop at its end. Other columns are ignored; an empty
    table gives no rows.
    """
    vectors = candidates.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null").withColumn("width", F.size("v"))
    asked = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null").distinct()
    asked = asked.withColumns({"width": F.size("v"), "query": F.xxhash64("id", "v")})
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    home = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(shards)).cast("int")
    shard = F.pmod(F.xxhash64("id", "v", F.lit(2), F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    block = F.pmod(F.col("query"), F.lit(blocks)).cast("int")
    asked = asked.withColumns({"home": home, "block": block})
    member = vectors.select("width", shard.alias("shard"), "id", "v")
    found_schema = "id long, query long, score long, other long"

    def search(sought: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["id", "query", "score", "other"])
        ids, known = held.column("held_id"), held.column("held_id").is_valid().to_numpy()
        numbers = ids.fill_null(0).to_numpy()
        order = np.lexsort((numbers, ~known))
        numbers, known = numbers[order], known[order]
        width = held.column("to_width")[0].as_py()
        lists = Lists.of(flat(held.column("held_v"), width)[order])
        rows: list[tuple] = []
        wanted = flat(sought.column("v"), width)
        several = zip(sought.column("id").to_pylist(), sought.column("query").to_pylist(), sought.column("floor").to_pylist(), wanted, strict=True)
        for own, query, floor, weights in several:
            all_known = int(known.sum())
            mine = (0, 0) if own is None else tuple(np.searchsorted(numbers[:all_known], [own, own + 1]).tolist())
            best, _ = lists.top(weights, k, mine, LOWEST if floor is None else floor)
            rows += [(own, query, score, int(numbers[r]) if known[r] else None) for score, r in best]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "query", "score", "other"])

    def answers(places: DataFrame) -> DataFrame:
        """``places``: queries with the shard and the floor of each visit."""
        one = ["width", "shard", "block"]
        visited = places.select(*[F.col(c).alias(f"to_{c}") for c in one]).distinct()
        meets = (F.col("width") == F.col("to_width")) & (F.col("shard") == F.col("to_shard"))
        blocked = member.join(visited, meets).select(*[f"to_{c}" for c in one], F.col("id").alias("held_id"), F.col("v").alias("held_v"))
        return places.groupBy(*one).cogroup(blocked.groupBy(*[f"to_{c}" for c in one])).applyInArrow(search, found_schema)

    sought = written(asked, "asked")
    member = written(member, "members")
    at_home = written(answers(sought.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("long"))), "at-home")
    floors = at_home.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    away = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard")
    visits = sought.join(floors, "query", "left").select("id", "v", "width", "query", "block", "floor", away)
    both = at_home.unionByName(answers(visits)) if shards > 1 else at_home
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("other").asc_nulls_last())
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("other").alias(key), "score")


def flat(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
