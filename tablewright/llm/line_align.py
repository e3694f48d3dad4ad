"""Line dedup by pairwise alignment.

Lines are hashed, and the k-th time a line stands in a document it counts as a line of its own.
Two documents are aligned on all their common lines in the manner of patience diff: lines that are
rare in both (they stand once in each, or are as long as a block must be) are brought into the
longest common order, and the matches grow from there over neighbouring lines. Lines of the later
document that align with one earlier document form blocks; blocks of enough words are deleted. What
goes is what the alignments with all earlier documents delete together.

Most of these need not be made. A document first meets the earliest holder of each of its lines, of
each of its shortest runs that are long enough for a block (windows), and of its whole sequence of
lines, so n copies give n - 1 pairs and a hot line one row for each document. A block consists of
windows; where a window of shared lines is not wholly deleted after that, the document also meets
other earlier documents that hold all lines of the window: a few, then more, and at last all. So the work is linear in the lines,
except for windows that many documents hold and no alignment deletes.
Earlier means a smaller key; null keys come last, ties go by a hash of the text. Rows equal in
key and text are one document: they are edited alike and never against each other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.store import written

MIN_WORDS = 8
TO_END = 1 << 30
FIRST_DRAWS, MORE = 4, 8


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(shared: list[tuple[int, int, bool]]) -> set[int]:
    """Lines of the later document that align: ``shared`` has (its line, the earlier's line, rare in both)."""
    shared = sorted(shared)
    anchors = [(b, a) for b, a, rare in shared if rare]
    found = {anchors[i] for i in longest_rising([a for _, a in anchors])}
    rest = {(b, a) for b, a, _ in shared} - found
    for step in (1, -1):
        for b, a in sorted(found, reverse=step < 0):
            while (b + step, a + step) in rest:
                b, a = b + step, a + step
                rest.discard((b, a))
                found.add((b, a))
    return {b for b, _ in found}


def blocks(lines: set[int], words: dict[int, int], least: int) -> list[int]:
    """The lines that lie in runs of at least so many words."""
    kept: list[int] = []
    run: list[int] = []
    for n in [*sorted(lines), -1]:
        if run and n != run[-1] + 1:
            kept += run if sum(words[x] for x in run) >= least else []
            run = []
        run.append(n)
    return kept


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """First and last line of the shortest runs of at least so many words that begin, or end, at each line."""
    found: set[tuple[int, int]] = set()
    end, total = 0, 0
    for begin in range(len(words)):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        found.add((begin, end - 1))
        total -= words[begin]
    begin, total = len(words), 0
    for end in range(len(words) - 1, -1, -1):
        while begin and total < least:
            begin -= 1
            total += words[begin]
        if total < least:
            break
        found.add((begin, end))
        total -= words[end]
    return sorted(found)


def pair_blocks(later: tuple[list, list, list], earlier: tuple[list, list, list], least: int) -> list[int]:
    """Lines of the later document in its blocks with the earlier one; each has lines, whether they stand once, words."""
    at = {x: m for m, x in enumerate(earlier[0])}
    shared = [(n, at[x], (later[1][n] and earlier[1][at[x]]) or later[2][n] >= least) for n, x in enumerate(later[0]) if x in at]
    return blocks(aligned(shared), dict(enumerate(later[2])), least)


def _sequences(key: T.DataType, docs: DataFrame, least: int) -> DataFrame:
    """A row per document that can align: ``lines`` (a hash of line and k) with their ``chars, once, words, place``, and ``runs``, hashes of its windows of several lines and of all lines."""
    arrays = {"lines": (T.LongType(), pa.int64()), "chars": (T.IntegerType(), pa.int32()), "once": (T.BooleanType(), pa.bool_()), "words": (T.IntegerType(), pa.int32()), "place": (T.IntegerType(), pa.int32()), "runs": (T.LongType(), pa.int64())}
    schema = T.StructType([T.StructField("id", key), T.StructField("text_hash", T.LongType()), *[T.StructField(n, T.ArrayType(t)) for n, (t, _) in arrays.items()]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                owners, rows = [], []
                for owner, text in enumerate(some.column(2).to_pylist()):
                    if not text:
                        continue
                    found = [(p, x, len(x.split())) for p, x in enumerate(text.encode().split(b"\n"))]
                    found = [(p, x.rstrip(), w) for p, x, w in found if w]
                    times, seen = Counter(x for _, x, _ in found), Counter()
                    words, once = [w for _, _, w in found], [times[x] == 1 for _, x, _ in found]
                    if not any(once) and max(words, default=0) < least:
                        continue  # nothing to begin an alignment with
                    lines = np.empty(len(found), "<u8")
                    for n, (_, line, _) in enumerate(found):
                        lines[n] = xxhash.xxh64_intdigest(line, seen[line])
                        seen[line] += 1
                    spans = [(a, b) for a, b in windows(words, least) if a < b]
                    runs = {xxhash.xxh64_intdigest(lines[a : b + 1].tobytes(), 1) for a, b in {*spans, (0, len(found) - 1)}}
                    owners.append(owner)
                    rows.append((lines.view("<i8"), [len(x) for _, x, _ in found], once, words, [p for p, _, _ in found], np.array(sorted(runs), "<u8").view("<i8")))
                take = pa.array(owners, pa.int32())
                columns = [pa.array(c, pa.list_(t)) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * 6, arrays.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), *columns], names=schema.names)

    return docs.mapInArrow(cut, schema)


def _same(a: str, b: str) -> Column:
    """Whether two document columns (``<name>_id``, ``<name>_hash``) agree."""
    return F.col(f"{a}_id").eqNullSafe(F.col(f"{b}_id")) & (F.col(f"{a}_hash") == F.col(f"{b}_hash"))


def _aligned_pairs(kind: T.DataType, pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """``d_id, d_hash, e_id, e_hash, gone``: the pairs with blocks, and the lines of ``d`` in them."""
    inside = ["lines", "chars", "once", "words"]
    early, late = (docs.select(F.col("id").alias(f"{p}_id"), F.col("text_hash").alias(f"{p}_hash"), *[F.col(c).alias(f"{p[0]}_{c}") for c in inside]) for p in ("ee", "dd"))
    met = pairs.join(early, _same("e", "ee")).join(late, _same("d", "dd"))
    columns = [f"{p}_{c}" for p in "de" for c in inside]
    schema = T.StructType([T.StructField(n, t) for p in "de" for n, t in ((f"{p}_id", kind), (f"{p}_hash", T.LongType()))] + [T.StructField("gone", T.ArrayType(T.IntegerType()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, gone = [], []
            for row in range(batch.num_rows):
                both = [[batch.column(4 + 4 * p + c)[row].values.to_pylist() for c in range(4)] for p in range(2)]
                found = pair_blocks(*((list(zip(x[0], x[1], strict=True)), x[2], x[3]) for x in both), least)
                if found:
                    taken.append(row)
                    gone.append(found)
            rows = batch.select([0, 1, 2, 3]).take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(gone, pa.list_(pa.int32()))], names=schema.names)

    return met.select("d_id", "d_hash", "e_id", "e_hash", *columns).mapInArrow(align, schema)


def _other_blocks(kind: T.DataType, docs: DataFrame, shared: DataFrame, tried: DataFrame, done: DataFrame, least: int) -> list[DataFrame]:
    """Blocks of pairs not tried whose later document has a window that is shared, not all deleted, and in the earlier document line by line.

    A window meets few of its holders, drawn by hash, then ``MORE`` times as many, and in the last
    turn all, as long as it is not all deleted.
    """
    deleted = done.groupBy("d_id", "d_hash").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    deleted = deleted.select(F.col("d_id").alias("x_id"), F.col("d_hash").alias("x_hash"), "gone")
    known = docs.select(F.col("id").alias("dd_id"), F.col("text_hash").alias("dd_hash"), "lines", "words")
    left = shared.join(deleted, _same("d", "x"), "left").join(known, _same("d", "dd")).select("d_id", "d_hash", "met", "gone", "lines", "words")
    schema = T.StructType([T.StructField("d_id", kind), T.StructField("d_hash", T.LongType()), T.StructField("w", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("held", T.ArrayType(T.LongType()))])

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, names, spans, held = [], [], [], []
            for row in range(batch.num_rows):
                met, gone, lines, words = (set(x or []) if c < 2 else x for c, x in enumerate(batch.column(2 + c)[row].as_py() for c in range(4)))
                if all(n in gone for n, x in enumerate(lines) if x in met):
                    continue
                for a, b in windows(words, least):
                    some = lines[a : b + 1]
                    if not gone.issuperset(range(a, b + 1)) and met.issuperset(some):
                        taken.append(row)
                        names.append(xxhash.xxh64_intdigest(np.array(some, "<i8").tobytes(), 2))
                        spans.append((a, b))
                        held.append(some)
            rows = batch.select([0, 1]).take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.array(names, "<u8").view("<i8")), *(pa.array([x[i] for x in spans], pa.int32()) for i in range(2)), pa.array(held, pa.list_(pa.int64()))], names=schema.names)

    still = written(left.mapInArrow(open_windows, schema), "windows")
    posts = docs.select(F.col("id").alias("e_id"), F.col("text_hash").alias("e_hash"), F.explode("lines").alias("line"))
    asked = still.groupBy("w").agg(F.first("held").alias("held"))
    each = asked.select("w", "held", F.explode("held").alias("line"))
    counts = posts.join(each.select("line").distinct(), "line", "left_semi").groupBy("line").count()
    rarest = each.join(counts, "line").groupBy("w").agg(F.min_by(F.struct("line", "held"), F.struct("count", "line")).alias("r")).select("w", "r.*")
    maybe = posts.join(rarest, "line").select("w", "held", "e_id", "e_hash")
    owners = docs.select(F.col("id").alias("ee_id"), F.col("text_hash").alias("ee_hash"), "lines")
    holders = maybe.join(owners, _same("e", "ee")).where(F.size(F.array_intersect("held", "lines")) == F.size(F.array_distinct("held"))).select("w", "e_id", "e_hash")
    holders = written(holders, "owners")
    counts = holders.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    holders = holders.join(counts, "w")
    before = F.struct(F.col("e_id").isNull(), "e_id", "e_hash") < F.struct(F.col("d_id").isNull().alias("col1"), F.col("d_id").alias("e_id"), F.col("d_hash").alias("e_hash"))
    drawn = F.pmod(F.xxhash64("e_id", "e_hash"), F.lit(1 << 30)) / (1 << 30)
    still, found, draws = still.select("d_id", "d_hash", "w", "a", "b"), [], FIRST_DRAWS
    while most and not still.isEmpty():
        some = holders.where(drawn * F.col("n") < draws)
        pairs = still.join(some, "w").where(before).select("d_id", "d_hash", "e_id", "e_hash").distinct()
        old = tried.select(F.col("d_id").alias("x_id"), F.col("d_hash").alias("x_hash"), F.col("e_id").alias("y_id"), F.col("e_hash").alias("y_hash"))
        pairs = written(pairs.join(old, _same("d", "x") & _same("e", "y"), "left_anti"), "pairs")
        new = written(_aligned_pairs(kind, pairs, docs, least), "blocks")
        found.append(new)
        if draws >= most:
            break
        tried, draws = tried.unionByName(pairs), draws * MORE
        done = done.unionByName(new)
        gone = done.groupBy("d_id", "d_hash").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
        gone = gone.select(F.col("d_id").alias("x_id"), F.col("d_hash").alias("x_hash"), "gone")
        whole = F.size(F.array_except(F.sequence("a", "b"), "gone")) == 0
        still = written(still.join(gone, _same("d", "x"), "left").where(~F.coalesce(whole, F.lit(False))).select("d_id", "d_hash", "w", "a", "b"), "windows")
    return found


def line_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """What to delete: ``id, text_hash, keep`` (1-based start, length of line ranges), ``n_removed, removed_words, aligned_with``.

    One row per document (key and text hash) that loses lines. Lines are equal if they are up to
    trailing white space; blank lines match nothing and stay. Null and empty texts have no lines.
    ``aligned_with`` has the earlier documents whose blocks were deleted.
    """
    kind = docs.schema[key].dataType
    source = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    known = written(_sequences(kind, source, min_words), "lines")
    posts = known.select(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash").alias("doc"), F.explode(F.concat("lines", "runs")).alias("post"))
    first = posts.groupBy("post").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    # a table of its own, so that the join meets two plain exchanges and a hot line can be split
    first = written(first.where(F.col("first") != F.col("last")).select("post", "first"), "holders")
    met = posts.join(first, "post").where(F.col("doc") != F.col("first"))
    per_doc = met.groupBy("doc.id", "doc.text_hash").agg(F.collect_set("post").alias("met"), F.collect_set("first").alias("firsts"))
    shared = written(per_doc.select(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash"), "met", "firsts"), "shared")
    docs_once = known.dropDuplicates(["id", "text_hash"])
    pairs = shared.select("d_id", "d_hash", F.explode("firsts").alias("e")).select("d_id", "d_hash", F.col("e.id").alias("e_id"), F.col("e.text_hash").alias("e_hash"))
    done = written(_aligned_pairs(kind, pairs, docs_once, min_words), "blocks")
    for more in _other_blocks(kind, docs_once, shared, pairs, done, min_words):
        done = done.unionByName(more)
    gone = done.groupBy("d_id", "d_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.collect_set(F.struct("e_id")).alias("partners"))
    sized = docs_once.select(F.col("id").alias("dd_id"), F.col("text_hash").alias("dd_hash"), "words", "place")
    per_doc = gone.join(sized, _same("d", "dd")).select(F.col("d_id").alias("id"), F.col("d_hash").alias("text_hash"), "gone", "words", "place", F.col("partners.e_id").alias("partners"))
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("text_hash", T.LongType())]
        + [T.StructField("keep", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])))]
        + [T.StructField("n_removed", T.IntegerType()), T.StructField("removed_words", T.LongType()), T.StructField("aligned_with", T.ArrayType(kind))]
    )

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps, removed, words_gone, partners = [], [], [], []
            for row in range(batch.num_rows):
                gone, words, place, names = (batch.column(c)[row].as_py() for c in range(2, 6))
                keep, at = [], 0
                for p in [*(place[n] for n in gone), TO_END]:
                    if p > at:
                        keep.append({"start": at + 1, "length": p - at})
                    at = p + 1
                keeps.append(keep)
                removed.append(len(gone))
                words_gone.append(sum(words[n] for n in gone))
                partners.append(sorted(names, key=lambda x: (x is None, x)))
            ranges = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            columns = [pa.array(keeps, ranges), pa.array(removed, pa.int32()), pa.array(words_gone, pa.int64()), pa.array(partners, pa.list_(batch.schema.field(0).type))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return per_doc.mapInArrow(edit, schema)


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` after deletion, and ``n_removed``, ``removed_words``, ``aligned_with``.

    A document without common blocks keeps its text as it is and has 0, 0 and an empty list. A
    document may become empty. Columns of ``docs`` must not have these names or begin with ``_line``.
    """
    edits = line_edits(docs, key, text, min_words).select(F.col("id").alias("_line_id"), F.col("text_hash").alias("_line_text"), "keep", "n_removed", "removed_words", "aligned_with")
    marked = docs.withColumn("_line_hash", F.xxhash64(F.col(text)))
    met = marked.join(edits, F.col(key).eqNullSafe(F.col("_line_id")) & (F.col("_line_hash") == F.col("_line_text")), "left")
    lines = F.transform(F.array(F.split(F.col(text), "\n", -1)), lambda x: F.flatten(F.transform("keep", lambda r: F.slice(x, r.start, r.length))))[0]
    shorter = F.when(F.col("keep").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text))
    kept = [shorter.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast(T.ArrayType(docs.schema[key].dataType))
    return met.select(
        *kept,
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        F.coalesce("aligned_with", none).alias("aligned_with"),
    )
