"""Alignment of two tokenizers by whitespace-token anchors.

Both tokenizers see the whole text. Where a token of each begins with a space at the same byte
offset, the tokens before it end together: such shared ends cut a text into windows of token ids.
Few windows are new, so a window is aligned once for each pair of id tuples in a block of
documents; inside it, groups are cut wherever both sides end a token.

A pair of ids counts as many documents as hold it linked. A block sends each of its distinct pairs
once with the number of its documents, and gets back the pair's count in all of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.chunks import KEPT_CHARS, SAFE
from tablewright.llm.packing import byte_letters, model_ids
from tablewright.llm.store import written

BLOCK_BYTES = 3_000_000  # of texts that are aligned together
KEPT_CHUNKS = 500_000
LONG, LONG_BLANK = 100_000, re.compile(r"\s{50000}")
WIDE = 1 << 16  # links of one group from which they are folded before they are listed
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Tokenizers:
    """Ids of both tokenizers, and the bytes of their tokens.

    Side A runs the merges of a tokenizers file whose ids follow their order, which lets tiktoken
    give the same ids. Side B has no piece in which a space follows another character; so a chunk
    between single spaces has the ids that it has in the whole text, and chunks are remembered, up
    to ``KEPT_CHUNKS``. Both facts are checked here.
    """

    def __init__(self, bpe_path: str, pattern: str, piece_path: str):
        import sentencepiece
        import tiktoken

        letters = {chr(c): b for b, c in byte_letters().items()}
        with open(bpe_path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        first = len(letters)
        if [vocabulary[m] for m in joined] != list(range(first, first + len(merges))):
            raise ValueError("ids don't follow the order of merges")
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in ranks.items():
            self.a_bytes[i] = token
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = model_ids(bpe_path, pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("in a piece a space follows another character")
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]
        self.sides = (Side.of(self.a_bytes, b"|"), Side.of(self.b_bytes, b";"))
        self.chunks: dict[str, tuple[bytes, bytes]] = {}

    def a_ids(self, body: str) -> bytes:
        """Packed ids of side A; the fast library fails on millions of blanks in a row."""
        if len(body) > LONG and LONG_BLANK.search(body):
            return self.slow(body)
        return np.array(self.encoding.encode_ordinary(body), "<u4").tobytes()

    def spelled(self, text: str, ids: bytes) -> bool:
        """Whether tokens of side B spell space+text."""
        return b"".join(map(self.b_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) == (" " + text).encode()

    def encode(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Packed ids of both sides for space+chunk, of many chunks at once."""
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        a = {}
        if plain:
            whole = self.a_ids(" " + " ".join(plain))
            ends = np.cumsum(self.sides[0].sizes[np.frombuffer(whole, "<u4")])
            cut = 4 * (1 + np.searchsorted(ends, np.cumsum([1 + len(c.encode()) for c in plain])))
            a = dict(zip(plain, [whole[i:j] for i, j in zip([0, *cut.tolist()], cut.tolist(), strict=False)], strict=True))
        b = self.pieces.encode(chunks, num_threads=1)
        cut = np.cumsum([4 * len(x) for x in b]).tolist()
        whole = np.fromiter(chain.from_iterable(b), "<u4").tobytes()
        return {c: (a[c] if c in a else self.a_ids(" " + c), whole[i:j]) for c, i, j in zip(chunks, [0, *cut], cut, strict=False)}

    def ids_of(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of both sides for each whole text; None where side B doesn't spell space+text, as A always does."""
        split, chunks = [SAFE.split(t) for t in texts], self.chunks
        if len(chunks) >= KEPT_CHUNKS:
            chunks.clear()
        known = [list(map(chunks.get, found)) for found in split]
        missing = {c for found, ids in zip(split, known, strict=True) if None in ids for c, i in zip(found, ids, strict=True) if i is None}
        new = self.encode(list(missing))
        odd = {c for c, ids in new.items() if not self.spelled(c, ids[1])}
        chunks.update((c, ids) for c, ids in new.items() if len(c) <= KEPT_CHARS and c not in odd)
        out: list[tuple[bytes, bytes] | None] = []
        for text, found, ids in zip(texts, split, known, strict=True):
            if None in ids:
                ids = [i or new[c] for c, i in zip(found, ids, strict=True)]
            a, b = b"".join([i[0] for i in ids]), b"".join([i[1] for i in ids])
            out.append(None if odd and any(c in odd for c in found) and not self.spelled(text, b) else (a, b))
        return out


@cache
def tokenizers(bpe_path: str, pattern: str, piece_path: str) -> Tokenizers:
    """One for each Python worker, whose tasks share what it remembers."""
    return Tokenizers(bpe_path, pattern, piece_path)


@dataclass
class Side:
    """What the tokens of one tokenizer are: byte lengths, space marks, ids as text with a separator."""

    sizes: np.ndarray
    spaced: np.ndarray
    shown: list[bytes]  # id by id: with a comma, then with the separator that ends a group's side

    @classmethod
    def of(cls, table: list[bytes], end: bytes) -> Side:
        shown = [str(i).encode() + mark for i in range(len(table)) for mark in (b",", end)]
        return cls(np.array([len(x) for x in table]), np.array([x[:1] == b" " for x in table]), shown)


def anchors(a: np.ndarray, b: np.ndarray, sides: tuple[Side, Side]) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, as places among the tokens of either side: space-marked tokens that start at one offset."""
    found = []
    for ids, side in zip((a, b), sides, strict=True):
        sizes, at = side.sizes[ids], np.flatnonzero(side.spaced[ids])
        found.append((at, (np.cumsum(sizes) - sizes)[at]))
    (a_at, a_start), (b_at, b_start) = found
    i, j = common(a_start, b_start)
    return a_at[i], b_at[j]


def common(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two rising arrays of byte offsets hold the same ones."""
    marked = np.zeros((2, 1 + max(x[-1], y[-1])), bool)
    marked[0, x], marked[1, y] = True, True
    return np.flatnonzero(marked[1][x]), np.flatnonzero(marked[0][y])


def mixed(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each window's ids and their places in it."""
    place = np.arange(len(ids)) - np.repeat(begin, length)
    x = (ids.astype(np.uint64) << np.uint64(24)) + place.astype(np.uint64) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.add.reduceat(x ^ (x >> np.uint64(31)), begin)


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)


def memo(a: np.ndarray, b: np.ndarray, begins: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One window of each pair of id tuples, and each window's number among them.

    Hashes find them, and ids decide: a window whose ids differ from those found stands for itself.
    """
    both, lengths = 0, []
    for ids, begin, salt in ((a, begins[0], 1 << 62), (b, begins[1], 1 << 61)):
        lengths.append(np.diff(begin, append=len(ids)))
        both = both * np.uint64(0x9E3779B97F4A7C15) + mixed(ids, begin, lengths[-1], salt)
    _, first, number = np.unique(both, return_index=True, return_inverse=True)
    same = np.ones(len(both), bool)
    for ids, begin, length in zip((a, b), begins, lengths, strict=True):
        model = first[number]
        fits = length == length[model]
        same &= fits
        at = spread(begin[model], np.where(fits, length, 0))
        mine = spread(begin, np.where(fits, length, 0))
        owner = np.repeat(np.arange(len(begin)), np.where(fits, length, 0))
        same[owner[ids[mine] != ids[at]]] = False
    odd = np.flatnonzero(~same)
    number[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), number


@dataclass
class Aligned:
    """Windows cut into groups: of each its text, number of groups and links, and its links with their times."""

    shown: list[bytes]
    groups: np.ndarray
    links: np.ndarray
    start: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def aligned(a: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_length: np.ndarray, sides: tuple[Side, Side]) -> Aligned:
    """Align windows that lie one after the other; ``a_length`` and ``b_length`` are their tokens."""
    ends = [np.cumsum(side.sizes[ids]) for ids, side in zip((a, b), sides, strict=True)]
    i, j = common(*ends)  # the last tokens of groups
    cuts = (np.concatenate([[0], i + 1]), np.concatenate([[0], j + 1]))
    many = (np.diff(cuts[0]), np.diff(cuts[1]))
    window = np.searchsorted(np.cumsum(a_length), i, side="right")
    # ids as text: of each group those of A, then those of B
    code, total = np.empty(len(a) + len(b), np.int64), len(sides[0].shown)
    for ids, mine, other, last, add in ((a, 0, 1, i, 0), (b, 1, 0, j, total)):
        group = np.repeat(np.arange(len(i)), many[mine])
        marked = 2 * ids.astype(np.int64) + add
        marked[last] += 1
        code[np.arange(len(ids)) + cuts[other][group + mine]] = marked
    table = sides[0].shown + sides[1].shown
    words = list(map(table.__getitem__, code.tolist()))
    borders = np.cumsum(a_length + b_length).tolist()
    shown = [b"".join(words[s:e]) for s, e in zip([0, *borders], borders, strict=False)]
    # links, folded first where a group holds very many
    product = many[0] * many[1]
    few = np.flatnonzero(product < WIDE)
    step = spread(np.zeros(len(few), np.int64), product[few])
    of = np.repeat(few, product[few])
    left, right = a[cuts[0][of] + step // many[1][of]], b[cuts[1][of] + step % many[1][of]]
    owners, pairs, times = [window[of]], [left.astype(np.int64) << 32 | right], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(product >= WIDE):
        (x, n), (y, m) = (np.unique(ids[c[g] : c[g + 1]], return_counts=True) for ids, c in zip((a, b), cuts, strict=True))
        pairs.append((x.astype(np.int64)[:, None] << 32 | y[None, :]).ravel())
        times.append((n[:, None] * m[None, :]).ravel())
        owners.append(np.full(len(pairs[-1]), window[g]))
    owner, pair, often = map(np.concatenate, (owners, pairs, times))
    if len(few) < len(product):
        order = np.argsort(owner, kind="stable")
        owner, pair, often = owner[order], pair[order], often[order]
    count = len(a_length)
    start = np.searchsorted(owner, np.arange(count + 1))
    links = np.bincount(window, weights=product, minlength=count).astype(np.int64)
    return Aligned(shown, np.bincount(window, minlength=count), links, start, pair, often)


def align_block(ids: list[tuple[bytes, bytes] | None], sides: tuple[Side, Side]) -> tuple[list[tuple], np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Facts of each document; the block's distinct pairs, sorted, and how many documents hold each; each document's pairs by their places, and times."""
    nothing = (0, 0, 0, 0, "")
    full = [x for x in ids if x is not None and x[0]]
    empty = np.empty(0, np.int64)
    if not full:
        return [nothing] * len(ids), empty, empty, [(empty, empty)] * len(ids)
    a, b = (np.frombuffer(b"".join(x[s] for x in full), "<u4") for s in (0, 1))
    a_many, b_many = ([len(x[s]) // 4 for x in full] for s in (0, 1))
    begins = anchors(a, b, sides)
    models, number = memo(a, b, begins)
    lengths = [np.diff(begin, append=len(side)) for side, begin in zip((a, b), begins, strict=True)]
    chosen = [(side[spread(begin[models], n[models])], n[models]) for side, begin, n in zip((a, b), begins, lengths, strict=True)]
    found = aligned(*chosen[0], *chosen[1], sides)
    # a text begins with a space on both sides, so its first window begins there
    borders = np.searchsorted(begins[0], np.cumsum([0, *a_many]))
    owner = np.repeat(np.arange(len(full)), np.diff(borders))
    wide = len(models)
    both, often = np.unique(owner * wide + number, return_counts=True)
    doc, window = both // wide, both % wide
    many = np.diff(found.start)[window]
    at = spread(found.start[window], many)
    distinct, local = np.unique(found.pair, return_inverse=True)
    key = np.repeat(doc, many) * len(distinct) + local[at]
    order = np.argsort(key)
    key, times = key[order], (found.times[at] * np.repeat(often, many))[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    held, total = key[first], np.add.reduceat(times, first)
    place = held % len(distinct)
    cut = np.searchsorted(held, np.arange(len(full) + 1) * len(distinct))
    groups, links = (np.add.reduceat(x[number], borders[:-1]).tolist() for x in (found.groups, found.links))
    sequence = number.tolist()
    facts, each, turn = [], [], 0
    for x in ids:
        if x is None or not x[0]:
            facts.append(nothing)
            each.append((empty, empty))
            continue
        text = b"".join(map(found.shown.__getitem__, sequence[borders[turn] : borders[turn + 1]]))
        facts.append((a_many[turn], b_many[turn], groups[turn], links[turn], hashlib.sha256(text[:-1]).hexdigest()))
        each.append((place[cut[turn] : cut[turn + 1]], total[cut[turn] : cut[turn + 1]]))
        turn += 1
    return facts, distinct, np.bincount(place, minlength=len(distinct)), each


def align(docs: DataFrame, bpe_path: str, pattern: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.

    Side A is space+text by a byte-level BPE file of the tokenizers library, side B the text by a
    piece model; special tokens in texts are ordinary text. A pair of ids is linked where its tokens
    share a group; its count is the number of documents that hold it so. ``n_best`` counts the links
    whose count is the highest of their A id, ``count_sum`` adds up the counts of all links.

    Null and empty texts, and texts that either side spells differently, have zeros and an empty
    ``groups_sha256``. Repeated rows are documents of their own, null keys stay, other columns are
    ignored (the key must not be named like a result), and an empty table gives no rows. A block
    holds whole documents, so a text longer than ``BLOCK_BYTES`` ends its block.
    """
    names = ["block", "pair", "n", "id", *COUNTS, "groups_sha256", "place", "times"]
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in names[:3]]
        + [T.StructField("id", docs.schema[key].dataType)]
        + [T.StructField(n, T.LongType()) for n in COUNTS]
        + [T.StructField("groups_sha256", T.StringType()), T.StructField("place", T.BinaryType()), T.StructField("times", T.BinaryType())]
    )

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(bpe_path, pattern, piece_path)
        number, kind, size = TaskContext.get().partitionId() << 32, pa.null(), 0
        keys: list = []
        ids: list[tuple[bytes, bytes] | None] = []

        def sent() -> Iterator[pa.RecordBatch]:
            facts, distinct, held, each = align_block(ids, both.sides)
            for at in range(0, len(distinct), 65536):
                some = distinct[at : at + 65536]
                found = [pa.array(np.full(len(some), number)), pa.array(some), pa.array(held[at : at + 65536])]
                blank = [pa.nulls(len(some), t) for t in (kind, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays(found + blank, names=names)
            for at in range(0, len(each), 512):
                some, mine = list(zip(*facts[at : at + 512], strict=True)), each[at : at + 512]
                found = [pa.array(np.full(len(mine), number)), pa.nulls(len(mine), pa.int64()), pa.nulls(len(mine), pa.int64())]
                told = [pa.array(keys[at : at + 512], kind), *[pa.array(c, pa.int64()) for c in some[:4]], pa.array(some[4])]
                yield pa.RecordBatch.from_arrays(found + told + [pa.array([packed(m[c]) for m in mine], pa.binary()) for c in (0, 1)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                told = iter(both.ids_of([t for t in texts if t]))
                keys += some.column(0).to_pylist()
                ids += [next(told) if t else None for t in texts]
                size += sum(map(len, texts)) + len(texts) * 100
                if size >= BLOCK_BYTES:
                    yield from sent()
                    keys, ids, size, number = [], [], 0, number + 1
        if keys:
            yield from sent()

    rows = written(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(in_blocks, schema), "token-links")
    pairs = rows.where("pair is not null").select("block", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    counted = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answered = pairs.select(F.col("block").alias("of"), "pair").join(counted, "pair")
    found = rows.where("pair is null").select("block", "id", *COUNTS, "groups_sha256", "place", "times")
    done = T.StructType([schema["id"], *[schema[n] for n in COUNTS], schema["groups_sha256"], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(documents: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("pair").to_numpy())
        count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order].astype(bool)
        sums = []
        for place, times in zip(documents.column("place").to_pylist(), documents.column("times").to_pylist(), strict=True):
            at, n = unpacked(place), unpacked(times)
            sums.append((int(n[best[at]].sum()), int((n * count[at]).sum())))
        told = documents.drop_columns(["block", "place", "times"])
        for name, values in zip(("n_best", "count_sum"), zip(*sums, strict=True), strict=True):
            told = told.append_column(name, pa.array(values, pa.int64()))
        return told

    return found.groupBy("block").cogroup(answered.groupBy("of")).applyInArrow(summed, done).withColumnRenamed("id", key)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes: the width of one, then all in that width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(found: bytes) -> np.ndarray:
    return np.frombuffer(found, f"<u{found[0]}", offset=1).astype(np.int64)
