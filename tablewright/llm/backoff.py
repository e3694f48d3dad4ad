"""Language-model scoring with a weighted backoff automaton.

Words are tokens and every text ends with an end token. n-grams are counted over the training
texts and smoothed by Dirichlet priors: with history h and its shorter history g,
P(w | h) = (c(hw) + prior * P(w | g)) / (c(h) + prior). As an automaton: every history that
occurs is a state, every n-gram an arc with this weight, and a state without the arc fails to its
shorter history with the weight prior / (c(h) + prior). At the bottom, a known word has its
share of the tokens and all unknown words together the Good-Turing share of tokens seen once.
A text is scored by one walk from left to right that carries the state.

The automaton is as large as the corpus, so no machine holds it whole. Each task of the scan cuts
its rows into blocks of text, which are stored once as numbered words. A block sends the hashes
of its distinct n-grams with its training counts to ranges of the hash space, one sorted list per
range; each range adds up and sends every block the totals, in the block's own order and so
without the hashes. A block then builds all states and arcs that its own texts can visit. Hashes
of words have 63 bits, those of longer n-grams 56: with 10^9 distinct ones in a corpus, one in
7 * 10^7 has the count of another added to its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.store import written

ORDER, PRIOR = 3, 50.0
BLOCK_BYTES = 8 << 20  # of text
RANGE_TOKENS = 1 << 20
RUN_TOKENS = 1 << 17  # of texts that are walked over the same arcs
END, START = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordNumbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left ^ (right >> np.uint64(29)) ^ (right << np.uint64(35))) * MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length the n-gram that ends at every token, and whether it lies in the text.

    Histories reach back to one start token before the text. Keys of single words are odd; the
    last byte of all others is 0.
    """
    first = np.cumsum(counts) - counts
    inside, ending = np.ones(len(words), bool), words
    yield words | np.uint64(1), inside
    for n in range(2, order + 1):
        before = np.roll(ending, 1)
        if n == 2:
            before[first] = START
        else:  # the first n - 2 tokens of a text have no such history
            inside = inside.copy()
            inside[first + np.minimum(n - 3, counts - 1)] = False
        ending = mixed(before, words)
        yield ending & ~np.uint64(255), inside


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers, compressed byte plane by byte plane: small ones leave planes of zeros."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys: differences of the upper seven bytes, last bytes as they are."""
    return planes(np.diff(keys >> np.uint64(8), prepend=np.uint64(0)) << np.uint64(8) | keys & np.uint64(255))


def from_steps(data: bytes) -> np.ndarray:
    values = from_planes(data)
    return np.cumsum(values >> np.uint64(8), dtype=np.uint64) << np.uint64(8) | values & np.uint64(255)


def block_row(texts: list[str | None]) -> dict[str, bytes]:
    """A block's words as hashes, its tokens as numbers of these, its texts as lengths; A-Z are lowered."""
    known, words, counts = WordNumbers(), [], []
    end = known[b" "]  # no word holds a space
    for text in texts:
        found = (text or "").encode().lower().split()
        words += map(known.__getitem__, found)
        words.append(end)
        counts.append(len(found) + 1)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
    hashes[end] = END
    return {"types": planes(hashes), "words": planes(np.array(words, np.uint64)), "lengths": planes(np.array(counts, np.uint64))}


@dataclass
class Grams:
    """Sorted distinct n-grams of a block, the place among them of the n-gram of each length at
    each token (-1: it would reach out of the text), and the token counts of the texts."""

    keys: np.ndarray
    at: list[np.ndarray]
    counts: np.ndarray


def block_grams(row: dict[str, bytes], order: int) -> Grams:
    words = from_planes(row["types"])[from_planes(row["words"])]
    counts = from_planes(row["lengths"]).astype(np.int64)
    distinct, places, insides = [], [], []
    for found, inside in grams(words, counts, order):
        keys, place = np.unique(found[inside], return_inverse=True)
        distinct.append(keys)
        places.append(place.astype(np.int32))
        insides.append(inside)
    del words
    keys = np.sort(np.concatenate(distinct))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    at = []
    for mine in distinct:
        inside, place = insides.pop(0), places.pop(0)
        level = np.full(len(inside), -1, np.int32)
        level[inside] = np.searchsorted(keys, mine).astype(np.int32)[place]
        at.append(level)
    return Grams(keys, at, counts)


@dataclass
class Automaton:
    """States and arcs by number. ``arcs`` maps state * size + word to an arc; ``weights`` and
    ``targets`` are those of the arcs, ``falls`` and ``fall_to`` those of the failure arc of every
    state. Weights are log10; ``targets`` are kept multiplied by ``size``. The root has no failure
    arc: what it doesn't know is unknown and leads back to it."""

    arcs: dict[int, int]
    weights: memoryview
    targets: memoryview
    falls: memoryview
    fall_to: memoryview
    size: int
    start: int
    root: int
    unknown: float

    def walk(self, words: list[int]) -> float:
        """The log10 probability of a text: one pass from left to right that carries the state."""
        arcs, weights, targets, root, state, score = self.arcs, self.weights, self.targets, self.root, self.start, 0.0
        for word in words:
            arc = arcs.get(state + word)
            while arc is None and state != root:
                place = state // self.size
                score += self.falls[place]
                state = self.fall_to[place] * self.size
                arc = arcs.get(state + word)
            if arc is None:
                score += self.unknown
            else:
                score += weights[arc]
                state = targets[arc]
        return score


@dataclass
class Arcs:
    """All arcs and failure arcs that a block's texts can visit, as arrays by n-gram.

    An n-gram's place in ``block.keys`` names its arc and, if it is shorter than the order, the
    state that it leads to; two more numbers stand for the root and the start of a text.
    """

    block: Grams
    labels: np.ndarray
    weights: np.ndarray
    targets: np.ndarray
    falls: np.ndarray
    fall_to: np.ndarray
    unknown: float

    def automaton(self, a: int, b: int) -> Automaton:
        """The part that tokens ``a`` to ``b`` visit, so that few arcs are objects at a time."""
        n = len(self.labels)
        visited = np.zeros(n, bool)
        for at in self.block.at:
            here = at[a:b]
            visited[here[here >= 0]] = True
        real = np.flatnonzero(visited & (self.weights < np.inf))
        arcs = dict(zip(self.labels[real].tolist(), real.tolist(), strict=True))
        views = map(memoryview, (self.weights, self.targets, self.falls, self.fall_to))
        root, begin, size = n, n + 1, n + 2
        return Automaton(arcs, *views, size, (begin if len(self.block.at) > 1 else root) * size, root * size, self.unknown)


def weighted(block: Grams, totals: np.ndarray, stats: tuple[int, int, int, int], prior: float) -> Arcs:
    """The arcs of a block with the corpus's counts; an n-gram without a count is no arc (infinite weight)."""
    n_tokens, _, n_once, n_texts = stats
    order, n = len(block.at), len(block.keys)
    root, begin, size = n, n + 1, n + 2
    history, word, shorter = (np.full(n + 2, root, np.int32) for _ in range(3))
    level = np.zeros(n, np.int8)
    for length, at in enumerate(block.at, start=1):
        here = np.flatnonzero(at >= 0)
        gram = at[here]
        level[gram], word[gram] = length, block.at[0][here]
        if length > 1:
            # only the first token of a text has no earlier one, and only pairs reach before it
            before = block.at[length - 2][here - 1]
            if length == 2:
                before[np.cumsum(block.counts) - block.counts] = begin
            history[gram], shorter[gram] = before, block.at[length - 2][here]
    seen = np.append(totals, (0.0, n_texts))
    unknown = (n_once + 1) / (n_tokens + 2)
    share = totals / max(1, n_tokens) * (1 - unknown)
    for length in range(2, order + 1):
        g = np.flatnonzero((level == length) & (totals > 0))
        share[g] = (totals[g] + prior * share[shorter[g]]) / (seen[history[g]] + prior)
    weights = np.full(n, np.inf)
    np.log10(share, out=weights, where=totals > 0)
    targets = np.where(level < order, np.arange(n), shorter[:n]) * np.int64(size)
    falls = np.log10(prior / (seen + prior))
    return Arcs(block, history[:n] * np.int64(size) + word[:n], weights, targets, falls, shorter, float(np.log10(unknown)))


def scores(block: Grams, totals: np.ndarray, stats: tuple[int, int, int, int], prior: float) -> tuple:
    """Base and model log10 scores and known tokens of each text."""
    n_tokens, n_types, _, _ = stats
    ends = np.cumsum(block.counts)
    first = ends - block.counts
    single = totals[block.at[0]]
    known = np.add.reduceat((single > 0).astype(np.int64), first)
    base = np.add.reduceat(np.log10((single + 0.1) / (n_tokens + 0.1 * (n_types + 1))), first)
    del single
    arcs = weighted(block, totals, stats, prior)

    def walked(run: range) -> list[float]:
        machine = arcs.automaton(first[run[0]], ends[run[-1]])
        return [machine.walk(block.at[0][first[i] : ends[i]].tolist()) for i in run]

    model, done = [], 0
    while done < len(first):  # a run of whole texts, at least one; the arcs of a run are freed before the next
        upto = max(done + 1, int(np.searchsorted(ends, first[done] + RUN_TOKENS, side="right")))
        model += walked(range(done, upto))
        done = upto
    return base, np.array(model), known


def score(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR
) -> DataFrame:
    """One row per text: the key, ``held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    ``train`` says which rows are learnt from. ``base_score`` adds 0.1 to the counts of single
    words. Null texts are empty and have the end token alone; repeated rows count and are scored
    once each; an empty table gives no rows; other columns are ignored. Without training rows all
    words are unknown.
    """
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType
    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    binary = ("types", "words", "lengths")
    block_schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(key_type)), T.StructField("train", T.ArrayType(T.BooleanType()))]
        + [T.StructField(n, T.BinaryType()) for n in binary]
        + [T.StructField("n_tokens", T.LongType())]
    )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of a task as one row per block."""
        number, waiting, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            rows = pa.concat_tables(waiting)
            # Arrow types as they came, in lists of one block
            lists = [
                pa.LargeListArray.from_arrays(pa.array([0, rows.num_rows], pa.int64()), c).cast(pa.list_(c.type))
                for c in (rows.column(n).combine_chunks() for n in ("id", "train"))
            ]
            row = block_row(texts)
            rest = [pa.array([row[n]], pa.binary()) for n in binary]
            n_tokens = pa.array([int(from_planes(row["lengths"]).sum())], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *rest, n_tokens], names=block_schema.names)

        for batch in batches:
            begin, of_batch = 0, batch.column("text").to_pylist()
            for i, value in enumerate(of_batch):
                texts.append(value)
                held += len(value or "") + 1
                if held >= BLOCK_BYTES or i + 1 == len(of_batch):
                    waiting.append(pa.Table.from_batches([batch.slice(begin, i + 1 - begin).select(["id", "train"])]))
                    begin = i + 1
                if held >= BLOCK_BYTES:
                    yield block()
                    number, waiting, texts, held = number + 1, [], [], 0
        if texts:
            yield block()

    blocks = written(narrow.mapInArrow(numbered, block_schema), "blocks")
    n_tokens = blocks.agg(F.sum("n_tokens").alias("n")).first().n or 0
    range_bits = max(0, int(np.ceil(np.log2(max(1, n_tokens / RANGE_TOKENS)))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits) if range_bits else np.array([], np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = block_grams(row, order)
                learnt = np.repeat(np.array(row["train"], bool), found.counts)
                mine = np.zeros(len(found.keys), np.int64)
                for at in found.at:
                    mine += np.bincount(at[learnt & (at >= 0)], minlength=len(mine))
                cuts = np.concatenate([[0], np.searchsorted(found.keys, edges), [len(found.keys)]])
                ranges, lists, sums = [], [], []
                for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if b > a:
                        ranges.append(number)
                        lists.append(steps(found.keys[a:b]))
                        sums.append(planes(mine[a:b]))
                yield pa.RecordBatch.from_pydict(
                    {"range": pa.array(ranges, pa.int64()), "block": pa.array([row["block"]] * len(ranges), pa.int64()),
                     "steps": pa.array(lists, pa.binary()), "counts": pa.array(sums, pa.binary())}
                )

    def added(part: pa.Table) -> pa.Table:
        lists = [from_steps(x) for x in part.column("steps").to_pylist()]
        counts = np.concatenate([from_planes(x) for x in part.column("counts").to_pylist()])
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(at, weights=counts)
        single = totals[(keys & np.uint64(1)) == 1]
        ends = np.cumsum([len(x) for x in lists])
        answers = [planes(totals[at[e - len(x) : e]].astype(np.uint64)) for e, x in zip(ends, lists, strict=True)]
        n, texts = part.num_rows, totals[keys == (END | np.uint64(1))].sum()
        first = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())
        return pa.table(
            {"range": part.column("range"), "block": part.column("block"), "totals": pa.array(answers, pa.binary()), "n_tokens": first(single.sum()),
             "n_types": first((single > 0).sum()), "n_once": first((single == 1).sum()), "n_texts": first(texts)}
        )

    lists = blocks.select("block", "train", *binary).mapInArrow(sent, "range long, block long, steps binary, counts binary")
    answer_schema = "range long, block long, totals binary, n_tokens long, n_types long, n_once long, n_texts long"
    answers = written(lists.groupBy("range").applyInArrow(added, answer_schema), "ngrams")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_types", "n_once", "n_texts")]).first()
    stats = tuple(sums)
    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    )

    def scored(block: pa.Table, replies: pa.Table) -> pa.Table:
        found = block_grams({n: block.column(n)[0].as_py() for n in binary}, order)
        parts = sorted(zip(replies.column("range").to_pylist(), replies.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([from_planes(x) for _, x in parts]).astype(np.float64)
        base, model, known = scores(found, totals, stats, prior)
        held = ~block.column("train").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)
        n = len(found.counts)
        columns = [block.column("ids").combine_chunks().flatten(), held, found.counts, known, np.full(n, stats[0], np.int64), base, model]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return (
        blocks.select("block", "ids", "train", *binary)
        .groupBy("block")
        .cogroup(answers.select("range", "block", "totals").groupBy("block"))
        .applyInArrow(scored, schema)
    )
