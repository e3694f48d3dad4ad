"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is one token that a valid encoding of it can end with. The
table of these last tokens is the whole state: walking it backwards gives the ids, appending
bytes extends it exactly, and after an edit it is computed anew from the edit until it runs along
the old table again. The tokens that a prefix can end with come from an automaton over the
vocabulary, one step a byte, longest first.

Two neighbouring tokens are valid if their joined bytes encode to just these two; an encoding is
the BPE encoding if and only if all neighbours are valid.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.chunks import KEPT_CHARS, ChunkIds

KEPT_PAIRS, KEPT_PIECES, KEPT_STEPS = 500_000, 400_000, 1_500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by bytes from a file with a base-64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixTable:
    """Ranks with the memory of valid neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.valid: dict[int, bool] = {}
        self.spines: dict[int, list[tuple[int, bytes]]] = {}
        self._automaton()

    def _automaton(self) -> None:
        """States are beginnings of tokens: the longest one that the bytes so far end with.

        ``steps`` holds a state and a byte and leads on; steps that fall back to shorter
        beginnings are added when met, up to ``KEPT_STEPS``. ``ends`` is the longest token that a
        state ends with, ``shorter`` the next one that a token ends with; -1 is none.
        """
        self.steps: dict[int, int] = {}
        own, depth = [-1], [0]
        for token, rank in self.ranks.items():
            at = 0
            for b in token:
                to = self.steps.get(at << 8 | b)
                if to is None:
                    to = self.steps[at << 8 | b] = len(own)
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            own[at] = rank
        self.back = [0] * len(own)
        self.ends, self.shorter = own[:], {}
        edges = sorted(self.steps.items(), key=lambda e: depth[e[1]])
        for key, to in edges:
            at, b = key >> 8, key & 255
            if at:
                self.back[to] = self.step(self.back[at], b, False)
            behind = self.ends[self.back[to]]
            if own[to] >= 0:
                self.shorter[own[to]] = behind
            else:
                self.ends[to] = behind

    def step(self, state: int, b: int, keep: bool = True) -> int:
        to, at = self.steps.get(state << 8 | b), state
        while to is None and at:
            at = self.back[at]
            to = self.steps.get(at << 8 | b)
        to = to or 0
        if keep and at != state and len(self.steps) < KEPT_STEPS:
            self.steps[state << 8 | b] = to
        return to

    def state_of(self, data: bytes) -> int:
        """The state after some bytes; the last ones decide."""
        state = 0
        for b in data[-self.longest :] if self.longest else b"":
            state = self.step(state, b)
        return state

    def merged(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """Ids by merging the lowest rank first, ranks from ``below`` on left out; only for the few bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[tuple[int, bytes]]:
        """A token and its outermost parts on one side (0 left, 1 right), smallest first; none if no merges lead to the token."""
        known = self.spines.get(2 * token + side)
        if known is None:
            data = self.bytes_of[token]
            parts = self.merged(data, token) if len(data) > 1 else []
            if len(parts) > 2 or len(parts) == 2 and not self.spine(parts[side], side):
                known = []
            else:
                known = [*(self.spine(parts[side], side) if parts else []), (token, data)]
            self.spines[2 * token + side] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; -1 as ``left`` is the beginning.

        Merges happen in the order of their ranks. On both sides of the border the parts grow
        along the tokens' spines; the neighbours are valid if no merge across the border comes
        before the next one inside. Equal ranks go from left to right.
        """
        pair = left << 32 | right
        known = self.valid.get(pair)
        if known is None:
            if len(self.valid) > KEPT_PAIRS:
                self.valid.clear()
            ours, theirs = self.spine(left, 1) if left >= 0 else [], self.spine(right, 0)
            known, i, j, never = bool(theirs), 0, 0, 1 << 62
            while known and left >= 0:
                grows = ours[i + 1][0] if i + 1 < len(ours) else never
                follows = theirs[j + 1][0] if j + 1 < len(theirs) else never
                across = self.ranks.get(ours[i][1] + theirs[j][1], never)
                known = not (across < grows and across <= follows and across < never)
                if grows == follows == never:
                    break
                i, j = (i + 1, j) if grows <= follows else (i, j + 1)
            self.valid[pair] = known
        return known

    def last_tokens(self, data: bytes, last: list[int], state: int) -> int:
        """Append to ``last`` the one valid last token of each prefix that a byte of ``data`` ends; the state after it.

        ``last`` has those of all shorter prefixes, ``state`` is that of the bytes before.
        """
        steps, ends, size, shorter, valid, end = self.steps, self.ends, self.size, self.shorter, self.valid, len(last)
        for b in data:
            to = steps.get(state << 8 | b)
            state = self.step(state, b) if to is None else to
            token = ends[state]
            while token >= 0:
                left = last[end - size[token]]
                fits = valid.get(left << 32 | token)
                if fits or fits is None and self.fits(left, token):
                    break
                token = shorter[token]
            else:
                raise ValueError("a byte of the text is not in the vocabulary")
            last.append(token)
            end += 1
        return state

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixEncoding(self, data).ids()


class PrefixEncoding:
    """The last tokens of all prefixes of one piece; ``last[0]`` is -1."""

    def __init__(self, table: PrefixTable, data: bytes = b""):
        self.table, self.data, self.last, self.state = table, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing before is computed again."""
        self.data += more
        self.state = self.table.last_tokens(more, self.last, self.state)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` for ``data[begin:end]``; returns how many prefixes were computed."""
        old, shift = self.last, len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        self.last = old[: begin + 1]
        alike, at, state = 0, begin + 1, self.table.state_of(self.data[max(0, begin - self.table.longest) : begin])
        # the table runs along the old one once it has agreed for as long as a token can reach back
        while at <= len(self.data) and alike < self.table.longest:
            state = self.table.last_tokens(self.data[at - 1 : at], self.last, state)
            alike = alike + 1 if at - shift > end and self.last[at] == old[at - shift] else 0
            at += 1
        done = at - begin - 1
        self.last += old[at - shift :]
        self.state = self.table.state_of(self.data)
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        last, size = self.last, self.table.size
        while end:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]


@cache
def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """From texts to ids (little-endian, 32 bits); recurring pieces are looked up in a bounded memory.

    There is one for each Python worker, whose tasks share what it remembers.
    """
    table, matches, known = PrefixTable(load_ranks(path)), regex.compile(pattern), {}

    def chunk_ids(chunk: str) -> bytes:
        out = b""
        for piece in matches.findall(chunk):
            ids = known.get(piece)
            if ids is None:
                ids = array("I", table.encode(piece.encode())).tobytes()
                if len(piece) <= KEPT_CHARS:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    return ChunkIds(chunk_ids).ids_of


@cache
def decoder(path: str) -> Callable[[bytes], bytes]:
    """From ids to bytes."""
    ranks = load_ranks(path)
    token = [b""] * (max(ranks.values(), default=-1) + 1)
    for data, rank in ranks.items():
        token[rank] = data
    return lambda ids: b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids (little-endian, 32 bits) of every match of ``pattern`` in a text.

    ``path`` is a file of ranks on every machine. Null and empty texts give no ids. Special
    tokens are ordinary text.
    """

    @F.pandas_udf(T.BinaryType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_of = encoder(path, pattern)
        for texts in batches:
            yield pd.Series([ids_of(t or "") for t in texts], dtype=object)

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes of ids; null gives null."""

    @F.pandas_udf(T.BinaryType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = decoder(path)
        for rows in batches:
            yield pd.Series([None if x is None else bytes_of(x) for x in rows], dtype=object)

    return decoded(ids)


def encode_table(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``ids`` as ``encode`` gives them and ``decoded``, the bytes of these ids.

    Results leave in small batches, so long texts don't add up. Repeated rows and null keys stay.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bytes_of = encoder(path, pattern), decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [ids_of(t or "") for t in some.column(1).to_pylist()]
                columns = [pa.array(ids, pa.binary()), pa.array(map(bytes_of, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=schema.names)

    return docs.select(key, text).mapInArrow(rows, schema)
