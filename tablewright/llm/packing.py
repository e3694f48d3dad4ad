"""Packing by power-of-two decomposition.

A document of n tokens is cut along the binary digits of n: as many pieces of ``limit`` tokens as
fit, then one piece for every binary digit of the rest, the longest first. Each piece is a
sequence of its own. Sequences of one length form a bucket that a trainer batches alone, so no
sequence crosses documents and nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.chunks import KEPT_CHARS, KEPT_CHUNKS, ChunkIds
from tablewright.llm.store import written

LIMIT = 2048


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; ``limit`` is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def model_ids(path: str, pattern: str) -> Callable[[str], bytes]:
    """From texts to packed ids by the BPE model of a tokenizers file; special tokens in a text are ordinary text.

    ``pattern`` cuts a text into the matches that the model encodes. The library's own call per
    text also makes offsets, which takes several times as long.
    """
    from tokenizers import Tokenizer

    model, matches, letters = Tokenizer.from_file(path).model, regex.compile(pattern), byte_letters()
    known: dict[str, bytes] = {}

    def encode(chunk: str) -> bytes:
        out = b""
        for piece in matches.findall(chunk):
            ids = known.get(piece)
            if ids is None:
                ids = array("I", [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))]).tobytes()
                if len(piece) <= KEPT_CHARS:
                    if len(known) >= KEPT_CHUNKS:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    return encode


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizers file turns into an id of their own wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def library_ids(path: str, pattern: str, end_id: int) -> Callable[[str], bytes]:
    """From texts to packed ids as the tokenizers library gives them by default, and ``end_id`` behind each.

    A text is split at the file's added tokens first; each has its own id.
    """
    chunked = ChunkIds(model_ids(path, pattern))
    end = np.array([end_id], "<u4").tobytes()
    added = {t: np.array([i], "<u4").tobytes() for t, i in added_tokens(path).items()}
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(text: str) -> bytes:
        if split is None or not split.search(text):
            return chunked.ids_of(text) + end
        return b"".join(added[p] if p in added else chunked.ids_of(p) for p in split.split(text) if p) + end

    return encode


def pack(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the key, ``start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket``.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library on every machine, ``pattern`` its
    matches. Every document ends with ``end_id``; a null text is empty and gives that one token. ``sequence_id`` is gapless, bucket
    after bucket; ``bucket`` is the length. ``with_ids`` adds the ids (little-endian, 32 bits).
    Repeated rows are packed once each, null keys too, other columns are ignored, and an empty
    table gives no rows. Texts are tokenised once: the pieces are numbered within their task,
    written, and the tasks' counts per bucket (a few numbers a task) give the numbers' starts.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "number")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    names = schema.names

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = library_ids(tokenizer, pattern, end_id), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                owner, rows = [], []
                for k, body in enumerate(some.column(1).to_pylist()):
                    ids = encode(body or "")
                    start, total = 0, len(ids) // 4
                    for n in binary_lengths(total, limit):
                        piece = ids[4 * start : 4 * (start + n)]
                        number = made.get(n, 0)
                        made[n] = number + 1
                        owner.append(k)
                        rows.append((start, n, zlib.crc32(piece), total, part, number, *([piece] if with_ids else [])))
                        start += n
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), *columns], names=names)

    kept = written(docs.select(key, text).mapInArrow(pieces, schema), "pieces")
    counts = kept.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_pack_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    per_bucket = counts.groupBy("length").agg(F.sum("_pack_n").alias("_pack_all"))
    base = per_bucket.select("length", F.coalesce(F.sum("_pack_all").over(shorter), F.lit(0)).alias("_pack_base"))
    starts = counts.select("length", "part", F.coalesce(F.sum("_pack_n").over(before), F.lit(0)).alias("_pack_from")).join(base, "length")
    sequence = (F.col("_pack_base") + F.col("_pack_from") + F.col("number")).alias("sequence_id")
    ids = [F.col("ids")] if with_ids else []
    return kept.join(starts, ["length", "part"]).select(
        key, "start", "length", "ids_crc32", "doc_tokens", sequence, F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), *ids
    )
