"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    backoff,
    chat,
    hash_ring,
    licenses,
    line_align,
    order_minhash,
    packing,
    prefix_bpe,
    prefix_trie,
    repetition,
    simhash,
    threshold,
    token_links,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_hash_ring")
def op1(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = hash_ring.ring_shards(docs, F.col("doc_id"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


@query("op2_order_minhash")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = {"numbers": order_minhash.signature(F.col("text"))}
    docs = order_minhash.with_next(docs, "doc_id", ["text"], F.xxhash64("text"), ranges, numbers)
    docs = docs.withColumn("edited", order_minhash.edited(F.col("text"), F.col("next_text")))
    docs = docs.withColumn("edited_numbers", order_minhash.signature(F.col("edited")))
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        order_minhash.shown(F.col("numbers")).alias("fingerprint"),
        order_minhash.shown(F.col("edited_numbers")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("numbers"), F.col("edited_numbers")).alias("near_edited"),
        order_minhash.likeness(F.col("numbers"), F.col("next_numbers")).alias("near_next"),
    )


@query("op3_simhash_trees")
def op3(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_line_align")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines")
    shorter = line_align.dedupe_lines(docs.select("doc_id", lines, "text"))
    return shorter.select(
        "doc_id",
        "n_lines",
        "n_removed",
        "removed_words",
        "aligned_with",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op6_repetition")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", repetition.repetition(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("op7_prefix_bpe")
def op7(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, folder, "documents")
    return prefix_bpe.encode_table(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_binary_packing")
def op9(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


@query("op4_license_dice", licenses.oracle())
def op4(spark, folder):
    docs = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("license_matches", lambda m: m.license)))
    return docs.select("doc_id", F.array_max("license_matches").alias("best"), "license_matches").select(
        "doc_id",
        F.col("best.license").alias("license"),
        F.col("best.similarity").alias("similarity"),
        F.col("best.unit").alias("unit"),
        F.size("license_matches").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
    )


_SAID = "\\### Assistant: </turn> ok"
_TURNS = f"""
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')
"""
_ESCAPED = "replace(replace(replace({c}, '\\', '\\b'), '### ', '\\h'), '</turn>', '\\t')"


@query(
    "op8_chat_events",
    f"""
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(14 + length(replace({_ESCAPED.format(c="role")}, ':', '\\c')) + length({_ESCAPED.format(c="text")}))::BIGINT AS formatted_chars
    FROM ({_TURNS}) GROUP BY conv_id
    """,
)
def op8(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], rows.schema)
    formatted = chat.format_log(chat.conversation_events(rows.unionByName(planted)))
    turn = F.struct("number", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("shown"), "loss_text")
    turns = chat.read_back(formatted).groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    said = F.array_join(F.filter(F.transform("turns", lambda t: t.loss_text), lambda t: t.isNotNull()), "")
    digests = turns.select(
        F.col("conv").alias("of"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: t.shown), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
    )
    lengths = formatted.select(F.col("conv").alias("conv_id"), F.length("formatted").cast("long").alias("formatted_chars"))
    return lengths.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@query("op10_backoff_automaton")
def op10(spark, folder):
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return backoff.score(table(spark, folder, "documents"), remainder != 0)


@query("op11_anchor_windows")
def op11(spark, folder):
    path = public_tokenizers.path
    docs = table(spark, folder, "documents")
    return token_links.align(docs, path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


@query(
    "op12_threshold_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
    """,
)
def op12(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", threshold.scaled(F.col("embedding")).alias("whole"))
    return threshold.top_products(vectors.where(F.col("vec_id") % 50 == 0), vectors, "vec_id", "whole")


# crc32 bit by bit, for the ids' digits
_CRC = """xor(4294967295, list_reduce(
  list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substring(conv_id::VARCHAR, i::INT, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT))"""


@query(
    "op13_prefix_trie",
    f"""
    WITH turns AS (
      SELECT conv_id, sha256(strlen(r) || ':' || r || t) AS digest, strlen(t) AS bytes,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS place
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
    ), convs AS (
      SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
    ), rebuilt AS (
      SELECT c.conv_id, 0 AS part, place, digest, bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND place <= h
      UNION ALL SELECT c.conv_id, 1, place, digest, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h
    ), whole AS (
      SELECT conv_id, coalesce(list(digest ORDER BY part, place) FILTER (digest IS NOT NULL), []) AS s,
        coalesce(list(bytes ORDER BY part, place) FILTER (digest IS NOT NULL), []) AS b
      FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
    ), prefixes AS (
      SELECT conv_id, depth, array_to_string(s[1:depth], ' ') AS key, array_to_string(s[1:depth - 1], ' ') AS above,
        CASE WHEN depth > 0 THEN b[depth] ELSE 0 END AS bytes, depth = len(s) AS ends
      FROM (SELECT *, unnest(range(len(s) + 1)) AS depth FROM whole)
    ), nodes AS (
      SELECT depth, key, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM prefixes GROUP BY depth, key
    ), linked AS (
      SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.above = n.key) AS n_children
      FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.above
    ), below AS (
      SELECT a.depth, a.key, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
      FROM linked n JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.key
    )
    SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM linked JOIN below USING (depth, key)
    """,
)
def op13(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
