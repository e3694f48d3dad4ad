"""Token links, top-k products and the prefix trie against brute force."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import packing, prefix_trie, threshold, token_links

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- 11 token links


def texts():
    rng = random.Random(2)
    letters = "abcde éßñ日本🙂 \n\t.,!0123"
    out = [None, "", " ", "  two", "ends ", "a", "\n\n\n", "x" * 3000, " " * 500 + "b", "nul\x00byte", "▁", "a▁b c", "a ▁ b", "▁▁ x"]
    out += ["say <|endoftext|> now", "</s> <s> <unk> <0x41>", "é combining", "　wide   blanks", "don't it's 12345 67", "﻿mark", "a\r\nb", "word " * 2000]
    out += ["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(60)]
    out += [" ".join(rng.choices(["the", "cat", "Sat,", "on", "naïve", "mat.", "Über"], k=rng.randint(1, 40))) for _ in range(40)]
    return [*out, out[20], out[20]]


def libraries():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    letters = {chr(c): b for b, c in packing.byte_letters().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def a_byte(token):
        return bytes(letters[c] for c in token)

    def b_byte(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        return list(zip(x.ids, map(a_byte, x.tokens), strict=True)), [(i, b_byte(i)) for i in y]

    return both


def linked(x, y):
    """Groups by the offsets at which both sides end a token."""
    ends, groups = [], []
    for side in (x, y):
        at, found = 0, []
        for _, b in side:
            at += len(b)
            found.append(at)
        ends.append(found)
    i = j = 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append(([t for t, _ in x[i:p]], [t for t, _ in y[j:q]]))
        i, j = p, q
    return groups


def expected_links(bodies):
    both, found = libraries(), []
    for text in bodies:
        x, y = both(text) if text else ([], [])
        body = (" " + (text or "")).encode()
        fits = bool(text) and b"".join(b for _, b in x) == body == b"".join(b for _, b in y)
        found.append((len(x), len(y), linked(x, y)) if fits else (0, 0, []))
    counts = Counter(p for _, _, groups in found for p in {(a, b) for x, y in groups for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for n_a, n_b, groups in found:
        pairs = [(a, b) for x, y in groups for a in x for b in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(pairs), digest, sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_links_against_the_libraries(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(token_links, "WIDE", 2)
    bodies = texts()
    rows = [(i if i % 7 else None, t, i, "x") for i, t in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, pair string").repartition(3 if small else 1)
    got = token_links.align(df, BPE, public_tokenizers.PATTERN, PIECES).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *e) for r, e in zip(rows, expected_links(bodies), strict=True))


def test_links_in_many_blocks_and_wide_groups():
    """In-process: blocks of every size add up, groups folded or not."""
    both = token_links.Tokenizers(BPE, public_tokenizers.PATTERN, PIECES)
    bodies = [t for t in texts() if t]
    ids = both.ids_of(bodies)
    whole = token_links.align_block(ids, both.sides)
    for at, x in enumerate(ids):
        facts, distinct, held, each = token_links.align_block([None, x], both.sides)
        assert facts[1] == whole[0][at] and facts[0] == (0, 0, 0, 0, "")
        mine = dict(zip(distinct[each[1][0]].tolist(), each[1][1].tolist(), strict=True))
        assert mine == dict(zip(whole[1][whole[3][at][0]].tolist(), whole[3][at][1].tolist(), strict=True))
        assert set(held.tolist()) <= {1}


def test_links_of_hash_collisions(monkeypatch):
    """Windows are told apart by their ids, whatever their hashes."""
    both = token_links.Tokenizers(BPE, public_tokenizers.PATTERN, PIECES)
    ids = both.ids_of([t for t in texts() if t])
    right = token_links.align_block(ids, both.sides)[0]
    monkeypatch.setattr(token_links, "mixed", lambda ids, begin, length, salt: (length % 2).astype("u8"))
    assert token_links.align_block(ids, both.sides)[0] == right


def test_links_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = token_links.align(empty, BPE, public_tokenizers.PATTERN, PIECES)
    assert out.collect() == [] and out.columns[0] == "doc_id"


def test_packed_ids_are_the_library_s_defaults():
    """A text's added tokens have ids of their own."""
    library = Tokenizer.from_file(BPE)
    encode = packing.library_ids(BPE, public_tokenizers.PATTERN, 1)
    end = json.load(open(BPE, encoding="utf-8"))["added_tokens"][0]["id"]
    for text in [t for t in texts() if t] + ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y ", "<|endoftext|"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(encode(text)).cast("I")) == [*ids, 1]
        assert (end in ids) == ("<|endoftext|>" in text)


# ---------------------------------------------------------------- 12 top-k products


def vector_rows():
    rng = random.Random(4)
    rows = [(i, [rng.randint(-3, 3) / 256 for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (250, [0.1, None, 0.2, 0.3]), (300, [float("nan"), 0.0, 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(400, [0.0] * 4), (450, [1e9, -1e9, 1e9, 3.0]), (451, [1e9, 1e9, 1e9, 1e9]), (500, [0.5, 0.25]), (501, [0.5, 0.5]), (550, [])]
    rows += [(None, [0.01, 0.01, 0.01, 0.01]), (None, rows[7][1]), rows[50], rows[50], (50, [0.02, 0.0, 0.0, -0.02]), (7, rows[8][1]), (601, [])]
    return rows


def best_products(rows, k):
    whole = []
    for key, v in rows:
        if v is not None and all(x is not None and abs(x) < float("inf") for x in v):
            whole.append((key, tuple(int(256 * x // 1) for x in v)))
    out = []
    for key, v in {r for r in whole if r[0] is not None and r[0] % 50 == 0}:
        scored = [(-min(sum(x * y for x, y in zip(v, w, strict=True)), 2**63 - 1), o is None, o or 0) for o, w in whole if o != key and len(w) == len(v)]
        out += [(key, rank, None if none else o, -s) for rank, (s, none, o) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize(("shard", "block", "k"), [(8192, 2048, 5), (16, 3, 5), (16, 100, 1), (50, 2, 200)])
def test_products_against_all_pairs(spark, shard, block, k, monkeypatch):
    monkeypatch.setattr(threshold, "SHARD_ROWS", shard)
    monkeypatch.setattr(threshold, "QUERY_ROWS", block)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<double>, score int, query string").repartition(3)
    whole = df.withColumn("whole", threshold.scaled(F.col("embedding")))
    got = threshold.top_products(whole.where("vec_id % 50 = 0"), whole, "vec_id", "whole", k)
    assert Counter(tuple(r) for r in got.collect()) == Counter(best_products(rows, k))


def test_products_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, whole array<double>")
    some = spark.createDataFrame([(50, [1.0])], "vec_id long, whole array<double>")
    for queries, held in ((empty, empty), (some, empty), (empty, some), (some, some)):
        out = threshold.top_products(queries, held, "vec_id", "whole")
        assert out.collect() == [] and out.columns == ["query_id", "rank", "vec_id", "score"]


def test_lists_are_read_no_further_than_needed():
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = np.round(rng.exponential(50, (4000, 3)))
    lists = threshold.Lists.of(vectors)
    best, read = lists.top(np.array([3.0, 1.0, 2.0]), 5, (0, 0), threshold.LOWEST)
    assert read < 3 * 4000 / 5
    _, again = lists.top(np.array([3.0, 1.0, 2.0]), 5, (0, 0), best[0][0] + 10**6)
    assert again == 3


# ---------------------------------------------------------------- 13 prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, len(text.encode())))
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        whole[c] = [t[2:] for t in sorted(turns.get(base, []))[:h] + sorted(turns[c])[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(x for x, _ in s[:d])].append(c)
        ends[tuple(x for x, _ in s)].append(c)
    size = {tuple(x for x, _ in s[: d + 1]): s[d][1] for s in whole.values() for d in range(len(s))}
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * size.get(k, 0)
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def conversation_rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(-12, 90), 4000, 10**15, 10**15 + 1]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", rng.choice(["hi", "yes", "é"]) if t < 2 else f"t{rng.randrange(3)}"))
    rows += [(90, t, "user", f"long {t % 7}") for t in range(300)] + [(95, t, "user", f"long {t % 7}") for t in range(290)]
    rows += [(91, None, None, None), (91, None, "user", None), (91, 0, "user", "hi"), (91, 0, "user", "hi"), (91, 0, "user", "a"), (92, 5, "a", "b")]
    rows += [(93, 1, "user", "same")] * 20 + [(None, 0, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_brute_force(spark, small, monkeypatch):
    if small:
        for name, value in (("RANGE_ROWS", 60), ("BLOCK_ARCS", 150), ("DEPTHS", 16), ("ENDS", 2)):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(4)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []


def test_any_list_is_ranked(spark, monkeypatch):
    """Neighbours in the list have names far apart, so blocks contract nothing and coins must."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ARCS", 50)
    names = list(range(400))
    random.Random(1).shuffle(names)
    rows = [(n, 0, *((names[i + 1], 0) if i + 1 < len(names) else (None, None)), 1, i, 2 * i) for i, n in enumerate(names)]
    items = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in prefix_trie.ITEM))
    found = {r.conv: (r.before_arcs, r.before_leaves, r.before_saved) for r in prefix_trie.list_ranked(items).collect()}
    assert found == {n: (i, i * (i - 1) // 2, i * (i - 1)) for i, n in enumerate(names)}
