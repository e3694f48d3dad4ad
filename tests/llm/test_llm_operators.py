"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import backoff, chat, hash_ring, licenses, line_align, order_minhash, packing, prefix_bpe, repetition, simhash

SCHEMA = "doc_id long, text string, k int, n int, size string, block int"
WORDS = [f"w{i}" for i in range(60)]


def rows():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(30)]
    texts += [None, "", " \n\t", "one", "one two", "two one", "A B c", "a b C", "naïve 日本語 🙂 text", texts[0], texts[1] + " extra", "x" * 3000]
    texts.append("\n".join([texts[2], texts[3], "short", texts[2]]))
    texts.append(" ".join(["again"] * 5000))
    out = [(i, t, 1, None, "s", 7) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, texts[4], None, 2, None, None), (None, None, None, None, None, None), (7, "other text of the same key", 0, 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1 ring


def test_ring_is_even_and_gapless(docs):
    placed = hash_ring.ring_shards(docs, F.col("doc_id"), 4).collect()
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert len(placed) == len(rows())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(repr(tuple(r)[:6]) for r in placed) == Counter(map(repr, rows()))


def test_ring_empty(nothing):
    out = hash_ring.ring_shards(nothing, F.col("doc_id"), 4)
    assert out.collect() == [] and out.columns[-3:] == ["home_shard", "shard", "slot"]


def test_ring_walk_against_one_row_at_a_time():
    """Every row sits at the first point clockwise whose shard has room, given the rows before it."""
    rng = random.Random(5)
    _, owners = hash_ring.ring(5, 8)
    counts = [rng.choice([0, 1, 2, 30]) for _ in owners]
    room = hash_ring.capacities(sum(counts), 5, 0.2)
    placed = hash_ring.walk(counts, owners, room)
    loads, seen = Counter(), defaultdict(list)
    for arc, lo, hi, shard, slot in placed:
        assert slot == loads[shard]
        loads[shard] += hi - lo
        seen[arc] += range(lo, hi)
    assert all(sorted(seen[a]) == list(range(c)) for a, c in enumerate(counts))
    assert all(loads[s] <= room[s] for s in loads)
    for arc, _, _, shard, _ in placed:
        step = next(k for k in range(len(owners)) if owners[(arc + k) % len(owners)] == shard)
        assert all(loads[owners[(arc + k) % len(owners)]] == room[owners[(arc + k) % len(owners)]] for k in range(step))


def test_ring_moves_few_rows(spark):
    many = spark.range(6000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in hash_ring.ring_shards(many, F.col("doc_id"), 8, slack=0.3).collect()}
    after = {r.doc_id: r.shard for r in hash_ring.ring_shards(many, F.col("doc_id"), 9, slack=0.3).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.3 * len(before)


def test_ring_full_shards():
    with pytest.raises(ValueError):
        hash_ring.walk([5], [0], [4])


# ---------------------------------------------------------------- 2 order minhash


def by_hand(text, k=5, size=2, orders=32):
    """Selected k-mers of every order, with hashes computed by Spark's own function elsewhere."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return []
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)]
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def test_elements_are_numbered(docs):
    found = docs.select("text", order_minhash.elements(order_minhash.kmers(F.coalesce("text", F.lit("")))).alias("e")).collect()
    for r in found:
        expected = by_hand(r.text)
        places = sorted(x & (1 << 28) - 1 for x in r.e)
        assert places == list(range(len(expected)))
        assert len({x >> 28 for x in r.e}) == len(set(expected))
        assert r.e == sorted(r.e)


def test_signature_selects_minimal_in_text_order(docs):
    found = docs.select("text", order_minhash.elements(order_minhash.kmers(F.coalesce("text", F.lit("")))).alias("e"), order_minhash.signature(F.col("text")).alias("s"))
    spark = docs.sparkSession
    tuples, keys = [], []
    for n, r in enumerate(found.collect()):
        assert len(r.s) == (32 if r.e else 0)
        for j in range(-16, 16):
            if r.e:
                ahead = sorted(r.e, key=lambda x: (x >> 59 < j, x))[:2]
                tuples.append((n, j, [x >> 28 for x in sorted(ahead, key=lambda x: x & (1 << 28) - 1)]))
                keys.append(r.s[j + 16])
    hashed = spark.createDataFrame(tuples, "n int, j int, t array<long>").select("n", "j", F.xxhash64("t").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
    assert [r.h for r in hashed.orderBy("n", "j").collect()] == keys


def test_order_matters_and_equal_texts_agree(spark):
    a = " ".join(WORDS)
    b = " ".join(WORDS[30:] + WORDS[:30])
    c = " ".join(WORDS[:59] + ["new"])
    df = spark.createDataFrame([(a, a, b, c, None, "  ")], "a string, a2 string, b string, c string, z string, e string")
    s = {x: order_minhash.signature(F.col(x)) for x in df.columns}
    r = df.select(*[order_minhash.likeness(s[x], s[y]).alias(x + y) for x, y in (("a", "a2"), ("a", "b"), ("a", "c"), ("z", "e"), ("a", "z"))]).first()
    assert r.aa2 == 1 and r.ze == 1 and r.az == 0 and r.ac > r.ab > 0


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_next_row(docs, nothing, ranges):
    tie = F.xxhash64("text", "k")
    out = order_minhash.with_next(docs, "doc_id", ["text"], tie, ranges)
    ordered = docs.select("*", tie.alias("tie")).orderBy(F.desc_nulls_last("doc_id"), F.desc("tie")).collect()
    expected = Counter((r.doc_id, r.text, ordered[(i + 1) % len(ordered)].text) for i, r in enumerate(ordered))
    assert Counter((r.doc_id, r.text, r.next_text) for r in out.collect()) == expected
    assert order_minhash.with_next(nothing, "doc_id", ["text"], tie, ranges).collect() == []
    assert order_minhash.with_next(docs.where("doc_id = 3"), "doc_id", ["text"], tie, ranges).first().next_text == rows()[3][1]


# ---------------------------------------------------------------- 3 simhash


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, prints):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(keys)):
        least[find(i)].append(keys[i])
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(keys))]


def test_simhash_against_all_pairs(docs, nothing):
    out = simhash.near_duplicates(docs)
    expected = [fingerprint(r[1]) for r in rows()]
    named = groups([r[0] for r in rows()], expected)
    assert Counter(tuple(r) for r in out.collect()) == Counter((r[0], f"{p:016x}", g) for r, p, g in zip(rows(), expected, named, strict=True))
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("leaf", [8, 10000])
def test_trees_find_every_pair(spark, leaf, monkeypatch):
    """Chains, dense clusters and far points; shards so small that the trees are deep and blocks split."""
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(simhash, "BLOCK_QUERIES", 32)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(400)]
    for center in prints[:6]:
        chain = center
        for _ in range(25):
            chain ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.append(chain)
    prints += [prints[7] ^ (1 << b) for b in range(64)] + prints[:10]
    keys = list(range(len(prints)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame(list(zip(keys, signed, strict=True)), "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.near_groups(table, "doc_id", leaf=leaf).collect()}
    assert [found[k] for k in keys] == groups(keys, prints)


def test_drop_near_duplicates_keeps_one(docs):
    kept = simhash.drop_near_duplicates(docs)
    prints = [fingerprint(r[1]) for r in rows()]
    places = groups(list(range(len(prints))), prints)
    named = groups([r[0] for r in rows()], prints)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict(zip(places, named, strict=True)).values())


# ---------------------------------------------------------------- 4 licences


def test_licenses(spark, docs, nothing):
    mit = licenses.TEMPLATES[7][1]
    texts = [mit, "code\n\nLICENSED under the Apache license, version 2.0!\nmore", "Released under the MIT License", "nothing here", None, "", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(m) for m in r.license_matches] for r in licenses.scan(df).collect()}
    assert found[0] == [(1.0, "MIT", "document")] and found[2] == [(1.0, "MIT", "document")]
    assert max(found[1]) == (1.0, "Apache-2.0", "line")
    assert all(found[i] == [] for i in (3, 4, 5, 6))
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).collect() == []


def test_licenses_against_all_templates(spark):
    """Pruning by size loses no match."""
    rng = random.Random(1)
    words = "licensed under the mit license version 2 0 apache work is this".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in licenses.scan(df, threshold=0.6).collect():
        w = r.text.split()
        mine = set(zip(w, w[1:], strict=False))
        best = None
        for name, body in licenses.TEMPLATES:
            other = {tuple(b.split()) for b in licenses.template_bigrams(body)}
            dice = 2.0 * len(mine & other) / (len(mine) + len(other))
            if dice >= 0.6 and mine:
                best = max(best or (0.0, ""), (dice, name))
        assert [tuple(m)[:2] for m in r.license_matches] == ([best] if best else [])


# ---------------------------------------------------------------- 5 lines

A, B, C, D = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")


def shorten(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in line_align.dedupe_lines(df).collect()}


def test_later_documents_lose_common_blocks(spark):
    out = shorten(spark, [f"{A}\n{B}\nyes", f"{C}\n{A}\n{B}\nyes\nown", f"yes\n{D}", f"{A}\n{B}\nyes", None, "", f"\n\n{D}\n\n{D} "])
    assert out[0].text == f"{A}\n{B}\nyes" and out[0].n_removed == 0 and out[0].aligned_with == []
    assert out[1].text == f"{C}\nown" and out[1].n_removed == 3 and out[1].aligned_with == [0]
    assert out[2].text == f"yes\n{D}"  # one short line is no block
    assert out[3].text == "" and out[4].text is None and out[5].text == ""
    assert out[6].text == f"\n\n\n{D} " and out[6].aligned_with == [2]  # its second copy is the first of that number


def test_crossing_lines_stay(spark):
    out = shorten(spark, [f"{A}\n{B}\n{C}", f"{C}\n{A}\n{B}"])
    assert out[1].text == C


def test_alignment_against_exhaustive_search():
    rng = random.Random(2)
    for _ in range(200):
        values = rng.sample(range(12), rng.randint(0, 9))
        best = max((s for s in _subsets(values) if all(a < b for a, b in zip(s, s[1:], strict=False))), key=len, default=[])
        found = [values[i] for i in line_align.longest_rising(values)]
        assert len(found) == len(best) and found == sorted(found)


def _subsets(values):
    out = [[]]
    for v in values:
        out += [s + [v] for s in out]
    return out


def test_lines_of_any_rows(docs, nothing):
    out = line_align.dedupe_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    same = out.where("doc_id = 5").select("text").distinct()
    assert same.count() == 1  # repeated rows are edited alike
    assert line_align.dedupe_lines(nothing).collect() == []


# ---------------------------------------------------------------- 6 repetition


def windows_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = {}
    for n in range(5, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        twice = Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(n)}
        out[n] = (len(hit), sum(len(words[i]) for i in hit))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return words, out, len(lines) - len(set(lines))


def test_repetition_against_counting(docs, nothing):
    out = docs.select("doc_id", "text", repetition.repetition(F.col("text")).alias("m")).select("doc_id", "text", "m.*")
    for r in out.collect():
        words, grams, lines = windows_by_hand(r.text)
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and r.n_dup_lines == lines
        assert r.n_repeat_words == grams[5][0]
        assert [r[f"chars_{n}gram"] for n in range(5, 11)] == [grams[n][1] for n in range(5, 11)]
        assert r.base_failed == (len(words) < 10 or 100 * grams[5][0] > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert nothing.select(repetition.repetition(F.col("text"))).collect() == []


def test_symbols_and_lines(spark):
    text = "\n".join([A, "# * $ % & | < >", A, B, A])
    m = spark.createDataFrame([(text,)], "text string").select(repetition.repetition(F.col("text")).alias("m")).first().m
    assert m.n_symbols == 8 and m.n_dup_lines == 2 and m.line_chars == 2 * len(A.replace(" ", "")) and not m.kept


# ---------------------------------------------------------------- 7 prefix BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  a  b", "a\n b \n\n c", " x  y", "don't I'll 'S", "x" * 700, "日本語テキスト" * 30, "🙂🙃 é", "a\x1cb \x85 c", "1234 56.78%", "\t\tif (x):\r\n"]


@pytest.fixture(scope="module")
def prefix_table():
    return prefix_bpe.PrefixTable(prefix_bpe.load_ranks(RANKS))


def test_encoding_is_that_of_the_library(docs, nothing, prefix_table):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_table.ranks, special_tokens={})
    odd = docs.sparkSession.createDataFrame([(t,) for t in [*ODD, *(r[1] for r in rows())]], "text string")
    ids = odd.withColumn("ids", prefix_bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN))
    for r in ids.withColumn("back", prefix_bpe.decode(F.col("ids"), RANKS)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    assert nothing.select(prefix_bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN)).collect() == []


def test_appends_and_edits_are_exact(prefix_table):
    rng = random.Random(4)
    for _ in range(60):
        data = "".join(rng.choices(["the", "ing", "tion", "x", "qu", "é", " ", "zz"], k=200)).encode()
        cut = rng.randrange(len(data))
        grown = prefix_bpe.PrefixEncoding(prefix_table, data[:cut])
        grown.append(data[cut:])
        fresh = prefix_bpe.PrefixEncoding(prefix_table, data)
        assert grown.ids() == fresh.ids() == prefix_table.merged(data)
        begin = rng.randrange(len(data))
        end, new = min(len(data), begin + rng.randrange(6)), b"tion"[: rng.randrange(5)]
        fresh.replace(begin, end, new)
        assert fresh.data == data[:begin] + new + data[end:]
        assert fresh.ids() == prefix_table.merged(fresh.data)


def test_an_edit_is_local(prefix_table):
    long = prefix_bpe.PrefixEncoding(prefix_table, b"nation" * 3000)
    assert long.replace(60, 61, b"x") < 1000


# ---------------------------------------------------------------- 8 chat

LOG = "conv long, seq long, message long, kind string, role string, body string"


def test_fold_and_read_back(spark):
    said = "\\### Assistant: </turn> ok"
    log = [
        (1, 5, 2, "delta", None, "wor"), (1, 3, 2, "open", "assistant", None), (1, 1, 1, "open", "us:er", None), (1, 2, 1, "delta", None, said),
        (1, 6, 2, "delta", None, "ld"), (1, 4, 2, "delta", None, "draft"), (1, 6, 2, "delta", None, "ld"), (2, 1, 1, "open", "assistant", None),
        (2, 2, 1, "delta", None, "a"), (2, 3, 1, "edit", None, said), (2, 4, 1, "delta", None, "\n"), (2, 9, 2, "open", "user", None),
        (2, 10, 2, "drop", None, None), (None, 1, 1, "delta", None, None), (1, 7, 3, "open", "assistant", None), (1, 8, 3, "delta", None, "old"),
        (1, 9, 3, "retry", None, None), (1, 10, 3, "delta", None, "</turn>\n### x: "),
    ]
    log = [x if x[1] != 4 or x[0] != 1 else (*x[:5], "hello ") for x in log]
    formatted = chat.format_log(spark.createDataFrame(log, LOG).repartition(5))
    found = defaultdict(list)
    for r in chat.read_back(formatted).orderBy("number").collect():
        found[r.conv].append((r.role, r.text, r.loss_text))
    assert found == {
        1: [("us:er", said, None), ("assistant", "hello world", "hello world"), ("assistant", "</turn>\n### x: ", "</turn>\n### x: ")],
        2: [("assistant", said + "\n", said + "\n")],
        None: [("", "", None)],
    }
    for r in formatted.collect():
        for span in r.loss_spans:
            assert chat.END not in r.formatted[span.start : span.start + span.length]


def test_conversations_of_any_rows(spark):
    table = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", ""), (None, 2, None, "x"), (None, None, "assistant", "y\\b\\"), (3, 5, "system", "s")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_log(chat.conversation_events(df)))
    assert Counter((r.conv, r.role, r.text) for r in back.collect()) == Counter((c, r or "", t or "") for c, _, r, t in table)
    assert chat.format_log(chat.conversation_events(df.limit(0))).collect() == []


@pytest.mark.parametrize("text", ["\\", "\\b", "\\\\h", "### ### ", "#### x", "</turn></turn>\n", "<</turn>", "a: b", "\\### Assistant: </turn> ok"])
def test_escapes_are_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    for codes in (chat.CODES, chat.ROLE_CODES):
        coded = chat.escape(F.col("t"), codes)
        r = df.select(coded.alias("e"), chat.unescape(coded, codes).alias("u")).first()
        assert r.u == text and "</turn>" not in r.e and "### " not in r.e


# ---------------------------------------------------------------- 9 packing


def test_binary_lengths():
    for n in range(0, 5000, 7):
        parts = packing.binary_lengths(n, 256)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 256 for p in parts)
        assert parts == sorted(parts, reverse=True) and max(Counter(p for p in parts if p < 256).values(), default=1) == 1


def test_packing_against_the_library(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = [(100 + i, t) for i, t in enumerate([*ODD, "<|endoftext|> x", "a <|endoftext|> b", "a <|endoftext|>"])]
    both = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    out = packing.pack(both, path, public_tokenizers.PATTERN, limit=64).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert all(r.offset == 0 and r.bucket == r.length and r.length & (r.length - 1) == 0 for r in out)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    in_order = [r.length for r in sorted(out, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order)
    whole = Counter()
    for r in both.collect():
        ids, at = [*library.encode(r.text or "", add_special_tokens=False).ids, 1], 0
        for n in packing.binary_lengths(len(ids), 64):
            whole[(r.doc_id, at, n, len(ids), np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert whole == Counter((r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in out)
    assert packing.pack(nothing, path, public_tokenizers.PATTERN).collect() == []


# ---------------------------------------------------------------- 10 backoff


def scores_by_hand(table, learnt, order, prior):
    """The model's recursion, word by word, over plain dictionaries."""
    def toks(t):
        return [*(t or "").encode().lower().split(), None]

    counts = [Counter() for _ in range(order + 1)]
    for (_, t), train in zip(table, learnt, strict=True):
        if train:
            w = ["<s>", *toks(t)]
            for i in range(1, len(w)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        counts[n][tuple(w[i - n + 1 : i + 1])] += 1
            counts[1][("<s>",)] += 1
    starts = counts[1].pop(("<s>",), 0)
    n, v, once = sum(counts[1].values()), len(counts[1]), sum(c == 1 for c in counts[1].values())
    unknown = (once + 1) / (n + 2)

    def p(history, word):
        if not history:
            c = counts[1][(word,)]
            return c / max(1, n) * (1 - unknown) if c else unknown
        state = starts if history == ("<s>",) else counts[len(history)][history]
        return (counts[len(history) + 1][(*history, word)] + prior * p(history[1:], word)) / (state + prior)

    out = []
    for _, t in table:
        w = ["<s>", *toks(t)]
        score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        base = sum(math.log10((counts[1][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:])
        out.append((len(w) - 1, sum(counts[1][(x,)] > 0 for x in w[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_the_recursion(spark, order, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 500)
    monkeypatch.setattr(backoff, "RANGE_TOKENS", 40)
    table = [(r[0], r[1]) for r in rows()]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    keep = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    learnt = [k is None or k % 3 != 0 for k, _ in table]
    expected = scores_by_hand(table, learnt, order, 5.0)
    found = sorted(backoff.score(df, keep, order=order, prior=5.0).collect(), key=lambda r: (repr(r[0]), r.n_tokens))
    hand = sorted(zip(table, learnt, expected, strict=True), key=lambda x: (repr(x[0][0]), x[2][0]))
    assert len(found) == len(hand)
    for r, ((k, _), train, (n, known, total, base, score)) in zip(found, hand, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k, not train, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_scores_of_empty_tables(nothing, docs):
    assert backoff.score(nothing, F.lit(True)).collect() == []
    untrained = backoff.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (backoff.from_planes(backoff.planes(values)) == values).all() and len(backoff.from_planes(backoff.planes(values[:0]))) == 0


def test_automaton_fails_to_shorter_histories():
    block = backoff.block_grams(backoff.block_row(["a b c", "x b d", "b q"]), 3)
    learnt = np.repeat([True, True, False], block.counts)
    totals = sum(np.bincount(at[learnt & (at >= 0)], minlength=len(block.keys)) for at in block.at).astype(float)
    machine = backoff.weighted(block, totals, (8, 6, 4, 2), 5.0).automaton(0, 8)
    assert len(machine.arcs) == 6 + 8 + 6  # an arc per trained n-gram
    word = dict(zip("a b c . x d q".split(), (block.at[0][i] for i in (0, 1, 2, 3, 4, 6, 9)), strict=True))

    def step(state, w):
        return machine.targets[machine.arcs[state + word[w]]]

    def fall(state):
        return machine.falls[state // machine.size], machine.fall_to[state // machine.size] * machine.size

    after_ab = step(step(machine.start, "a"), "b")
    assert after_ab + word["d"] not in machine.arcs  # "a b" has not gone on to d: the state fails to "b", which has
    weight, after_b = fall(after_ab)
    assert after_b + word["d"] in machine.arcs and math.isclose(weight, math.log10(5 / 6))
    weight, root = fall(after_b)
    assert root == machine.root and math.isclose(weight, math.log10(5 / 7))
    # "q" is unknown from everywhere: the start of a text, then b, then the root
    into_b = fall(machine.start)[0] + machine.weights[machine.arcs[root + word["b"]]]
    after_q = machine.weights[machine.arcs[root + word["."]]]
    assert math.isclose(machine.walk([word["b"], word["q"], word["."]]), into_b + weight + machine.unknown + after_q)


def test_steps_round_trip():
    keys = np.sort(np.array([0, 1, 256, 257, 255, 1 << 63, (1 << 64) - 1, (1 << 64) - 256], np.uint64))
    assert (backoff.from_steps(backoff.steps(keys)) == keys).all() and len(backoff.from_steps(backoff.steps(keys[:0]))) == 0
