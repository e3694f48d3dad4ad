"""The pipeline against plain loops over the smallest documents, and the queries' contracts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from test_llm_operators import windows_by_hand
from test_llm_whole import five_words, gone_lines

import corpus_pipeline
from tablewright.llm import queries, repetition


@pytest.fixture(scope="module")
def raw(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def good(text):
    words, grams, _ = windows_by_hand(text)
    chars, seen, again = sum(map(len, words)), set(), 0
    if len(words) < 10 or 100 * grams[5][0] > 20 * len(words):
        return False
    for line in text.split("\n"):
        if line.split() and line in seen:
            again += sum(map(len, line.split()))
        seen.add(line)
    return again <= repetition.LINE_LIMIT * chars and all(grams[n][1] <= share * chars for n, share in repetition.NGRAM_LIMITS.items())


def without_shared_lines(docs):
    """Documents in order, each aligned with all earlier ones; those left without a word go."""
    keys = sorted(docs)
    out = {}
    for key, (_, gone) in zip(keys, gone_lines([docs[k] for k in keys]), strict=True):
        lines, left, n = docs[key].split("\n"), [], 0
        for x in lines:
            if not x.split() or n not in gone:
                left.append(x)
            n += bool(x.split())
        text = "\n".join(left)
        if text.split() or not gone:
            out[key] = text
    return out


def without_near_copies(docs):
    """The smallest key of each group that five-word Jaccard similarities of 0.8 or more connect."""
    keys = sorted(docs)
    sets, least = [five_words(docs[k]) for k in keys], list(range(len(keys)))
    near = [
        (i, j) for i in least for j in range(i)
        if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]
    while True:
        before = list(least)
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return {k: docs[k] for i, k in enumerate(keys) if least[i] == i}, len(near)


def planted():
    """Texts that tell rules apart: lines shared with later holders only, short lines of several documents, near copies."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("alo", "emi", "irun", "ost", "uve")]

    def line(n):
        return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))

    out = []
    for _ in range(5):
        lines = [line(6) for _ in range(12)]
        out += ["\n".join([*lines[::-1], line(12)]), "\n".join([*lines, line(12)]), "\n".join([line(9), *lines])]
    short = [line(2) for _ in range(6)]
    out += ["\n".join([s, line(15)]) for s in short] + ["\n".join([*short, line(15)]), "\n".join([*short[::2], line(15)])]
    for _ in range(6):
        body = line(70).split()
        for _ in range(5):
            out.append(" ".join(body))
            body[rng.randrange(len(body))] = line(1)
    return out


def test_pipeline_against_loops(spark, raw, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(planted())], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    whole = raw | {10_000 + i: t for i, t in enumerate(planted())}
    kept = {k: t for k, t in whole.items() if good(t)}
    assert sum(k >= 10_000 for k in kept) == len(planted())
    shorter = without_shared_lines(kept)
    assert sum(shorter.get(k) != t for k, t in kept.items()) > 10
    left, pairs = without_near_copies(shorter)
    assert pairs > 20 and len(left) < len(shorter) - 15
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for k, text in left.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for n in [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]:
            expected[k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == expected
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None, None, None, None, 5), (2, "", "en", "s", 0, 5), (3, long, "en", "s", 9, 5), (3, long, "en", "s", 9, 5), (None, long + " x", None, None, 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SMALL).columns == docs.columns
    packed = corpus_pipeline.packing(spark, docs, SMALL).collect()
    assert sum(r.length for r in packed if r.doc_id in (1, 2)) == 2  # the end token of each empty text
    assert corpus_pipeline.packing(spark, docs.limit(0), SMALL).collect() == []
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert Counter(r.doc_id for r in kept.collect()) == {3: 2, None: 1}
    assert corpus_pipeline.near_dedup(spark, docs, SMALL).count() == 2


@pytest.mark.parametrize("number", range(1, 14))
def test_queries_return_their_contract(spark, raw, number):
    names = [n for n in queries.QUERIES if n.startswith(f"op{number}_")]
    out = queries.QUERIES[names[0]](spark, SMALL)
    columns = {
        1: "doc_id size text_crc32 law shard slot grown_shard", 2: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        3: "doc_id fingerprint component_id", 4: "doc_id license", 5: "doc_id n_removed",
        6: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 7: "doc_id n_tokens ids_sha256 decoded_sha256",
        8: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        9: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        10: "doc_id held_out n_tokens n_known train_tokens base_score score",
        11: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        12: "query_id rank vec_id score",
        13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    }[number].split()
    assert set(columns) <= set(out.columns)
    rows = out.collect()
    if number in (1, 2, 3, 4, 5, 6, 7, 10, 11):
        assert sorted(r.doc_id for r in rows) == sorted(raw)
    if number == 2:
        order = sorted(raw, reverse=True)
        for r in rows:
            text, after = raw[r.doc_id], raw[order[(order.index(r.doc_id) + 1) % len(order)]]
            half = len(text) // 2
            assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
            assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert sum(r.near_edited for r in rows) > 2 * sum(r.near_next for r in rows)
    if number == 10:
        held = [r for r in rows if r.held_out]
        assert all(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in held)
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_sql_of_the_queries(spark):
    import duckdb

    from compare import canonical

    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, SMALL)
        found = db.execute(sql)
        assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), [d[0] for d in found.description])


def test_stages_keep_columns_with_clashing_names(spark):
    import corpus_pipeline

    line = "these eight words make one block of text"
    table = [(1, f"{line}\nfirst one has its own last line here", 34, "a", "b", "c"), (2, f"{line}\nanother text", 50, "d", "e", "f"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_chars int, _quality string, n_removed string, keep string")
    judged = corpus_pipeline.quality_rules(spark, docs, "")
    assert judged.columns == docs.columns and all(r._quality in ("a", "d") for r in judged.collect())
    shorter = corpus_pipeline.line_dedup(spark, docs, "")
    assert shorter.columns == docs.columns
    out = {r.doc_id: r for r in shorter.collect()}
    assert out[2].text == "another text" and out[2].n_chars == 12
    assert [(r._quality, r.n_removed, r.keep) for _, r in sorted(out.items())][:2] == [("a", "b", "c"), ("d", "e", "f")]


def test_near_dedup_links_close_fingerprints(spark):
    """Two texts whose repeated phrase settles the fingerprint, though their sets of five-word shingles hardly meet."""
    from tablewright.llm.simhash import simhash

    phrase = "one two three " * 200
    texts = [phrase + " ".join(f"{a}{i}" for i in range(40)) for a in "xy"]
    texts += [texts[1] + " and more", " ".join(f"z{i}" for i in range(60))]
    assert (simhash(texts[0]) ^ simhash(texts[1])).bit_count() <= 3
    a, b = five_words(texts[0]), five_words(texts[1])
    assert 5 * len(a & b) < 4 * len(a | b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3]
