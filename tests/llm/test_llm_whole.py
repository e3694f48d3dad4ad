"""Near copies and common blocks against all pairs."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tablewright.llm import line_align, near_copies


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("crowd", [1, 32])
def test_near_dedup_against_all_pairs(spark, crowd, monkeypatch):
    """Copies with a few words changed, far more than 3 bits apart, in dense groups and chains."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = random.Random(5)
    texts = ["", "  ", "one two", "One  two", "one two three"]
    for g in range(12):
        body = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(body))
            body = list(body)
            for _ in range(rng.randint(0, 3)):
                body[rng.randrange(len(body))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(texts)
    sets = [five_words(t) for t in texts]
    least = list(range(len(texts)))
    near = [(i, j) for i in least for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        before = list(least)
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = corpus_pipeline.near_dedup(spark, df, "")
    assert Counter(r.doc_id for r in found.collect()) == Counter(set(least))


def gone_lines(texts):
    """Of each document its lines with words, and the places among them that alignment with every earlier one deletes."""
    known, out = [], []
    for text in texts:
        found = [(x.rstrip(), len(x.split())) for x in text.split("\n") if x.split()]
        times, seen, lines = Counter(x for x, _ in found), Counter(), []
        for x, w in found:
            lines.append((x, seen[x], times[x] == 1, w))
            seen[x] += 1
        gone = set()
        for other in known:
            shared = [(n, other[x[:2]][0], (x[2] and other[x[:2]][1]) or x[3] >= 8) for n, x in enumerate(lines) if x[:2] in other]
            anchors = [(n, m) for n, m, rare in shared if rare]
            ends = line_align.longest_rising([m for _, m in anchors])
            kept, rest = {anchors[i] for i in ends}, {(n, m) for n, m, _ in shared}
            while near := {x for x in rest - kept if (x[0] - 1, x[1] - 1) in kept or (x[0] + 1, x[1] + 1) in kept}:
                kept |= near
            run, aligned = [], {b for b, _ in kept}
            for n in range(len(lines) + 1):
                if n in aligned:
                    run.append(n)
                else:
                    gone |= set(run) if sum(lines[x][3] for x in run) >= 8 else set()
                    run = []
        known.append({x[:2]: (m, x[2]) for m, x in enumerate(lines)})
        out.append((lines, gone))
    return out


def deleted_by_all(texts):
    """Words left of each document, aligned with every earlier one."""
    return [[x[0] for n, x in enumerate(lines) if n not in gone] for lines, gone in gone_lines(texts)]


def left_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(line_align.dedupe_lines(df).collect(), key=lambda r: r.doc_id)
    return [[x.rstrip() for x in r.text.split("\n") if x.split()] for r in rows]


def test_blocks_with_any_earlier_document(spark):
    """The earliest holder has the lines in reverse; only the second has them in order."""
    lines = [" ".join(f"l{i}w{j}" for j in range(6)) for i in range(12)]
    texts = ["\n".join(lines[::-1]), "\n".join(lines), "\n".join(lines)]
    assert left_of(spark, texts) == [lines[::-1], lines, []]


def test_short_lines_of_two_documents_are_no_block(spark):
    texts = ["In.\nown words", "Licensed under the Apache License, Version 2.0.\nother words", "In.\nLicensed under the Apache License, Version 2.0.\nlast words here"]
    assert left_of(spark, texts) == [t.split("\n") for t in texts]


@pytest.mark.parametrize("draws", [1, 4])
def test_blocks_against_all_earlier_documents(spark, draws, monkeypatch):
    monkeypatch.setattr(line_align, "FIRST_DRAWS", draws)
    rng = random.Random(8)
    pool = [" ".join(f"p{i}w{j}" for j in range(rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(30)]
    texts = []
    for _ in range(150):
        at = rng.randrange(len(pool))
        some = rng.choices(pool, k=rng.randint(1, 5)) + pool[at : at + rng.randint(0, 8)]
        if texts and rng.random() < 0.3:
            some += [x for x in rng.choice(texts).split("\n") if rng.random() < 0.9]
        texts.append("\n".join(some))
    assert left_of(spark, texts) == deleted_by_all(texts)
