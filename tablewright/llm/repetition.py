"""Quality rules on repetition: characters inside duplicated n-grams and lines.

For every n-gram length a rolling hash of the words is compared with itself: all windows whose
hash occurs twice, the first included, cover words, and the covered characters are held against
all characters in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths and the share of characters in words above which a text is rejected.
NGRAM_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
LINE_LIMIT = 0.30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, REPEAT_PERCENT = 10, 20
ROLL = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"chars_{n}gram long" for n in NGRAM_LIMITS)
    + ", line_chars long"
)


def spread(ids: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit codes of small numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * ROLL
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Which words lie in an n-gram that occurs twice or more; None if there is none."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    at = np.flatnonzero(np.isin(hashes, twice))
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The numbers of one text; a null text has no words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    again = [x for x in lines if x in seen or seen.add(x)]
    line_chars = sum(sum(len(w.decode()) for w in x.split()) for x in again)
    chars, repeat_words = dict.fromkeys(NGRAM_LIMITS, 0), 0
    n_words, shortest = len(words), min(NGRAM_LIMITS)
    if n_words > shortest:
        number: dict[bytes, int] = {}
        codes = spread(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words))
        power, rolled = np.uint64(1), np.zeros(n_words, np.uint64)
        lengths = None
        for n in range(1, max(NGRAM_LIMITS) + 1):
            if n_words <= n:
                break
            rolled = rolled[: n_words - n + 1] + codes[n - 1 :] * power
            power = np.uint64(int(power) * int(ROLL) & 0xFFFFFFFFFFFFFFFF)
            if n in NGRAM_LIMITS:
                mask = covered(rolled, n, n_words)
                if mask is None:
                    break  # a longer repeat would hold a shorter one
                if lengths is None:
                    lengths = np.fromiter((len(w.decode()) for w in words), np.int64, n_words)
                chars[n] = int(lengths[mask].sum())
                if n == 5:
                    repeat_words = int(mask.sum())
    failed = n_words < MIN_WORDS or 100 * repeat_words > REPEAT_PERCENT * n_words
    kept = not failed and line_chars <= LINE_LIMIT * word_chars and all(chars[n] <= NGRAM_LIMITS[n] * word_chars for n in chars)
    return (n_words, word_chars, symbols, len(again), repeat_words, failed, kept, *chars.values(), line_chars)


def repetition(text: Column) -> Column:
    """A struct of counts and the verdict ``kept``.

    Null, empty and blank texts have no words and fail. Every text is measured alone, so repeated
    rows get equal numbers, and other columns don't matter.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=names)

    return measured(text)
