"""Row-local text cleaning as Column expressions.

Everything here is built from JVM expressions, has no state and no shuffle, and works the
same on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import words as W

_DECORATION_SET = "".join(W.NUMBER_DECORATION)
_FLOAT_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INT32_MAX = 2147483647


def trimmed(c: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` alone removes only spaces)."""
    return F.btrim(c, F.lit(W.WHITESPACE))


def folded(c: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(trimmed(c))


def number_text(c: Column) -> Column:
    """A text without currency, percent and thousands marks."""
    return F.translate(trimmed(c), _DECORATION_SET, "")


def float_or_null(c: Column) -> Column:
    """Parse a plain decimal text; anything else, also ``12d`` or ``inf``, is null."""
    return F.when(c.rlike(_FLOAT_SHAPE), c.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Parse a decorated number."""
    return float_or_null(number_text(c))


def is_number(c: Column) -> Column:
    return number_text(c).rlike(_FLOAT_SHAPE)


def looks_like_float(c: Column) -> Column:
    """A number written with a decimal point or with a fractional value."""
    text = number_text(c)
    value = float_or_null(text)
    return F.coalesce(value.isNotNull() & (text.contains(".") | (value % 1 != 0)), F.lit(False))


def is_error_marker(c: Column) -> Column:
    return folded(c).isin(W.ERROR_WORDS)


def is_boolean_word(c: Column) -> Column:
    return folded(c).isin(W.TRUE_WORDS_WIDE + W.FALSE_WORDS_WIDE)


def is_missing_word(c: Column) -> Column:
    return folded(c).isin(W.MISSING_WORDS)


def _readable(c: Column) -> Column:
    return (trimmed(c) != "") & ~is_error_marker(c)


def to_double(c: Column) -> Column:
    """Text to double, falling back to the digits, dots and minus signs of the text."""
    text = number_text(c)
    kept = F.regexp_replace(text, r"[^\p{N}.\-]", "")
    return F.when(_readable(c), F.coalesce(float_or_null(text), float_or_null(kept)))


def to_integer(c: Column, bits: int = 64) -> Column:
    """Text to an integer: truncated toward zero, clamped to the range of the type."""
    text = number_text(c)
    value = float_or_null(text)
    # floor and ceil of a double already stop at the ends of the 64-bit range.
    whole = F.when(_readable(c), F.when(text.startswith("-"), F.ceil(value)).otherwise(F.floor(value)))
    if bits == 64:
        return whole
    return F.when(whole.isNotNull(), F.least(F.greatest(whole, F.lit(-_INT32_MAX - 1)), F.lit(_INT32_MAX))).cast("int")


def epoch_to_timestamp(c: Column) -> Column:
    """Epoch seconds or milliseconds, recognised by magnitude, to a timestamp."""
    n = F.when(trimmed(c).rlike(r"^[+-]?[0-9]+$"), trimmed(c).try_cast("bigint"))
    return F.when((n > 1_000_000_000) & (n < 2_000_000_000), F.timestamp_seconds(n)).when(
        (n > 1_000_000_000_000) & (n < 2_000_000_000_000), F.timestamp_millis(n)
    )


def iso_to_timestamp(c: Column) -> Column:
    """Epoch numbers as above, else any date text Spark can read."""
    return F.coalesce(epoch_to_timestamp(c), F.try_to_timestamp(trimmed(c)))


def to_boolean(c: Column) -> Column:
    word = folded(c)
    return F.when(word.isin(W.TRUE_WORDS), F.lit(True)).when(word.isin(W.FALSE_WORDS), F.lit(False))


def blank_missing(c: Column) -> Column:
    """Missing-value words become null, everything else is trimmed."""
    return F.when(~is_missing_word(c), trimmed(c))


QUOTE_ROUNDS = 10  # fixed value: layers removed at most


def _peel(text: Column) -> Column:
    """Remove the outermost pair of matching quotes, the longest kind first."""

    def wrapped(mark: str) -> Column:
        return text.startswith(mark) & text.endswith(mark) & (F.length(text) > 2 * len(mark))

    width = (
        F.when(wrapped('"""'), 3).when(wrapped('""'), 2).when(wrapped('"') | wrapped("'"), 1).otherwise(0)
    )
    return F.when(width == 0, text).otherwise(
        trimmed(F.substring(text, width + 1, F.length(text) - 2 * width))
    )


def _peel_once(c: Column) -> Column:
    return F.when(c.startswith('"') | c.startswith("'"), _peel(c)).otherwise(c)


def _peel_rest(c: Column) -> Column:
    """The remaining layers; interpreted, so only values that still start with a quote enter."""
    deep = F.aggregate(F.sequence(F.lit(2), F.lit(QUOTE_ROUNDS)), c, lambda text, _: _peel(text))
    return F.when(c.startswith('"') | c.startswith("'"), deep).otherwise(c)


def _drop_doubled(c: Column) -> Column:
    bare = F.replace(F.replace(c, F.lit('"""'), F.lit("")), F.lit('""'), F.lit(""))
    return trimmed(bare)


# The steps of deep quote stripping. Each reads its input several times, so a table applies
# them as separate projections and every step runs once per value.
QUOTE_STEPS = [trimmed, _peel_once, _peel_rest, _drop_doubled, lambda c: F.nullif(c, F.lit(""))]


def strip_quotes(c: Column) -> Column:
    """Remove up to ten layers of matching quotes, then doubled quotes inside; empty is null."""
    for step in QUOTE_STEPS:
        c = step(c)
    return c


def scrub_output(c: Column) -> Column:
    """Trim and delete every double quote; empty is null."""
    return F.nullif(trimmed(F.translate(trimmed(c), '"', "")), F.lit(""))
