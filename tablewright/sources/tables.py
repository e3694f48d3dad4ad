"""Reading text tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import text as X
from tablewright.plans.aggregates import col, kinds, measure
from tablewright.sources.records import crosses_lines, lines_of, records

HEAD_ROWS = 1000  # fixed value: rows from which types are guessed; all rows are held against the guess


class SourceError(Exception):
    """A source could not be used; ``reason`` is not_found, read or parse."""

    def __init__(self, reason: str, message: str) -> None:
        super().__init__(message)
        self.reason = reason


def _text(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        reason = "not_found" if "PATH_NOT_FOUND" in str(e) else "read"
        raise SourceError(reason, str(e)) from e


QUOTES = {"header": True, "quote": '"', "escape": '"'}
# The next wider type of each that a column may be given when values do not fit.
WIDER: dict[type[T.DataType], T.DataType] = {T.IntegerType: T.LongType(), T.LongType: T.DoubleType()}


def _head(spark: SparkSession, lines: DataFrame) -> list[str]:
    return [r["value"] for r in lines.limit(HEAD_ROWS + 1).collect()]  # at most 1001 lines


def _guessed(spark: SparkSession, head: list[str]) -> T.StructType:
    return spark.read.csv(spark.sparkContext.parallelize(head, 1), inferSchema=True, **QUOTES).schema


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _fits(c: Column, kind: T.DataType) -> Column:
    """Whether the reader takes a text as a value of this type without loss."""
    number = r"^[+-]?[0-9]+$" if isinstance(kind, T.IntegralType) else r"^[+-]?([0-9]|[.][0-9]|NaN$|Inf)\S*$"
    if isinstance(kind, T.NumericType):
        return c.rlike(number) & c.try_cast(kind).isNotNull()
    if isinstance(kind, T.BooleanType):
        return F.lower(c).isin("true", "false")
    if isinstance(kind, T.DateType):
        return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast(kind).isNotNull()
    return c.try_cast(kind).isNotNull()


def fitted_schema(texts: DataFrame, guess: T.StructType) -> T.StructType:
    """The guess, with every type widened until all values of the table fit; one scan.

    Integers may become long or double, whatever fits nothing else stays text.
    """
    chains: dict[str, list[T.DataType]] = {}
    for f in guess:
        kind = f.dataType
        while kind is not None and not isinstance(kind, T.StringType):
            chains.setdefault(f.name, []).append(kind)
            kind = WIDER.get(type(kind))
    given = {n: col(n).isNotNull() & (col(n) != "") for n in chains}
    lost = measure(
        texts,
        {(n, i): F.count(F.when(given[n] & ~F.coalesce(_fits(col(n), k), F.lit(False)), 1)) for n, c in chains.items() for i, k in enumerate(c)},
    )
    kinds_ = {n: next((k for i, k in enumerate(c) if not lost[(n, i)]), T.StringType()) for n, c in chains.items()}
    return T.StructType([T.StructField(f.name, kinds_.get(f.name, T.StringType())) for f in guess])


def _parsed(rows: DataFrame, schema: T.StructType, **options: str) -> DataFrame:
    """Records (a column ``value``) as columns."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("value", ddl, {"mode": "PERMISSIVE", "quote": '"', "escape": '"', **options}).alias("r")).select("r.*")


def _record_head(rows: DataFrame) -> list[str]:
    """The header and at most 1000 records."""
    head = [r["value"] for r in rows.where("header").limit(1).collect()]
    return head + [r["value"] for r in rows.where("not header").limit(HEAD_ROWS).collect()] if head else []


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; a value never becomes null because it does not fit its column's type.

    Types are guessed from 1000 rows and held against all rows. Values may hold line breaks inside
    quotes: such files are cut into records split by split (``records``), others by the reader.
    """
    _text(spark, path)
    lines = lines_of(spark, path)
    if crosses_lines(lines):
        rows = records(lines)
        body = rows.where("not header")
        if schema is None:
            guess = _guessed(spark, _record_head(rows))
            schema = fitted_schema(_parsed(body, _as_text(guess)), guess)
        return _parsed(body, schema)
    if schema is None:
        head = _head(spark, lines)
        if not head:
            raise SourceError("parse", f"{path} holds no header")
        guess = _guessed(spark, head)
        schema = fitted_schema(spark.read.csv(path, schema=_as_text(guess), **QUOTES), guess)
    return spark.read.csv(path, schema=schema, **QUOTES)


def read_csv_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose lines may hold doubled or tripled quotes and blank lines, with types as ``read_csv`` gives them.

    The plain parse is kept when every record fits the header, whether or not values hold line
    breaks; otherwise quotes are collapsed and blank lines dropped, record by record on the
    executors, before parsing. Each file's first line is its header; later lines that equal it are data.
    """
    whole = _text(spark, path).where(X.trimmed(F.col("value")) != "")
    lines = lines_of(spark, path)
    crossing = crosses_lines(lines)
    rows = records(lines) if crossing else None
    head = _record_head(rows) if crossing else _head(spark, whole)
    if not head:
        raise SourceError("parse", f"{path} holds no header")
    plain = _as_text(_guessed(spark, head))
    checked = T.StructType([*plain.fields, T.StructField("_corrupt", T.StringType())])
    if crossing:
        probe = _parsed(rows.where("not header"), checked, columnNameOfCorruptRecord="_corrupt")
    else:
        probe = spark.read.csv(path, schema=checked, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE", **QUOTES)
    # Whole rows are asked for, since Spark parses only the columns a query reads.
    if not probe.where(F.col("_corrupt").isNotNull()).head(1):
        return read_csv(spark, path)

    def collapsed(c: Column) -> Column:
        quote = F.lit('"')
        return F.replace(F.replace(c, F.lit('"""'), quote), F.lit('""'), quote)

    if crossing:
        body = rows.where("not header")
    else:  # one column of whole lines: the reader itself leaves out each file's header
        body = spark.read.csv(path, schema="value string", header=True, sep="\u0001", quote="", multiLine=False)
    body = body.where(X.trimmed(F.col("value")) != "").select(collapsed(F.col("value")).alias("value"))
    shown = [x.replace('"""', '"').replace('""', '"') for x in head]
    guess = _guessed(spark, shown)
    names = next(iter(spark.read.csv(spark.sparkContext.parallelize(shown[:1]), escape='"').collect()))
    named = T.StructType([T.StructField(n or f"column_{i}", T.StringType()) for i, n in enumerate(names)])
    parsed = _parsed(body, named)
    guess = T.StructType([T.StructField(n, f.dataType) for n, f in zip(parsed.columns, guess, strict=True)])
    fitted = fitted_schema(parsed, guess)
    return parsed.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in fitted])


def column_info(df: DataFrame) -> DataFrame:
    """``(name, dtype, null_count)`` in one pass."""
    nulls = measure(df, {n: F.count(F.when(col(n).isNull(), 1)) for n in df.columns})
    rows = [(n, t, nulls[n]) for n, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "name string, dtype string, null_count bigint")


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Cast features to double; refused when a cast would lose values."""
    kind = kinds(df)
    missing = [n for n in names if n not in kind]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    text = [n for n in names if kind[n] != "numeric"]
    cast = {n: X.float_or_null(X.trimmed(col(n).cast("string"))) for n in text}
    lost = measure(df, {n: F.count(F.when(col(n).isNotNull() & c.isNull(), 1)) for n, c in cast.items()})
    bad = [f"{n} ({k} values)" for n, k in lost.items() if k]
    if bad:
        raise ValueError(f"features that are not numeric: {', '.join(bad)}")
    return df.withColumns(cast | {n: col(n).cast("double") for n in names if n not in cast})


def read_scoring_csv(spark: SparkSession, path: str, numeric_features: list[str]) -> DataFrame:
    """A CSV to score, its numeric features as double."""
    return coerce_numeric(read_csv(spark, path), numeric_features)
