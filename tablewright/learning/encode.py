"""Features, labels and the split into training and test rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.aggregates import col, kinds, measure
from tablewright.plans.orderstats import numeric, values_at
from tablewright.plans.ranks import range_splits, running_totals
from tablewright.session import cut_lineage

MIN_ROWS = 10  # fixed value: fewest rows a model is trained on
MAX_LEVELS = 100_000  # levels of one category that each have a column; a column of more is hashed
HASHED = 1 << 16  # columns that the levels of such a category share


def validate_training(df: DataFrame, target: str | None = None) -> str:
    """The target (last column by default), after checking it exists and the table is complete."""
    target = target or df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    seen = measure(df, {None: F.count(F.lit(1))} | {n: F.count(col(n)) for n in df.columns})
    rows = seen.pop(None)
    open_ = [n for n, filled in seen.items() if filled < rows]
    if open_:
        raise ValueError(f"columns with missing values: {', '.join(open_)}")
    if rows < MIN_ROWS:
        raise ValueError(f"{rows} rows are too few, {MIN_ROWS} are needed")
    return target


@dataclass
class Encoder:
    """A fitted feature pipeline and the names of its output features."""

    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    names: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fit_encoder(df: DataFrame, target: str | None = None) -> Encoder:
    """Z-score numbers (population deviation), one-hot everything textual or boolean.

    Unknown and missing categories become all zeros, missing numbers the mean of the training
    rows; columns of other kinds are left out. A category of more than ``MAX_LEVELS`` levels is
    hashed to ``HASHED`` features, named by their number; no level of it reaches the driver.
    """
    kind = {n: k for n, k in kinds(df).items() if n != target}
    numbers = [n for n, k in kind.items() if k == "numeric"]
    words = [n for n, k in kind.items() if k in ("string", "boolean")]
    seen = measure(
        df,
        {(n, "mean"): F.avg(numeric(n)) for n in numbers}
        | {(n, "std"): F.stddev_pop(numeric(n)) for n in numbers}
        | {(n, "levels"): F.approx_count_distinct(col(n)) for n in words},
    )
    # the sketch decides where it is far from the limit, an exact count elsewhere
    near = [n for n in words if 0.8 * MAX_LEVELS < seen[(n, "levels")] < 1.25 * MAX_LEVELS]
    levels = {n: seen[(n, "levels")] for n in words} | {n: df.select(col(n)).na.drop().distinct().count() for n in near}
    wide = [n for n in words if levels[n] > MAX_LEVELS]
    scaled = [
        f"COALESCE((NANVL(TRY_CAST({_quoted(n)} AS DOUBLE), CAST(NULL AS DOUBLE)) - {seen[(n, 'mean')]!r}D) / {(seen[(n, 'std')] or 1.0)!r}D, 0.0D) AS _z{i}"
        for i, n in enumerate(numbers)
    ]
    texts = [f"CAST({_quoted(n)} AS STRING) AS _t{i}" for i, n in enumerate(words)]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(['*', *scaled, *texts])} FROM __THIS__")]
    inputs = [f"_z{i}" for i in range(len(numbers))]
    names = list(numbers)
    listed = [i for i, n in enumerate(words) if n not in wide]
    if listed:
        prepared = stages[0].transform(df)
        index = StringIndexer(
            inputCols=[f"_t{i}" for i in listed],
            outputCols=[f"_i{i}" for i in listed],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(prepared)
        hot = OneHotEncoder(inputCols=[f"_i{i}" for i in listed], outputCols=[f"_h{i}" for i in listed], dropLast=True).fit(index.transform(prepared))
        stages += [index, hot]
        inputs += [f"_h{i}" for i in listed]
        for i, found in zip(listed, index.labelsArray, strict=True):
            names += [f"{words[i]}_{level}" for level in found]
    for i, n in enumerate(words):
        if n in wide:
            stages.append(FeatureHasher(inputCols=[f"_t{i}"], outputCol=f"_h{i}", numFeatures=HASHED))
            inputs.append(f"_h{i}")
            names += [f"{n}_#{j}" for j in range(HASHED)]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Encoder(PipelineModel(stages), numbers, words, names)


def slim(encoded: DataFrame, keep: list[str]) -> DataFrame:
    """Drop the helper columns of the encoder."""
    return encoded.select(*[col(c) for c in keep if c in encoded.columns], "features")


def fit_labels(df: DataFrame, target: str) -> StringIndexerModel:
    """Class labels in sorted order."""
    return StringIndexer(
        inputCol="_label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(df.select(col(target).cast("string").alias("_label_text")))


def with_label(df: DataFrame, target: str, labels: StringIndexerModel | None) -> DataFrame:
    if labels is None:
        return df.withColumn("label", col(target).cast("double"))
    return labels.transform(df.withColumn("_label_text", col(target).cast("string"))).drop("_label_text")


def row_hash(df: DataFrame, key: list[str] | None, seed: int) -> Column:
    """A 53-bit hash of the key columns, exact as double."""
    return F.shiftrightunsigned(F.xxhash64(*[col(c) for c in (key or df.columns)], F.lit(seed)), 11)


def split_rows(
    df: DataFrame, classes_of: str | None = None, test_share: float = 0.2, seed: int = 42, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; per class when a class column is given.

    The test rows are those with the smallest hashes: the border hash of each class is found as
    an order statistic, so the shares are met without moving whole rows. With a unique key
    they are met exactly; rows equal in all key columns stay on one side. Without a key the
    hash covers every column but the class, so that it says nothing about the class.
    """
    hashed = row_hash(df, key or [c for c in df.columns if c != classes_of], seed)
    if classes_of is not None:
        return _split_classes(df.withColumn("_hash", hashed), classes_of, test_share)
    sizes = measure(df, {"all": F.count(F.lit(1))})
    wanted = int(sizes["all"] * test_share + 0.5)
    if not wanted:
        return df, df.limit(0)
    number = hashed.cast("double")
    border = next(iter(values_at(df, {"all": [wanted - 1]}, sizes, {"all": number}).values()))
    return df.where(number > border), df.where(number <= border)


def _split_classes(df: DataFrame, classes_of: str, test_share: float) -> tuple[DataFrame, DataFrame]:
    """As ``split_rows`` for each class, of any number of classes; ``df`` has ``_hash``. Rows without a class are trained on.

    Hashes are ranked in ranges; the border of a class is one row, and rows find theirs by a join.
    """
    keyed = df.select(col(classes_of).cast("string").alias("_class"), "_hash").where("_class is not null")
    rows = keyed.count()
    counted = keyed.groupBy("_class", "_hash").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, ["_class"], "_hash", "n", range_splits(keyed, F.col("_hash"), rows))
    wanted = keyed.groupBy("_class").agg(F.floor(F.count(F.lit(1)) * test_share + 0.5).alias("wanted"))
    at = ranked.join(wanted, "_class").where((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n")))
    borders = cut_lineage(at.select("_class", F.col("_hash").alias("_border")))
    placed = df.withColumn("_class", col(classes_of).cast("string")).join(borders, "_class", "left")
    tested = F.coalesce(F.col("_hash") <= F.col("_border"), F.lit(False))
    names = [c for c in df.columns if c != "_hash"]
    return placed.where(~tested).select(*map(col, names)), placed.where(tested).select(*map(col, names))


def fold_column(df: DataFrame, folds: int, seed: int, key: list[str] | None = None) -> DataFrame:
    """Add ``fold`` from a row hash."""
    return df.withColumn("fold", (F.pmod(row_hash(df, key, seed + 1), F.lit(folds))).cast("int"))
