"""Evaluation as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.ranks import range_splits, rank_values


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``; pairs that do not occur are absent."""
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and weighted precision, recall and F1; empty classes count as zero."""
    pairs = confusion_matrix(scored, label, prediction)
    # Class-sized tables from here on.
    sides = pairs.select(F.col("label").alias("c"), "n", F.lit(0).alias("p"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        pairs.select(F.col("prediction").alias("c"), F.lit(0).alias("n"), F.col("n").alias("p"), F.lit(0).alias("hit"))
    )
    per = sides.groupBy("c").agg(F.sum("n").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), "support"), F.lit(0.0))
    per = per.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    total = F.sum("support")

    def weighted(c):
        return F.try_divide(F.sum(c * F.col("support")), total)

    return per.withColumn("f1", f1).agg(
        F.try_divide(F.sum("hit").cast("double"), total).alias("accuracy"),
        weighted(F.col("precision")).alias("precision"),
        weighted(F.col("recall")).alias("recall"),
        weighted(F.col("f1")).alias("f1"),
    )


def roc_auc(scored: DataFrame, score: str, positive: str = "label") -> DataFrame:
    """One row ``auc``: exact area under the ROC curve from rank sums, ties averaged.

    ``positive`` is 1 for the positive class and 0 otherwise. Rows without a score or class are
    left out.
    """
    rows = scored.select(F.col(score).cast("double").alias("v"), F.col(positive).cast("double").alias("y")).dropna()
    splits = range_splits(rows, F.col("v"), rows.count())
    counted = rows.groupBy("v").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    ranked = rank_values(counted, [], "v", "n", splits)
    joined = counted.join(ranked.select("v", "rank"), "v")
    ones, zeros = F.sum("hits"), F.sum(F.col("n") - F.col("hits"))
    return joined.agg(
        F.try_divide(F.sum(F.col("hits") * F.col("rank")) - ones * (ones + 1) / 2, ones * zeros).alias("auc")
    )


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: MSE, RMSE, MAE and R2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p
    mse = F.avg(error * error)
    return scored.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )


def overfitting_band(train_score: float, test_score: float) -> str:
    gap = train_score - test_score
    return "low" if gap < 0.05 else "medium" if gap < 0.15 else "high"
