"""Attributions of predictions to features."""

from __future__ import annotations

import random

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.learning.models import CLASSIFICATION, Facts
from tablewright.learning.trees import is_tree, tree_attributions

BACKGROUND_ROWS = 50  # fixed value: rows features are switched off with
PERMUTATIONS = 10


def explained_rows(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """The rows with the smallest hashes, numbered ``row``; explaining a bounded sample is the feature."""
    x = vector_to_array("features")
    picked = df.select(x.alias("x"), F.xxhash64(x, F.lit(seed)).alias("h")).orderBy("h", "x").limit(rows)
    return picked.select((F.row_number().over(Window.orderBy("h", "x")) - 1).alias("row"), "x")


def linear_attributions(coefficients: list[float], means: list[float], rows: DataFrame) -> DataFrame:
    """``(row, feature, attribution)``: coefficient times the distance from the feature mean, exact."""
    w, m = (F.array(*map(F.lit, v)) for v in (coefficients, means))
    parts = F.transform(F.arrays_zip(F.col("x"), w.alias("w"), m.alias("m")), lambda t: t["w"] * (t["x"] - t["m"]))
    return rows.select("row", F.posexplode(parts).alias("feature", "attribution"))


def feature_means(df: DataFrame) -> list[float]:
    """Mean of each encoded feature, over all rows; sparse rows stay sparse."""
    mean = df.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    return [float(v) for v in mean.toArray()] if mean is not None else []


def _output(scored: DataFrame, facts: Facts) -> Column:
    """What is explained: the probability of class 1, or of the predicted class; else the prediction."""
    if facts.task == CLASSIFICATION and "probability" in scored.columns:
        p = vector_to_array("probability")
        return F.get(p, F.lit(1)) if facts.classes == 2 else F.array_max(p)
    return F.col("prediction")


def sampled_attributions(
    model: Model, rows: DataFrame, background: DataFrame, width: int, facts: Facts, seed: int, permutations: int = PERMUTATIONS
) -> DataFrame:
    """``(row, feature, attribution)``: Shapley values by sampled feature orders.

    Each row meets seeded feature orders and background rows; features are switched on one by
    one and the model scores every step, all as one distributed job.
    """
    rng = random.Random(seed)
    base = [r["x"] for r in background.limit(BACKGROUND_ROWS).collect()]  # at most 50 rows
    plans = []
    for i in range(permutations):
        order = rng.sample(range(width), width)
        place = [order.index(j) for j in range(width)]
        plans.append((i, order, place, [float(v) for v in base[rng.randrange(len(base))]]))
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("plan"), F.array(*map(F.lit, order)).alias("order"),
                F.array(*map(F.lit, place)).alias("place"), F.array(*map(F.lit, b)).alias("b"),
            )
            for i, order, place, b in plans
        ]
    )
    steps = (
        rows.select("row", "x", F.explode(listed).alias("p"))
        .select("row", "x", "p.*")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    )
    mixed = F.transform(
        F.arrays_zip("x", "b", "place"), lambda t: F.when(t["place"] < F.col("step"), t["x"]).otherwise(t["b"])
    )
    scored = model.transform(steps.withColumn("features", array_to_vector(mixed)))
    scored = scored.select("row", "plan", "step", "order", _output(scored, facts).alias("y"))
    # A window partition is the path of one row in one plan: width + 1 steps.
    path = Window.partitionBy("row", "plan").orderBy("step")
    gains = scored.withColumn("gain", F.col("y") - F.lag("y").over(path)).where("step > 0")
    switched = gains.select("row", F.get("order", F.col("step") - 1).alias("feature"), "gain")
    return switched.groupBy("row", "feature").agg(F.avg("gain").alias("attribution"))


def attributions(model: Model, df: DataFrame, width: int, facts: Facts, rows: int = 100, seed: int = 42) -> DataFrame:
    """Exact for trees and for linear models with one weight per feature, sampled otherwise."""
    picked = explained_rows(df, rows, seed)
    # a model of three classes or more has a weight per class, and raises when asked for one
    one_each = facts.task != CLASSIFICATION or facts.classes <= 2
    if one_each and hasattr(model, "coefficients") and not hasattr(model, "trees"):
        weights = [float(w) for w in model.coefficients.toArray()]
        return linear_attributions(weights, feature_means(df), picked)
    if is_tree(model):
        return tree_attributions(model, picked)
    return sampled_attributions(model, picked, explained_rows(df, BACKGROUND_ROWS, seed + 1).drop("row"), width, facts, seed)


def mean_attributions(found: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return found.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def importance(model, df: DataFrame, names: list[str], facts: Facts, rows: int = 100, seed: int = 42) -> list[tuple[str, float]]:
    """``(feature, share)``, summing to one, largest first."""
    found = mean_attributions(attributions(model, df, len(names), facts, rows, seed)).collect()  # one row per feature
    total = sum(r["importance"] for r in found) or 1.0
    ranked = [(names[r["feature"]], r["importance"] / total) for r in found]
    return sorted(ranked, key=lambda t: (-t[1], t[0]))


def plot_tables(found: DataFrame, rows: DataFrame, names: list[str], top: int = 2, decision_rows: int = 50) -> dict[str, DataFrame]:
    """The inputs of the bar, summary, dependence, decision and waterfall plots."""
    named = F.element_at(F.array(*map(F.lit, names)), F.col("feature") + 1)
    values = rows.select("row", F.posexplode("x").alias("feature", "value"))
    summary = found.join(values, ["row", "feature"]).select("row", named.alias("name"), "feature", "value", "attribution")
    bar = mean_attributions(found).select(named.alias("name"), "importance").orderBy(F.desc("importance"), "name")
    best = [r["name"] for r in bar.limit(top).collect()]
    return {
        "bar": bar,
        "summary": summary,
        "dependence": summary.where(F.col("name").isin(best)),
        "decision": summary.where(F.col("row") < decision_rows),
        "waterfall": summary.where(F.col("row") == 0).orderBy(F.abs("attribution").desc(), "name"),
    }
