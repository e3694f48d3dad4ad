"""Exact attributions of tree models from tables of their nodes.

A tree gives each leaf the features on its path, for each the interval a row must lie in, and the
share of training rows that pass the feature's splits. With a feature unknown, a row passes with that
share; so the value of a set of known features is a sum over leaves of products, and a leaf's Shapley
values follow from the coefficients of the polynomial prod(share_j + passes_j * y): of its quotient
by the factor of feature i, coefficient k counts the sets of k known others. A leaf costs the square
of its path's length, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import shared_folder

CELLS = 2_000_000  # numbers held at once: rows x leaves x path
_saved = count()


def is_tree(model: Model) -> bool:
    """Whether a model is one tree or a weighted sum of trees."""
    return hasattr(model, "numNodes") or hasattr(model, "trees")


def node_table(model: Model, spark) -> DataFrame:
    """``tree, id, values, rows, left, right, feature, threshold, categories``: one row per node.

    ``values`` are shares of classes, or the prediction; a threshold sends smaller or equal
    values left, categories are those that go left.
    """
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{folder.rstrip('/')}/trees-{spark.sparkContext.applicationId}-{next(_saved)}"
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" in stored.columns:
        stored = stored.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        stored = stored.withColumn("tree", F.lit(0))
    total = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)
    shares = F.transform("impurityStats", lambda x: x / total)
    votes = hasattr(model, "numClasses") and not type(model).__name__.startswith("GBT")
    values = shares if votes else F.array("prediction")
    continuous = F.col("split.numCategories") < 0
    return stored.select(
        "tree", "id", values.alias("values"), F.col("rawCount").alias("rows"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.when(continuous, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~continuous, F.col("split.leftCategoriesOrThreshold")).alias("categories"), F.col("split.numCategories").alias("n_categories"),
    )


@dataclass
class Paths:
    """Leaves whose paths name the same number of features."""

    feature: np.ndarray  # leaves x features
    low: np.ndarray
    high: np.ndarray
    allowed: dict[tuple[int, int], np.ndarray]  # (leaf, place): categories that pass, for categorical features
    share: np.ndarray
    value: np.ndarray  # leaves x outputs

    def passes(self, x: np.ndarray, some: slice) -> np.ndarray:
        seen = x[:, self.feature[some]]
        out = (seen > self.low[some]) & (seen <= self.high[some])
        for (leaf, place), categories in self.allowed.items():
            if some.start <= leaf < some.stop:
                out[:, leaf - some.start, place] = np.isin(seen[:, leaf - some.start, place], categories)
        return out


def leaf_paths(nodes: DataFrame, weights: list[float]) -> list[Paths]:
    """The paths of all leaves, by their number of features; as large as the model, which the driver holds anyway."""
    trees: dict[int, dict[int, tuple]] = {}
    for n in nodes.collect():
        trees.setdefault(n["tree"], {})[n["id"]] = n
    found: dict[int, list[tuple]] = {}
    for number, tree in trees.items():
        open_ = [(0, {})]
        while open_:
            at, path = open_.pop()
            node = tree[at]
            if node["left"] < 0:
                value = [weights[number] * v for v in node["values"]]
                found.setdefault(len(path), []).append((path, value))
                continue
            j = node["feature"]
            low, high, allowed, share = path.get(j, (-np.inf, np.inf, None, 1.0))
            for side in ("left", "right"):
                part = share * tree[node[side]]["rows"] / node["rows"]
                if node["categories"] is None:
                    t = node["threshold"]
                    step = (low, min(high, t), None, part) if side == "left" else (max(low, t), high, None, part)
                else:
                    left = {float(c) for c in node["categories"]}
                    every = {float(c) for c in range(node["n_categories"])} if allowed is None else allowed
                    step = (low, high, every & left if side == "left" else every - left, part)
                open_.append((node[side], {**path, j: step}))
    out = []
    for _, leaves in sorted(found.items()):
        each = [list(path.items()) for path, _ in leaves]
        table = [np.array([[p[1][c] for p in e] for e in each], float).reshape(len(each), -1) for c in (0, 1, 3)]
        allowed = {(i, k): np.array(sorted(p[1][2])) for i, e in enumerate(each) for k, p in enumerate(e) if p[1][2] is not None}
        feature = np.array([[p[0] for p in e] for e in each], int).reshape(len(each), -1)
        out.append(Paths(feature, table[0], table[1], allowed, table[2], np.array([v for _, v in leaves])))
    return out


def shapley(x: np.ndarray, paths: list[Paths]) -> tuple[np.ndarray, np.ndarray, float | np.ndarray]:
    """``(attributions, scores, base)``: rows x features x outputs, rows x outputs, and the mean over training rows."""
    outputs = paths[0].value.shape[1]
    found, scores, base = np.zeros((x.shape[1], len(x), outputs)), np.zeros((len(x), outputs)), np.zeros(outputs)
    for p in paths:
        many, m = p.feature.shape
        base += p.value.T @ p.share.prod(axis=1)
        step = max(1, CELLS // max(1, len(x) * (m + 1)))
        weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        for at in range(0, many, step):
            some = slice(at, min(many, at + step))
            passes, share, value = p.passes(x, some), p.share[some], p.value[some]
            scores += passes.all(axis=2) @ value
            whole = np.zeros((*passes.shape[:2], m + 1))
            whole[..., 0] = 1.0
            for j in range(m):
                raised = np.concatenate([np.zeros_like(whole[..., :1]), whole[..., :-1]], axis=-1)
                whole = whole * share[None, :, j, None] + raised * passes[..., j, None]
            for i in range(m):
                z, o = share[None, :, i], passes[..., i]
                without = np.empty((*o.shape, m))
                quotient = whole[..., m]
                for k in range(m - 1, -1, -1):  # by (z + y) from the top, or by z alone
                    without[..., k] = np.where(o, quotient, whole[..., k] / z)
                    quotient = whole[..., k] - z * quotient
                gain = (o - z) * (without @ weight)
                np.add.at(found, p.feature[some, i], gain.T[:, :, None] * value[:, None, :])
    return found.transpose(1, 0, 2), scores, base


def tree_attributions(model: Model, rows: DataFrame) -> DataFrame:
    """``(row, feature, attribution)`` for rows of ``row`` and ``x``, exact; they add up to a row's score minus the training mean.

    Explained are the share of class 1 of two classes or of the predicted one of more, the
    prediction of regressions, and the margin of boosted classifiers. The paths travel with the
    tasks; rows are dealt as the caller dealt them.
    """
    several = hasattr(model, "trees")
    weights = list(model.treeWeights) if several else [1.0]
    if several and not type(model).__name__.startswith("GBT"):
        weights = [w / sum(weights) for w in weights]
    paths = leaf_paths(node_table(model, rows.sparkSession), weights)

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                x = np.array(some.column("x").to_pylist(), float)
                found, scores, _ = shapley(x, paths)
                outputs = scores.shape[1]
                chosen = np.zeros(len(x), int) if outputs == 1 else np.ones(len(x), int) if outputs == 2 else scores.argmax(axis=1)
                mine = found[np.arange(len(x)), :, chosen]
                width = x.shape[1]
                columns = [np.repeat(some.column("row").to_numpy(), width).astype(np.int64), np.tile(np.arange(width, dtype=np.int32), len(x)), mine.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "feature", "attribution"])

    return rows.select("row", "x").mapInArrow(explained, "row long, feature int, attribution double")
