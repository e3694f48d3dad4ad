"""Algorithms, their search spaces, and which to try."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)

CLASSIFICATION, REGRESSION = "classification", "regression"
MAX_TREE_DEPTH = 30  # limit of MLlib

# The orders algorithms are tried in, by size of the table.
PRIORITIES = {
    (CLASSIFICATION, "small"): ["logistic_regression", "decision_tree", "knn", "random_forest", "gradient_boosting"],
    (REGRESSION, "small"): ["ridge", "decision_tree", "knn", "random_forest", "gradient_boosting"],
    (CLASSIFICATION, "medium"): ["random_forest", "gradient_boosting", "logistic_regression"],
    (REGRESSION, "medium"): ["random_forest", "gradient_boosting", "ridge"],
    (CLASSIFICATION, "large"): ["random_forest", "neural_network", "gradient_boosting"],
    (REGRESSION, "large"): ["random_forest", "gradient_boosting"],
}
TREES_FIRST = ["random_forest", "gradient_boosting"]

# Default hyper-parameters.
DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0, "max_iter": 2000},
    "decision_tree": {"max_depth": 10, "min_leaf": 1},
    "random_forest": {"trees": 100, "max_depth": 10},
    "gradient_boosting": {"rounds": 100, "rate": 0.1, "max_depth": 3},
    "knn": {"k": 5, "weights": "uniform", "metric": "euclidean"},
    "svm": {"C": 1.0},
    "neural_network": {"max_iter": 100},
}

# Search spaces; (low, high) integers, (low, high, "log") floats, (low, high, "lin") floats, lists of choices.
SPACES = {
    "logistic_regression": {"C": (0.001, 100.0, "log")},
    "ridge": {"alpha": (0.001, 100.0, "log")},
    "lasso": {"alpha": (0.001, 100.0, "log")},
    "decision_tree": {"max_depth": (2, 32), "min_leaf": (1, 10)},
    "random_forest": {"trees": (50, 300), "max_depth": (3, 20), "min_leaf": (1, 10)},
    "gradient_boosting": {
        "rounds": (50, 300), "rate": (0.01, 0.3, "log"), "max_depth": (2, 10), "min_leaf": (1, 10), "share": (0.6, 1.0, "lin"),
    },
    "knn": {"k": (3, 30), "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "svm": {"C": (0.1, 100.0, "log")},
}

TASKS = {
    "logistic_regression": (CLASSIFICATION,), "linear_regression": (REGRESSION,), "ridge": (REGRESSION,), "lasso": (REGRESSION,),
    "decision_tree": (CLASSIFICATION, REGRESSION), "random_forest": (CLASSIFICATION, REGRESSION),
    "gradient_boosting": (CLASSIFICATION, REGRESSION), "knn": (CLASSIFICATION, REGRESSION), "svm": (CLASSIFICATION,),
    "neural_network": (CLASSIFICATION,),
}


@dataclass
class Facts:
    """What the choice of algorithms looks at."""

    rows: int
    features: int
    task: str
    classes: int = 0
    label_std: float = 1.0

    @property
    def size(self) -> str:
        return "small" if self.rows < 1000 else "medium" if self.rows < 10_000 else "large"

    @property
    def high_dimensional(self) -> bool:
        return self.features > 100 or self.features > 0.5 * self.rows


def available(task: str) -> list[str]:
    return [n for n, tasks in TASKS.items() if task in tasks]


def choose_algorithms(facts: Facts, top_k: int = 3, neural: bool = True) -> list[str]:
    """The first ``top_k`` algorithms for a table of this size and task."""
    order = PRIORITIES[(facts.task, facts.size)]
    if facts.high_dimensional:
        order = [n for n in TREES_FIRST if n in order] + [n for n in order if n not in TREES_FIRST]
    usable = [n for n in available(facts.task) if neural or n != "neural_network"]
    ranked = [n for n in order if n in usable]
    return (ranked + [n for n in usable if n not in ranked])[:top_k]


def draw_parameters(name: str, trials: int, seed: int) -> list[dict]:
    """Defaults first, then seeded random draws from the search space."""
    rng = random.Random(f"{name}:{seed}")
    out = [dict(DEFAULTS[name])]
    space = SPACES.get(name, {})
    while space and len(out) < trials:
        drawn = dict(DEFAULTS[name])
        for p, s in space.items():
            if isinstance(s, list):
                drawn[p] = rng.choice(s)
            elif len(s) == 2:
                drawn[p] = rng.randint(*s)
                if p == "max_depth":
                    drawn[p] = min(MAX_TREE_DEPTH, drawn[p])
            elif s[2] == "log":
                drawn[p] = math.exp(rng.uniform(math.log(s[0]), math.log(s[1])))
            else:
                drawn[p] = rng.uniform(s[0], s[1])
        out.append(drawn)
    return out


def build(name: str, facts: Facts, params: dict | None = None, seed: int = 42) -> Estimator:
    """An MLlib estimator. Penalties are rescaled to MLlib's per-row loss."""
    if name not in TASKS:
        raise ValueError(f"unknown algorithm {name}; known: {', '.join(TASKS)}")
    if facts.task not in TASKS[name]:
        raise ValueError(f"{name} does not support {facts.task}")
    p = {**DEFAULTS[name], **(params or {})}
    n = max(1, facts.rows)
    classify = facts.task == CLASSIFICATION
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (p["C"] * n), maxIter=p["max_iter"], standardization=False)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0)
    if name == "ridge":
        # MLlib fits the label in units of its deviation, which divides the squared penalty.
        return LinearRegression(regParam=p["alpha"] / n * facts.label_std, elasticNetParam=0.0, standardization=False)
    if name == "lasso":
        return LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, maxIter=p["max_iter"], standardization=False)
    if name == "svm":
        base = LinearSVC(regParam=1.0 / (p["C"] * n))
        return base if facts.classes <= 2 else OneVsRest(classifier=base)
    if name == "neural_network":
        return MultilayerPerceptronClassifier(layers=[facts.features, 64, 32, max(2, facts.classes)], maxIter=p["max_iter"], seed=seed)
    if name == "knn":
        raise ValueError("knn has no estimator; it is scored by a block join")
    tree = {"maxDepth": min(MAX_TREE_DEPTH, p["max_depth"]), "minInstancesPerNode": p.get("min_leaf", 1), "seed": seed}
    if name == "decision_tree":
        return (DecisionTreeClassifier if classify else DecisionTreeRegressor)(**tree)
    if name == "random_forest":
        return (RandomForestClassifier if classify else RandomForestRegressor)(numTrees=p["trees"], **tree)
    boost = {"maxIter": p["rounds"], "stepSize": p["rate"], "subsamplingRate": p.get("share", 1.0), **tree}
    if not classify:
        return GBTRegressor(**boost)
    base = GBTClassifier(**boost)
    return base if facts.classes <= 2 else OneVsRest(classifier=base)
