"""Tuning, comparing and keeping models."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.learning import metrics
from tablewright.learning.encode import (
    Encoder,
    fit_encoder,
    fit_labels,
    fold_column,
    slim,
    split_rows,
    validate_training,
    with_label,
)
from tablewright.learning.models import CLASSIFICATION, DEFAULTS, REGRESSION, Facts, build, choose_algorithms, draw_parameters
from tablewright.operators.knn import knn_predict
from tablewright.operators.select import exclude_columns
from tablewright.plans.aggregates import col, kinds
from tablewright.session import cut_lineage
from tablewright.sources.tables import coerce_numeric

FORMAT_VERSION = "1.0"
ROW_NUMBER = "_row_number"
TASK_ROWS = 20_000  # training rows of a task: far fewer are soon done, and every pass of a fit starts the task again


@dataclass
class TrainOptions:
    """Options of a training run."""

    task: str = CLASSIFICATION
    target: str | None = None
    algorithm: str | None = None
    top_k: int = 3
    tune: bool = True
    trials: int = 30
    folds: int = 5
    test_share: float = 0.2
    neural_networks: bool = True
    explain: bool = True
    explained_rows: int = 100
    seed: int = 42
    parallelism: int = 4
    exclude: list[str] = field(default_factory=list)
    key: list[str] | None = None
    select_by: str = "test"

    def __post_init__(self) -> None:
        if self.task not in (CLASSIFICATION, REGRESSION):
            raise ValueError("task must be classification or regression")
        for name in ("top_k", "trials", "explained_rows", "parallelism"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.folds < 2:
            raise ValueError("folds must be at least 2")
        if not 0 < self.test_share < 1:
            raise ValueError("test_share must lie between 0 and 1")
        if self.select_by not in ("test", "cv"):
            raise ValueError("select_by must be test or cv")


@dataclass
class Trained:
    """One trained algorithm."""

    algorithm: str
    model: Model | None
    params: dict
    train_score: float
    test_score: float
    cv_score: float
    overfitting: str


class KnnModel:
    """Nearest neighbours over stored training rows; scoring is a distributed join."""

    def __init__(self, rows: DataFrame, width: int, params: dict, classify: bool) -> None:
        self.rows, self.width, self.params, self.classify = rows, width, params, classify

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"_x{j}" for j in range(self.width)]

        def spread(d: DataFrame) -> DataFrame:
            array = vector_to_array("features")
            return d.withColumns({n: F.get(array, F.lit(j)) for j, n in enumerate(names)})

        scored = knn_predict(
            spread(self.rows.select("features", "label")), spread(df), names, "label", self.params["k"],
            self.params["weights"], self.params["metric"], self.classify,
        )
        return scored.drop(*names)


def fit(name: str, train: DataFrame, facts: Facts, params: dict, seed: int) -> Model | KnnModel:
    if name == "knn":
        return KnnModel(train, facts.features, {**DEFAULTS["knn"], **params}, facts.task == CLASSIFICATION)
    return build(name, facts, params, seed).fit(train)


def score(model: Model | KnnModel, df: DataFrame, task: str) -> float:
    """Accuracy, or R2."""
    scored = model.transform(df)
    if task == CLASSIFICATION:
        row = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()
    else:
        row = metrics.regression_metrics(scored).select("r2").first()
    return row[0] if row[0] is not None else 0.0


def negative_mse(model: Model | KnnModel, df: DataFrame) -> float:
    value = metrics.regression_metrics(model.transform(df)).first()["mse"]
    return -value if value is not None else float("-inf")


def with_folds(train: DataFrame, o: TrainOptions) -> DataFrame:
    return train if "fold" in train.columns else fold_column(train, o.folds, o.seed)


def fold_score(
    i: int, name: str, folded: DataFrame, facts: Facts, params: dict, o: TrainOptions, objective: bool = False
) -> float:
    """Score on one fold of a model of the others; with ``objective`` regression is judged by negative MSE."""
    model = fit(name, folded.where(F.col("fold") != i), facts, params, o.seed)
    held = folded.where(F.col("fold") == i)
    return negative_mse(model, held) if objective and facts.task == REGRESSION else score(model, held, facts.task)


def cross_validate(name: str, train: DataFrame, facts: Facts, params: dict, o: TrainOptions, objective: bool = False) -> float:
    """Mean score over hash folds; with ``objective`` regression is judged by negative MSE."""
    folded = with_folds(train, o)
    scores = [fold_score(i, name, folded, facts, params, o, objective) for i in range(o.folds)]
    return sum(scores) / len(scores)


def tune(name: str, train: DataFrame, facts: Facts, o: TrainOptions) -> dict:
    """Seeded random search by cross-validation; trials of one algorithm run side by side."""
    drawn = draw_parameters(name, o.trials, o.seed)
    if len(drawn) == 1:
        return drawn[0]
    with ThreadPoolExecutor(o.parallelism) as pool:
        found = list(pool.map(lambda p: cross_validate(name, train, facts, p, o, objective=True), drawn))
    return drawn[max(range(len(drawn)), key=lambda i: (found[i], -i))]


def train_one(name: str, train: DataFrame, test: DataFrame, facts: Facts, o: TrainOptions) -> Trained:
    """The model of all training rows and those of the folds are fitted side by side."""
    params = tune(name, train, facts, o) if o.tune else dict(DEFAULTS[name])
    folded = with_folds(train, o)

    def whole() -> tuple[Model | KnnModel, float, float]:
        model = fit(name, train, facts, params, o.seed)
        return model, score(model, train, facts.task), score(model, test, facts.task)

    with ThreadPoolExecutor(o.parallelism) as pool:
        fitted = pool.submit(whole)
        scores = [pool.submit(fold_score, i, name, folded, facts, params, o) for i in range(o.folds)]
        model, on_train, on_test = fitted.result()
        cv = sum(s.result() for s in scores) / len(scores)
    return Trained(name, model, params, on_train, on_test, cv, metrics.overfitting_band(on_train, on_test))


def train_many(
    names: list[str], train: DataFrame, test: DataFrame, facts: Facts, o: TrainOptions
) -> tuple[list[Trained], dict[str, str]]:
    """Every algorithm, best first; failures are recorded, and an error only if all fail."""
    done, failed = [], {}
    for name in names:
        try:
            done.append(train_one(name, train, test, facts, o))
        except Exception as e:  # one algorithm must not stop the others
            failed[name] = f"{type(e).__name__}: {e}"
    if not done:
        raise RuntimeError(f"no algorithm could be trained: {failed}")
    by = (lambda t: t.test_score) if o.select_by == "test" else (lambda t: t.cv_score)
    return sorted(done, key=by, reverse=True), failed


@dataclass
class TrainResult:
    encoder: Encoder
    labels: list[str] | None
    best: Trained
    compared: list[Trained]
    failed: dict[str, str]
    facts: Facts
    target: str
    metrics: dict
    importance: list[tuple[str, float]]
    options: TrainOptions
    train_rows: DataFrame
    test_rows: DataFrame

    @property
    def features(self) -> list[str]:
        return self.encoder.numeric + self.encoder.categorical


COMPARISON_SCHEMA = (
    "algorithm string, train_score double, test_score double, cv_score double, overfitting string, params string, error string"
)


def comparison_frame(spark: SparkSession, result: TrainResult) -> DataFrame:
    rows = [
        (t.algorithm, t.train_score, t.test_score, t.cv_score, t.overfitting, json.dumps(t.params, sort_keys=True), None)
        for t in result.compared
    ] + [(n, None, None, None, None, None, e) for n, e in result.failed.items()]
    return spark.createDataFrame(rows, COMPARISON_SCHEMA)


def evaluate(scored: DataFrame, task: str, classes: int) -> dict:
    """All metrics of a task on scored rows."""
    if task == REGRESSION:
        return metrics.regression_metrics(scored).first().asDict()
    ranked = classes == 2 and "probability" in scored.columns
    if ranked:  # several jobs read the scored rows, of which three numbers are kept
        scored = cut_lineage(scored.select("label", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("_p")))
    out = metrics.classification_metrics(scored).first().asDict()
    if ranked:
        out["roc_auc"] = metrics.roc_auc(scored, "_p").first()["auc"]
    return out


def prepare(df: DataFrame, o: TrainOptions) -> tuple[DataFrame, DataFrame, Encoder, list[str] | None, Facts, str]:
    """Validate, split, and encode; the encoder sees training rows only.

    Rows are told apart by the key. Without one they are numbered, and the numbered table is
    written once, so that every later job sees the same numbers. So is a table of more than
    ``TASK_ROWS`` rows, as a dozen jobs would each compute it again.
    """
    table = exclude_columns(df, o.exclude, o.target)
    target = validate_training(table, o.target)
    classify = o.task == CLASSIFICATION
    tasks = -(-table.count() // TASK_ROWS)
    key = o.key
    if key is None:
        key = [ROW_NUMBER]
        table = table.withColumn(ROW_NUMBER, F.monotonically_increasing_id())
    if o.key is None or tasks > 1:
        table = cut_lineage(table)
    train, test = split_rows(table, target if classify else None, o.test_share, o.seed, key)
    encoder = fit_encoder(train.drop(ROW_NUMBER), target)
    indexer = fit_labels(table, target) if classify else None
    keep = [*table.columns, "label"]

    def encode(d: DataFrame) -> DataFrame:
        return slim(encoder.transform(with_label(d, target, indexer)), keep)

    train = fold_column(encode(train), o.folds, o.seed, key).select("features", "label", "fold")
    train = cut_lineage(train.repartition(tasks) if tasks > 1 else train)
    test = encode(test).drop(ROW_NUMBER)
    classes = len(indexer.labels) if classify else 0
    seen = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    facts = Facts(seen["n"], len(encoder.names), o.task, classes, seen["s"] or 1.0)
    return train, test, encoder, list(indexer.labels) if classify else None, facts, target


def train_models(df: DataFrame, options: TrainOptions | None = None) -> TrainResult:
    """Validate, split, encode, choose, train, compare, evaluate and explain."""
    from tablewright.learning.explain import importance

    o = options or TrainOptions()
    train, test, encoder, labels, facts, target = prepare(df, o)
    names = [o.algorithm] if o.algorithm else choose_algorithms(facts, o.top_k, o.neural_networks)
    compared, failed = train_many(names, train, test, facts, o)
    best = compared[0]
    found = evaluate(best.model.transform(test), o.task, facts.classes)
    ranked = importance(best.model, train, encoder.names, facts, o.explained_rows, o.seed) if o.explain else []
    return TrainResult(encoder, labels, best, compared, failed, facts, target, found, ranked, o, train, test)


# ---------------------------------------------------------------- scoring


def check_features(df: DataFrame, numeric_names: list[str], categorical: list[str]) -> DataFrame:
    """Refuse missing features; cast the numeric ones, refused when a cast loses values."""
    missing = [n for n in numeric_names + categorical if n not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return coerce_numeric(df, numeric_names)


def predict(
    df: DataFrame, encoder: Encoder, model: Model | KnnModel, labels: list[str] | None, checked: bool = True
) -> DataFrame:
    """The rows with ``prediction`` and, where the model has them, ``probability_<class>``.

    Row-local for MLlib models, so it also scores a stream (with ``checked=False``, since the
    check counts values).
    """
    if checked:
        check_features(df, [], encoder.numeric + encoder.categorical)
        kind = kinds(df)
        df = coerce_numeric(df, [n for n in encoder.numeric if kind[n] != "numeric"])
    helpers = [c for c in ("prediction", "probability", "rawPrediction", "features") if c in df.columns]
    scored = model.transform(slim(encoder.transform(df.drop(*helpers)), df.columns))
    keep = [col(c) for c in df.columns if c not in helpers]
    if labels is None:
        return scored.select(*keep, "prediction")
    out = scored
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        out = out.withColumns({f"probability_{name}": F.get(p, F.lit(i)) for i, name in enumerate(labels)})
    named = IndexToString(inputCol="prediction", outputCol="_name", labels=labels).transform(out)
    extra = [col(f"probability_{n}") for n in labels] if "probability" in scored.columns else []
    return named.select(*keep, F.col("_name").alias("prediction"), *extra)


def score_rows(result: TrainResult, df: DataFrame) -> DataFrame:
    return predict(df, result.encoder, result.best.model, result.labels)


# ---------------------------------------------------------------- keeping


@dataclass
class SavedModel:
    encoder: Encoder
    model: Model | KnnModel
    labels: list[str] | None
    info: dict

    def predict(self, df: DataFrame, checked: bool = True) -> DataFrame:
        return predict(df, self.encoder, self.model, self.labels, checked)


def save(result: TrainResult, path: str) -> None:
    """Encoder, model and a JSON description in one folder."""
    spark = result.train_rows.sparkSession
    result.encoder.model.write().overwrite().save(f"{path}/encoder")
    if isinstance(result.best.model, KnnModel):
        result.best.model.rows.select("features", "label").write.mode("overwrite").parquet(f"{path}/neighbours")
    else:
        PipelineModel([result.best.model]).write().overwrite().save(f"{path}/model")
    info = {
        "version": FORMAT_VERSION, "algorithm": result.best.algorithm, "params": result.best.params, "task": result.facts.task,
        "target": result.target, "labels": result.labels, "numeric": result.encoder.numeric, "categorical": result.encoder.categorical,
        "feature_names": result.encoder.names, "metrics": result.metrics, "importance": result.importance, "facts": asdict(result.facts),
    }
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load(spark: SparkSession, path: str) -> SavedModel:
    info = json.loads(spark.read.text(f"{path}/info", wholetext=False).first()["value"])
    encoder = Encoder(PipelineModel.load(f"{path}/encoder"), info["numeric"], info["categorical"], info["feature_names"])
    if info["algorithm"] == "knn":
        rows = spark.read.parquet(f"{path}/neighbours")
        model = KnnModel(rows, len(info["feature_names"]), info["params"], info["task"] == CLASSIFICATION)
    else:
        model = PipelineModel.load(f"{path}/model")
    return SavedModel(encoder, model, info["labels"], info)
