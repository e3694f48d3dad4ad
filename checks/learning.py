"""Encoding, models, evaluation, explanation and scoring."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.registry import query, rounded, scratch, table
from tablewright.learning import encode, explain, metrics, trees
from tablewright.learning import models as M
from tablewright.learning import train as T
from tablewright.sources.tables import coerce_numeric

_FEATURES = (
    "d.doc_id, lang, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces, "
    "CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS stops"
)
DOCS = (
    f"SELECT {_FEATURES}, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS grade "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)
D = f"WITH d AS ({DOCS}) "
ALL = f"SELECT {_FEATURES} FROM documents d"
A = f"WITH d AS ({ALL}) "


def docs(spark, folder):
    """Labelled documents with simple features, where a grade is learnt."""
    text = DOCS.replace("documents d", "{documents} d").replace("labels l", "{labels} l")
    return spark.sql(text, documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels"))


def all_docs(spark, folder):
    """All documents with the same features."""
    return spark.sql(ALL.replace("documents d", "{documents} d"), documents=table(spark, folder, "documents"))


def options(task=M.CLASSIFICATION, **more) -> T.TrainOptions:
    target = "grade" if task == M.CLASSIFICATION else "n_chars"
    given = {"task": task, "target": target, "tune": False, "folds": 2, "explain": False, "key": ["doc_id"]} | more
    return T.TrainOptions(**given)


def fitted(spark, folder, algorithm, params=None, task=M.CLASSIFICATION):
    """Train one algorithm and score its test rows."""
    rows = docs(spark, folder) if task == M.CLASSIFICATION else all_docs(spark, folder)
    train, test, encoder, labels, facts, _ = T.prepare(rows, options(task))
    model = T.fit(algorithm, train, facts, params or {}, 42)
    return model.transform(test)


def predictions(spark, folder, algorithm, params=None, task=M.CLASSIFICATION):
    scored = fitted(spark, folder, algorithm, params, task)
    return rounded(scored.select("doc_id", "label", "prediction"))


# ---------------------------------------------------------------- preparation


@query("training_validation", D + "SELECT 'grade' AS target, count(*) AS rows FROM d")
def _(spark, folder):
    rows = docs(spark, folder)
    return rows.agg(F.lit(encode.validate_training(rows)).alias("target"), F.count("*").alias("rows"))


@query(
    "scale_and_one_hot",
    A + "SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM d)) / (SELECT stddev_pop(n_chars) FROM d), 6) AS z, "
    "CAST(lang = 'de' AS DOUBLE) AS de, CAST(lang = 'en' AS DOUBLE) AS en, CAST(lang = 'es' AS DOUBLE) AS es, CAST(lang = 'fr' AS DOUBLE) AS fr FROM d",
)
def _(spark, folder):
    rows = all_docs(spark, folder).select("doc_id", "n_chars", "lang")
    encoder = encode.fit_encoder(rows.drop("doc_id"))
    x = vector_to_array("features")
    return rounded(
        encoder.transform(rows).select(
            "doc_id", F.get(x, F.lit(0)).alias("z"),
            *[F.get(x, F.lit(encoder.names.index(f"lang_{c}"))).alias(c) for c in ("de", "en", "es", "fr")],
        )
    )


@query("target_encoding", A + "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS label FROM d")
def _(spark, folder):
    rows = all_docs(spark, folder)
    return encode.with_label(rows, "lang", encode.fit_labels(rows, "lang")).select("doc_id", "lang", "label")


@query("train_test_split", D + "SELECT grade, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test, count(*) - CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS train FROM d GROUP BY grade")
def _(spark, folder):
    train, test = encode.split_rows(docs(spark, folder), "grade", key=["doc_id"])
    sides = test.select("grade", F.lit(1).alias("t")).unionByName(train.select("grade", F.lit(0).alias("t")))
    return sides.groupBy("grade").agg(F.sum("t").alias("test"), F.sum(1 - F.col("t")).alias("train"))


@query(
    "dataset_facts",
    D + "SELECT count(*) AS rows, CASE WHEN count(*) < 1000 THEN 'small' WHEN count(*) < 10000 THEN 'medium' ELSE 'large' END AS size, 3 > 0.5 * count(*) AS high_dimensional FROM d",
)
def _(spark, folder):
    facts = M.Facts(docs(spark, folder).count(), 3, M.CLASSIFICATION, 2)
    return spark.createDataFrame([(facts.rows, facts.size, facts.high_dimensional)], "rows bigint, size string, high_dimensional boolean")


@query(
    "algorithm_selection",
    D + "SELECT unnest(CASE WHEN count(*) < 1000 THEN ['logistic_regression', 'decision_tree', 'knn'] WHEN count(*) < 10000 THEN "
    "['random_forest', 'gradient_boosting', 'logistic_regression'] ELSE ['random_forest', 'neural_network', 'gradient_boosting'] END) AS algorithm FROM d",
)
def _(spark, folder):
    facts = M.Facts(docs(spark, folder).count(), 3, M.CLASSIFICATION, 2)
    return spark.createDataFrame([(n,) for n in M.choose_algorithms(facts)], "algorithm string")


# ---------------------------------------------------------------- models


def quantity_price(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("(l_quantity - 25) / 14 AS x", "l_extendedprice / 10000 + l_quantity / 5 AS label")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)


_QP = "WITH q AS (SELECT (l_quantity - 25) / 14 AS x, l_extendedprice / 10000 + l_quantity / 5 AS y FROM lineitem) "


def line_of(spark, folder, name, params):
    rows = quantity_price(spark, folder)
    seen = rows.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    model = M.build(name, M.Facts(seen["n"], 1, M.REGRESSION, label_std=seen["s"]), params).fit(rows)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


@query("linear_regression", _QP + "SELECT round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM q")
def _(spark, folder):
    return rounded(line_of(spark, folder, "linear_regression", {}), 5)


@query(
    "ridge_regression",
    _QP + "SELECT round(s, 5) AS slope, round(my - s * mx, 5) AS intercept FROM (SELECT regr_sxy(y, x) / (regr_sxx(y, x) + 5000.0) AS s, avg(y) AS my, avg(x) AS mx FROM q)",
)
def _(spark, folder):
    return rounded(line_of(spark, folder, "ridge", {"alpha": 5000.0}), 5)


@query(
    "lasso_regression",
    _QP + "SELECT round(s, 3) AS slope, round(my - s * mx, 3) AS intercept FROM (SELECT (regr_sxy(y, x) / count(*) - 0.5) / (regr_sxx(y, x) / count(*)) AS s, avg(y) AS my, avg(x) AS mx FROM q)",
)
def _(spark, folder):
    return rounded(line_of(spark, folder, "lasso", {"alpha": 0.5}), 3)


@query("logistic_regression")
def _(spark, folder):
    return predictions(spark, folder, "logistic_regression")


@query("decision_tree")
def _(spark, folder):
    return predictions(spark, folder, "decision_tree")


@query("decision_tree_regression")
def _(spark, folder):
    return predictions(spark, folder, "decision_tree", task=M.REGRESSION)


@query("random_forest")
def _(spark, folder):
    return predictions(spark, folder, "random_forest", {"trees": 20, "max_depth": 5})


@query("random_forest_regression")
def _(spark, folder):
    return predictions(spark, folder, "random_forest", {"trees": 20, "max_depth": 5}, M.REGRESSION)


@query("gradient_boosting")
def _(spark, folder):
    return predictions(spark, folder, "gradient_boosting", {"rounds": 5})


@query("gradient_boosting_regression")
def _(spark, folder):
    return predictions(spark, folder, "gradient_boosting", {"rounds": 5}, M.REGRESSION)


@query("support_vectors")
def _(spark, folder):
    return predictions(spark, folder, "svm")


@query("neural_network")
def _(spark, folder):
    return predictions(spark, folder, "neural_network", {"max_iter": 20})


@query("nearest_neighbour_classifier")
def _(spark, folder):
    return predictions(spark, folder, "knn")


@query("model_registry")
def _(spark, folder):
    facts = M.Facts(docs(spark, folder).count(), 3, M.CLASSIFICATION, 2)
    rows = [(n, type(M.build(n, facts)).__name__, str(M.DEFAULTS[n])) for n in M.available(M.CLASSIFICATION) if n != "knn"]
    return spark.createDataFrame(rows, "algorithm string, estimator string, defaults string")


# ---------------------------------------------------------------- tuning and comparing


@query("parameter_search")
def _(spark, folder):
    o = options(trials=2)
    train, _, _, _, facts, _ = T.prepare(docs(spark, folder), o)
    return spark.createDataFrame([(str(T.tune("logistic_regression", train, facts, o)),)], "params string")


@query("cross_validation")
def _(spark, folder):
    o = options()
    train, _, _, _, facts, _ = T.prepare(docs(spark, folder), o)
    return rounded(spark.createDataFrame([(T.cross_validate("decision_tree", train, facts, {}, o),)], "score double"))


@query("train_and_compare")
def _(spark, folder):
    o = options()
    train, test, _, _, facts, _ = T.prepare(docs(spark, folder), o)
    done, failed = T.train_many(["logistic_regression", "decision_tree"], train, test, facts, o)
    rows = [(t.algorithm, t.train_score, t.test_score, t.cv_score, t.overfitting) for t in done]
    return rounded(spark.createDataFrame(rows, "algorithm string, train_score double, test_score double, cv_score double, overfitting string"))


# ---------------------------------------------------------------- evaluation

SCORED = (
    "SELECT doc_id, toxic AS label, CASE WHEN doc_id % 7 < 2 THEN 1 - toxic ELSE toxic END AS prediction, CAST((doc_id * 37 + toxic * 300) % 1000 AS DOUBLE) / 10 AS score FROM labels"
)


def scored_labels(spark, folder):
    return spark.sql(SCORED.replace("labels", "{labels}"), labels=table(spark, folder, "labels"))


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM ({SCORED}) GROUP BY 1, 2")
def _(spark, folder):
    return metrics.confusion_matrix(scored_labels(spark, folder))


@query(
    "classification_metrics",
    f"WITH s AS ({SCORED}), c AS (SELECT DISTINCT label AS c FROM s), p AS (SELECT c, count(CASE WHEN label = c THEN 1 END) AS n, "
    "count(CASE WHEN label = c AND prediction = c THEN 1 END) / count(CASE WHEN prediction = c THEN 1 END) AS pr, "
    "count(CASE WHEN label = c AND prediction = c THEN 1 END) / count(CASE WHEN label = c THEN 1 END) AS re FROM s, c GROUP BY c) "
    "SELECT round((SELECT avg(CAST(label = prediction AS INTEGER)) FROM s), 6) AS accuracy, round(sum(pr * n) / sum(n), 6) AS precision, "
    "round(sum(re * n) / sum(n), 6) AS recall, round(sum(n * 2 * pr * re / (pr + re)) / sum(n), 6) AS f1 FROM p",
)
def _(spark, folder):
    return rounded(metrics.classification_metrics(scored_labels(spark, folder)))


@query(
    "roc_auc",
    f"WITH s AS ({SCORED}) SELECT round((sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)) / count(*), 6) AS auc "
    "FROM s p JOIN s n ON p.label = 1 AND n.label = 0",
)
def _(spark, folder):
    return rounded(metrics.roc_auc(scored_labels(spark, folder), "score"))


_REG = "SELECT l_extendedprice AS label, l_quantity * 2000 AS prediction FROM lineitem"


@query(
    "regression_metrics",
    f"SELECT round(avg(power(label - prediction, 2)), 1) AS mse, round(sqrt(avg(power(label - prediction, 2))), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae, "
    f"round(1 - avg(power(label - prediction, 2)) / var_pop(label), 6) AS r2 FROM ({_REG})",
)
def _(spark, folder):
    rows = spark.sql(_REG.replace("lineitem", "{lineitem}"), lineitem=table(spark, folder, "lineitem"))
    return rounded(metrics.regression_metrics(rows), 4, mse=1, r2=6)


@query(
    "overfitting_bands",
    D + "SELECT lang, CASE WHEN 0.9 - avg(CAST(grade = 'good' AS INTEGER)) < 0.05 THEN 'low' WHEN 0.9 - avg(CAST(grade = 'good' AS INTEGER)) < 0.15 THEN 'medium' ELSE 'high' END AS band "
    "FROM d GROUP BY lang",
)
def _(spark, folder):
    shares = docs(spark, folder).groupBy("lang").agg(F.avg((F.col("grade") == "good").cast("int")).alias("s")).collect()
    return spark.createDataFrame([(x["lang"], metrics.overfitting_band(0.9, x["s"])) for x in shares], "lang string, band string")


# ---------------------------------------------------------------- explanation

_ATT = (
    "SELECT doc_id AS row, CAST(0 AS INTEGER) AS feature, round(0.5 * (n_chars - (SELECT avg(n_chars) FROM d)), 4) AS attribution FROM d UNION ALL "
    "SELECT doc_id, 1, round(-2.0 * (spaces - (SELECT avg(spaces) FROM d)), 4) FROM d"
)


def linear_found(spark, folder):
    rows = all_docs(spark, folder).select(F.col("doc_id").alias("row"), F.array("n_chars", "spaces").alias("x"))
    assembled = VectorAssembler(inputCols=["n_chars", "spaces"], outputCol="features").transform(all_docs(spark, folder))
    return explain.linear_attributions([0.5, -2.0], explain.feature_means(assembled), rows)


@query("linear_attributions", A + _ATT)
def _(spark, folder):
    return rounded(linear_found(spark, folder), 4)


@query(
    "feature_importance",
    A + f", a AS ({_ATT.replace('round(', '(').replace(', 4)', ')')}) SELECT feature, round(i / sum(i) OVER (), 6) AS share FROM (SELECT feature, avg(abs(attribution)) AS i FROM a GROUP BY feature)",
)
def _(spark, folder):
    found = explain.mean_attributions(linear_found(spark, folder)).collect()
    total = sum(x["importance"] for x in found)
    return rounded(spark.createDataFrame([(x["feature"], x["importance"] / total) for x in found], "feature int, share double"))


def explained(spark, folder):
    train, _, encoder, _, facts, _ = T.prepare(docs(spark, folder), options())
    model = T.fit("decision_tree", train, facts, {}, 42)
    return explain.attributions(model, train, facts.features, facts, 20), explain.explained_rows(train, 20, 42), encoder.names


@query(
    "tree_attributions",
    """
    WITH q AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS a, CAST(l_discount > 0.05 AS INTEGER) AS b, l_extendedprice + 4000 * l_quantity AS y FROM lineitem),
    f AS (
      SELECT g.a, g.b, avg(y) AS ab, any_value(m.y0) AS none, any_value(m.n) AS n FROM q g, (SELECT avg(y) AS y0, count(*) AS n FROM q) m GROUP BY g.a, g.b
    ),
    fa AS (SELECT a, avg(y) AS v, count(*) AS n FROM q GROUP BY a),
    fb AS (SELECT f.b, sum(fa.n * f.ab) / sum(fa.n) AS v FROM f JOIN fa ON f.a = fa.a GROUP BY f.b),
    v AS (
      SELECT 2 * f.a + f.b AS row, ((fa.v - f.none) + (f.ab - fb.v)) / 2 AS x0, ((fb.v - f.none) + (f.ab - fa.v)) / 2 AS x1
      FROM f JOIN fa ON f.a = fa.a JOIN fb ON f.b = fb.b
    )
    SELECT CAST(row AS BIGINT) AS row, 0 AS feature, round(x0, 4) AS attribution FROM v
    UNION ALL SELECT CAST(row AS BIGINT), 1, round(x1, 4) FROM v
    """,
)
def _(spark, folder):
    """Two splits of all order lines: the tree's nodes are the groups' means."""
    rows = table(spark, folder, "lineitem").selectExpr("double(l_quantity > 25) AS a", "double(l_discount > 0.05) AS b", "double(l_extendedprice + 4000 * l_quantity) AS label")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    model = M.build("decision_tree", M.Facts(0, 2, M.REGRESSION), {"max_depth": 2}).fit(rows)
    kinds = rows.select((2 * F.col("a") + F.col("b")).cast("long").alias("row"), vector_to_array("features").alias("x")).distinct()
    return rounded(trees.tree_attributions(model, kinds), 4)


@query("sampled_attributions")
def _(spark, folder):
    return rounded(explained(spark, folder)[0])


@query("attribution_plot_data")
def _(spark, folder):
    found, rows, names = explained(spark, folder)
    return rounded(explain.plot_tables(found, rows, names)["waterfall"])


# ---------------------------------------------------------------- scoring


@query("save_load_predict")
def _(spark, folder):
    rows = docs(spark, folder)
    result = T.train_models(rows, options(algorithm="logistic_regression"))
    path = scratch(spark, "model")
    T.save(result, path)
    return rounded(T.load(spark, path).predict(all_docs(spark, folder)))


@query("batch_prediction")
def _(spark, folder):
    rows = docs(spark, folder)
    result = T.train_models(rows, options(algorithm="decision_tree"))
    return rounded(T.score_rows(result, all_docs(spark, folder)))


@query("class_probabilities", A + "SELECT doc_id, 1.0::DOUBLE AS total FROM d")
def _(spark, folder):
    rows = docs(spark, folder)
    scored = T.score_rows(T.train_models(rows, options(algorithm="logistic_regression")), all_docs(spark, folder))
    return scored.select("doc_id", F.round(F.col("probability_good") + F.col("probability_poor"), 6).alias("total"))


@query("feature_type_check", "SELECT o_orderkey, o_totalprice AS total FROM orders")
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("total"))
    return coerce_numeric(rows, ["total"])


@query("automatic_training")
def _(spark, folder):
    o = options(top_k=2, explain=True, explained_rows=10)
    result = T.train_models(docs(spark, folder), o)
    return rounded(T.comparison_frame(spark, result))
