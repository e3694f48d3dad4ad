"""Training, evaluation, explanation and scoring on seeded frames."""

import pytest
from pyspark.sql import functions as F

from tablewright.learning import explain, metrics
from tablewright.learning import models as M
from tablewright.learning import train as T
from tablewright.learning.encode import fit_encoder, validate_training
from tablewright.plans.aggregates import measure


def noise(seed, scale=1.0):
    return (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0 - 0.5) * scale


@pytest.fixture(scope="module")
def classes(spark):
    rows = spark.range(0, 200, 1, 2).select(
        "id", noise(1, 10).alias("a"), noise(2, 4).alias("b"), F.when(F.col("id") % 2 == 0, "X").otherwise("Y").alias("c")
    )
    return rows.withColumn("target", F.when(F.col("a") + F.col("b") > 0, "yes").otherwise("no")).drop("id").cache()


@pytest.fixture(scope="module")
def prices(spark):
    rows = spark.range(0, 200, 1, 2).select("id", noise(3, 10).alias("x1"), noise(4, 6).alias("x2"))
    return rows.withColumn("target", 2 * F.col("x1") + 3 * F.col("x2") + noise(5, 0.1)).drop("id").cache()


def quick(**more):
    return T.TrainOptions(**({"tune": False, "folds": 2, "explain": False} | more))


def test_classification_end_to_end(spark, classes, tmp_path):
    result = T.train_models(classes, quick(algorithm="logistic_regression", explain=True, explained_rows=20))
    assert result.metrics["accuracy"] > 0.85 and 0.9 < result.metrics["roc_auc"] <= 1.0
    assert result.importance[0][0] == "a" and sum(v for _, v in result.importance) == pytest.approx(1.0)
    T.save(result, str(tmp_path / "m"))
    again = T.load(spark, str(tmp_path / "m"))
    first = T.score_rows(result, classes).orderBy("a", "b").collect()
    second = again.predict(classes).orderBy("a", "b").collect()
    assert first == second
    assert again.info["target"] == "target" and again.info["version"] == "1.0"
    assert {"prediction", "probability_yes", "probability_no"} <= set(first[0].asDict())


def test_regression_end_to_end(spark, prices):
    result = T.train_models(prices, quick(task="regression", algorithm="linear_regression", explain=True, explained_rows=20))
    assert result.metrics["r2"] > 0.99
    assert result.best.overfitting == "low"
    assert "prediction" in T.score_rows(result, prices.drop("target")).columns


def test_comparison_records_failures(spark, classes):
    train, test, *_, facts, _ = T.prepare(classes, quick())
    done, failed = T.train_many(["decision_tree", "no_such_model"], train, test, facts, quick())
    assert [t.algorithm for t in done] == ["decision_tree"] and "no_such_model" in failed
    with pytest.raises(RuntimeError):
        T.train_many(["no_such_model"], train, test, facts, quick())


def test_unknown_category_is_all_zeros(spark, classes):
    encoder = fit_encoder(classes, "target")
    other = classes.limit(1).withColumn("c", F.lit("never seen"))
    vector = encoder.transform(other).first()["features"].toArray()
    assert list(vector[2:]) == [0.0, 0.0] and encoder.names == ["a", "b", "c_X", "c_Y"]


def test_scaling_uses_the_population_deviation(spark, prices):
    encoder = fit_encoder(prices, "target")
    from pyspark.ml.functions import vector_to_array

    v = encoder.transform(prices).select(F.get(vector_to_array("features"), F.lit(0)).alias("z"))
    seen = measure(v, {"m": F.avg("z"), "s": F.stddev_pop("z")})
    assert seen["m"] == pytest.approx(0.0, abs=1e-9) and seen["s"] == pytest.approx(1.0)


def test_validation(spark, classes):
    assert validate_training(classes) == "target"
    with pytest.raises(ValueError, match="not found"):
        validate_training(classes, "nope")
    with pytest.raises(ValueError, match="missing values: a"):
        validate_training(classes.withColumn("a", F.when(F.col("a") > 0, F.col("a"))))
    with pytest.raises(ValueError, match="too few"):
        validate_training(classes.limit(5))


@pytest.mark.parametrize("bad", [{"top_k": 0}, {"trials": 0}, {"folds": 1}, {"test_share": 1.0}, {"explained_rows": 0}, {"task": "guess"}])
def test_option_checks(bad):
    with pytest.raises(ValueError):
        T.TrainOptions(**bad)


def test_scoring_checks(spark, classes):
    result = T.train_models(classes, quick(algorithm="decision_tree"))
    with pytest.raises(ValueError, match="missing features: b"):
        T.score_rows(result, classes.drop("b"))
    with pytest.raises(ValueError, match="not numeric"):
        T.score_rows(result, classes.withColumn("a", F.lit("many")))
    text = classes.withColumn("a", F.concat(F.lit(" "), F.col("a").cast("string")))
    assert T.score_rows(result, text).count() == classes.count()


def test_selection():
    small = M.Facts(500, 5, M.CLASSIFICATION, 2)
    assert M.choose_algorithms(small) == ["logistic_regression", "decision_tree", "knn"]
    wide = M.Facts(500, 300, M.CLASSIFICATION, 2)
    assert M.choose_algorithms(wide, 2) == ["random_forest", "gradient_boosting"]
    assert "neural_network" not in M.choose_algorithms(M.Facts(10**6, 5, M.CLASSIFICATION, 2), 9, neural=False)
    assert len(M.choose_algorithms(M.Facts(10**6, 5, M.REGRESSION), 6)) == 6


def test_parameter_draws_are_seeded():
    assert M.draw_parameters("random_forest", 5, 1) == M.draw_parameters("random_forest", 5, 1)
    assert M.draw_parameters("random_forest", 5, 1) != M.draw_parameters("random_forest", 5, 2)
    assert M.draw_parameters("linear_regression", 5, 1) == [{}]


@pytest.mark.parametrize("a,b,wanted", [(0.9, 0.88, "low"), (0.9, 0.8, "medium"), (0.9, 0.7, "high")])
def test_overfitting(a, b, wanted):
    assert metrics.overfitting_band(a, b) == wanted


def test_auc_large_path(spark, small_blocks):
    rows = spark.range(0, 2000, 1, 3).select((F.col("id") % 2).alias("label"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 50 + F.col("id") % 2 * 10).alias("s"))
    pdf = rows.toPandas()
    r = pdf["s"].rank()
    ones = int(pdf["label"].sum())
    wanted = (r[pdf["label"] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(pdf) - ones))
    assert metrics.roc_auc(rows, "s").first()["auc"] == pytest.approx(wanted)


def test_sampled_attributions_agree_with_exact_ones(spark, prices):
    train, _, encoder, _, facts, _ = T.prepare(prices, quick(task="regression"))
    model = T.fit("linear_regression", train, facts, {}, 42)
    rows = explain.explained_rows(train, 5, 1)
    mean = spark.createDataFrame([(explain.feature_means(train),)], "x array<double>")
    sampled = explain.sampled_attributions(model, rows, mean, 2, facts, 7)
    exact = explain.linear_attributions([float(w) for w in model.coefficients], explain.feature_means(train), rows)
    a = {(r["row"], r["feature"]): r["attribution"] for r in sampled.collect()}
    b = {(r["row"], r["feature"]): r["attribution"] for r in exact.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_scoring_a_stream(spark, classes, tmp_path):
    from tablewright.learning.train import predict
    from tablewright.streaming.rowlocal import write_stream

    result = T.train_models(classes, quick(algorithm="decision_tree"))
    source = str(tmp_path / "in")
    classes.write.parquet(source)
    stream = spark.readStream.schema(classes.schema).parquet(source)
    scored = predict(stream, result.encoder, result.best.model, result.labels, checked=False)
    write_stream(scored, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == classes.count()


def test_auc_leaves_out_missing_scores_and_classes(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("label"), (F.col("id") % 50 + F.col("id") % 2 * 10).cast("double").alias("s"))
    gaps = spark.createDataFrame([(1, None)] * 30 + [(None, 3.0)] * 5, "label long, s double")
    assert metrics.roc_auc(rows.unionByName(gaps), "s").first()["auc"] == metrics.roc_auc(rows, "s").first()["auc"]


def test_three_classes_are_explained_and_gaps_scored(spark):
    rows = spark.range(0, 240, 1, 2).select("id", noise(1, 10).alias("a"), noise(2, 4).alias("b"))
    rows = rows.withColumn("target", F.when(F.col("a") > 2, "x").when(F.col("a") < -2, "y").otherwise("z")).drop("id")
    result = T.train_models(rows, quick(algorithm="logistic_regression", explain=True, explained_rows=5))
    assert result.importance[0][0] == "a"
    mean = rows.agg(F.avg("a")).first()[0]
    odd = spark.createDataFrame([(None, 1.0), (mean, 1.0), (float("nan"), 1.0)], "a double, b double")
    scored = T.score_rows(result, odd).collect()
    assert len({r["prediction"] for r in scored}) == 1 and all(r["prediction"] is not None for r in scored)
    texts = spark.createDataFrame([(" 4.5", 1.0)], "a string, b double")
    assert T.score_rows(result, texts).first()["prediction"] == "x"


def known_value(tree, at, x, known, output):
    """The mean of a tree's output when only some features are known, by walking it."""
    node = tree[at]
    if node["left"] < 0:
        return node["values"][output]
    sides = ("left", "right")
    if node["feature"] in known:
        goes = x[node["feature"]] <= node["threshold"]
        return known_value(tree, node[sides[0 if goes else 1]], x, known, output)
    return sum(tree[node[s]]["rows"] / node["rows"] * known_value(tree, node[s], x, known, output) for s in sides)


@pytest.mark.parametrize("kind", ["tree", "tree_classes", "forest_classes", "forest", "boosted", "boosted_classes"])
def test_tree_attributions_against_all_subsets(spark, kind):
    from itertools import combinations
    from math import factorial

    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler

    from tablewright.learning.trees import node_table, tree_attributions

    rows = spark.range(0, 300, 1, 2).select(*[F.round(noise(i, 6), 1).alias(f"x{i}") for i in range(4)])
    three = F.when(F.col("x0") + F.col("x1") > 1, 2.0).when(F.col("x2") > 0, 1.0).otherwise(0.0)
    label = {"tree_classes": three, "forest_classes": three, "boosted_classes": (three > 0).cast("double")}.get(kind, F.col("x0") * F.col("x1") + F.col("x2"))
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(rows.withColumn("label", label)).cache()
    model = {
        "tree": R.DecisionTreeRegressor(maxDepth=5),
        "tree_classes": C.DecisionTreeClassifier(maxDepth=4),
        "forest": R.RandomForestRegressor(numTrees=4, maxDepth=4, seed=1),
        "forest_classes": C.RandomForestClassifier(numTrees=4, maxDepth=4, seed=1),
        "boosted": R.GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.3, seed=1),
        "boosted_classes": C.GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.3, seed=1),
    }[kind].fit(data)
    picked = explain.explained_rows(data, 12, 3)
    points = {r["row"]: r["x"] for r in picked.collect()}
    got = {(r["row"], r["feature"]): r["attribution"] for r in tree_attributions(model, picked).collect()}
    trees = {}
    for n in node_table(model, spark).collect():
        trees.setdefault(n["tree"], {})[n["id"]] = n
    weights = list(model.treeWeights) if hasattr(model, "trees") else [1.0]
    if kind.startswith("forest"):
        weights = [1 / len(weights)] * len(weights)
    outputs = len(next(iter(trees.values()))[0]["values"])
    for row, x in points.items():
        def worth(known, output):
            return sum(weights[t] * known_value(tree, 0, x, known, output) for t, tree in trees.items())

        output = 0 if outputs == 1 else max(range(outputs), key=lambda c: worth({0, 1, 2, 3}, c))
        for i in range(4):
            others, want = [j for j in range(4) if j != i], 0.0
            for n in range(4):
                for s in combinations(others, n):
                    want += factorial(n) * factorial(3 - n) / factorial(4) * (worth({*s, i}, output) - worth(set(s), output))
            assert got[(row, i)] == pytest.approx(want, abs=1e-9)
        total = sum(got[(row, i)] for i in range(4))
        assert total == pytest.approx(worth({0, 1, 2, 3}, output) - worth(set(), output), abs=1e-9)
    scored = {tuple(r["features"].toArray()): r for r in model.transform(data).collect()}
    for x in points.values():
        r = scored[tuple(x)]
        score = sum(weights[t] * known_value(tree, 0, x, {0, 1, 2, 3}, int(r["prediction"]) if outputs > 1 else 0) for t, tree in trees.items())
        if "classes" not in kind:
            assert r["prediction"] == pytest.approx(score)
        elif outputs > 1:
            assert max(r["probability"]) == pytest.approx(score)
        else:
            assert r["rawPrediction"][1] == pytest.approx(score)


def test_a_category_of_many_levels_is_hashed(spark, monkeypatch):
    from tablewright.learning import encode

    monkeypatch.setattr(encode, "MAX_LEVELS", 50)
    monkeypatch.setattr(encode, "HASHED", 64)
    rows = spark.range(0, 2000, 1, 2).select((F.col("id") % 400).cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"), (F.col("id") * 1.0).alias("x"))
    encoder = fit_encoder(rows)
    assert encoder.names[:4] == ["x", "few_0", "few_1", "few_2"] and len(encoder.names) == 4 + 64
    found = encoder.transform(rows.limit(50).unionByName(spark.createDataFrame([(None, "0", 0.0), ("new", None, 0.0)], rows.schema))).collect()
    assert all(r["features"].size == 68 for r in found)
    assert [sum(r["features"].toArray()[4:]) for r in found] == [1.0] * 50 + [0.0, 1.0]
    exact = fit_encoder(rows.where("many < 3").withColumn("many", F.col("few")))
    assert len(exact.names) == 1 + 6


def test_split_of_thousands_of_classes(spark):
    from tablewright.learning.encode import split_rows

    rows = spark.range(0, 30_000, 1, 4).select("id", (F.col("id") % 5000).cast("string").alias("c"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], rows.schema))
    train, test = split_rows(rows, "c", 0.2, key=["id"])
    sizes = {r["c"]: r["count"] for r in test.groupBy("c").count().collect()}
    assert len(sizes) == 5000 and set(sizes.values()) == {1}
    assert train.count() == 25_001 and train.columns == ["id", "c"] and train.join(test, "id").count() == 0


def test_a_large_table_is_stored_once_and_dealt_to_tasks(spark, monkeypatch):
    """After the check for gaps every pass of a training reads stored rows, in many tasks."""
    monkeypatch.setattr(T, "TASK_ROWS", 100, raising=False)
    seen = spark.sparkContext.accumulator(0)

    def noted(i):
        seen.add(1)
        return float(i % 7)

    rows = spark.range(600, numPartitions=2).select(
        "id", F.udf(noted, "double")("id").alias("x"), F.expr("sin(id)").alias("z"), F.expr("if(id % 7 > 3, 'a', 'b')").alias("target")
    )
    found = T.train_models(rows, T.TrainOptions(target="target", algorithm="decision_tree", tune=False, folds=2, explain=False, key=["id"]))
    assert seen.value <= 2 * 600
    assert found.train_rows.rdd.getNumPartitions() == 6
    assert found.train_rows.count() + found.test_rows.count() == 600
    assert found.best.test_score == 1.0 and found.best.cv_score == 1.0
    assert found.metrics["roc_auc"] == 1.0
