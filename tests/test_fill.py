"""Filling, nearest neighbours and outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import impute as I
from tablewright.operators import knn
from tablewright.operators import outliers as O
from tablewright.operators.knn import knn_fill, knn_predict


def test_small_knn_case(spark):
    rows = [(1.0, 10.0), (2.0, 20.0), (3.0, None), (4.0, 40.0), (5.0, 50.0)]
    out = knn_fill(spark.createDataFrame(rows, "feature1 double, feature2 double"), "feature2", 2)
    assert {r["feature1"]: r["feature2"] for r in out.collect()}[3.0] == pytest.approx(30.0)


def test_knn_without_donors_or_features(spark):
    empty = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [r["b"] for r in knn_fill(empty, "b", 3).collect()] == [0.0, 0.0]
    alone = spark.createDataFrame([(1.0,), (3.0,), (None,)], "b double")
    assert sorted(r["b"] for r in knn_fill(alone, "b", 2).collect()) == [1.0, 2.0, 3.0]


def brute_fill(pdf, target, k):
    """Rows come in key order."""
    names = [c for c in pdf.columns if c != target]
    x, y = pdf[names].to_numpy(float), pdf[target].to_numpy(float)
    known = np.flatnonzero(~np.isnan(y))
    out = y.copy()
    for i in np.flatnonzero(np.isnan(y)):
        gap = x[known] - x[i]
        shared = (~np.isnan(gap)).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(shared > 0, np.sqrt(np.nansum(gap**2, 1) / shared), np.inf)
        best = np.argsort(dist, kind="stable")[:k]
        w = np.where(dist[best] < 1e-10, 1e10, 1 / dist[best])
        out[i] = (y[known][best] * w).sum() / w.sum() if w.sum() > 0 else np.nanmean(y)
    return out


@pytest.mark.parametrize("large", [False, True])
def test_knn_against_brute_force(spark, request, large):
    """Nulls in features, a third of all rows with equal features, and many ranges and chunks."""
    if large:
        request.getfixturevalue("small_blocks")
    hot = F.col("id") % 3 == 0
    rows = spark.range(0, 900, 1, 4).select(
        "id",
        F.when(hot, 5.0).when(F.col("id") % 11 != 1, F.col("id") * 17 % 101).alias("a"),
        F.when(hot, 5.0).when(F.col("id") % 7 != 2, F.col("id") * 31 % 57).alias("b"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 13 % 997).cast("double").alias("y"),
    )
    got = knn_fill(rows, "y", 4, "id", ["a", "b"]).orderBy("id").toPandas()
    wanted = brute_fill(rows.orderBy("id").toPandas()[["a", "b", "y"]], "y", 4)
    assert len(got) == 900
    assert np.allclose(got["y"], wanted)


def test_knn_model_votes(spark):
    train = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (5.0, 1.0), (5.2, 1.0), (4.9, 1.0)], "x double, label double")
    rows = spark.createDataFrame([(0.05,), (5.0,)], "x double")
    got = {r["x"]: r["prediction"] for r in knn_predict(train, rows, ["x"], "label", 3, classify=True).collect()}
    assert got == {0.05: 0.0, 5.0: 1.0}
    exact = knn_predict(train, rows, ["x"], "label", 3, weights="distance").collect()
    assert {r["x"]: r["prediction"] for r in exact}[5.0] == 1.0


@pytest.mark.parametrize("large", [False, True])
def test_neighbour_fills(spark, request, large):
    if large:
        request.getfixturevalue("small_blocks")
    rows = spark.range(0, 1000, 1, 3).select(
        "id", (F.col("id") % 2).alias("g"),
        # A gap longer than any range must be bridged by the carried cells.
        F.when((F.col("id") > 30) & ((F.col("id") < 400) | (F.col("id") % 9 == 0)) & (F.col("id") < 300), F.col("id") * 1.5).alias("v"),
        F.when(F.col("id") % 4 == 1, F.timestamp_seconds(F.col("id") * 60)).alias("ts"),
    )
    pdf = rows.orderBy("id").toPandas()
    got = I.forward_backward_fill(rows, ["v", "ts"], "id").orderBy("id").toPandas()
    assert (got["ts"] == pdf["ts"].ffill().bfill()).all()
    assert np.allclose(got["v"], pdf["v"].ffill().bfill())
    per = I.forward_backward_fill(rows, ["v"], "id", ["g"]).orderBy("id").toPandas()
    assert np.allclose(per["v"], pdf.groupby("g")["v"].transform(lambda s: s.ffill().bfill()))
    line = I.interpolate(rows, ["v"], "id").orderBy("id").toPandas()
    assert np.allclose(line["v"], pdf["v"].interpolate(limit_direction="both"))


def test_indicator_and_final_fill(spark):
    rows = spark.createDataFrame([("A", 1), (None, None), ("B", 3)], "c string, n int")
    assert sorted(r["c"] for r in I.indicator_fill(rows, ["c"]).collect()) == ["A", "B", "Missing"]
    final = I.final_fill(rows)
    assert all(v is not None for r in final.collect() for v in r)


def test_mode_ties_go_to_the_smaller_value(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert I.modes(rows, ["c"]) == {"c": "a"}


def test_outlier_treatments(spark):
    rows = spark.createDataFrame([(float(v),) for v in [*range(1, 10), 100]], "value double")
    assert O.treat_outliers(rows, ["value"], "cap_outliers").count() == 10
    assert O.treat_outliers(rows, ["value"], "remove_outliers").count() == 9
    assert O.replace_outliers(rows, ["value"]).agg(F.max("value")).first()[0] == 9.0
    keep = O.treat_outliers(rows, ["value"], "keep_outliers")
    assert sorted(map(str, keep.collect())) == sorted(map(str, rows.collect()))


def test_removal_is_sequential(spark):
    rows = spark.range(0, 400).select(
        F.when(F.col("id") < 40, 1000.0 + F.col("id")).otherwise((F.col("id") % 20).cast("double")).alias("a"),
        F.when(F.col("id") < 40, F.col("id") * 50.0).when(F.col("id") < 60, 30.0).otherwise((F.col("id") % 10).cast("double")).alias("b"),
    )
    one = O.remove_outliers(rows.select("a", "b"), ["a", "b"])
    step = O.remove_outliers(O.remove_outliers(rows, ["a"]), ["b"])
    assert one.count() == step.count()


def test_times_without_an_order_key_stay_times(spark):
    rows = spark.sql("SELECT 1 AS id, CAST(NULL AS TIMESTAMP) AS at UNION ALL SELECT 2, TIMESTAMP '2024-01-01'")
    out, log = I.impute(rows, {"at": "forward_fill"})
    out = I.final_fill(out)
    assert dict(out.dtypes)["at"] == "timestamp" and out.where("at IS NULL").count() == 1
    assert [a.action_type for a in log] == ["value_kept_missing"]


@pytest.mark.parametrize("small", [False, True])
def test_null_groups_and_keys_keep_their_rows(spark, small, request):
    if small:
        request.getfixturevalue("small_blocks")
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
        F.when(F.col("id") != 500, F.col("id")).alias("k"),
        F.when(F.col("id") != 500, F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0"))).alias("text_key"),
        F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("v"),
    )
    expected = {}
    for key in ("k", "text_key"):
        out = I.forward_backward_fill(rows, ["v"], key, ["g"])
        assert out.count() == 1000 and out.where("v IS NULL").count() == 0
        expected[key] = sorted((r["g"] or 0, r["k"] or -1, r["v"]) for r in out.collect())
    assert expected["k"] == expected["text_key"]
    assert (0, 6, 0.0) in expected["k"]
    assert I.interpolate(rows, ["v"], "k", ["g"]).count() == 1000


@pytest.mark.parametrize("metric", ["shared", "euclidean", "manhattan"])
def test_neighbours_by_boxes_against_all_pairs(spark, small_blocks, metric):
    """Many boxes, missing features, copies; few of all pairs are met."""
    rng = np.random.default_rng(5)
    donors = np.round(rng.normal(size=(6000, 3)) * [5, 1, 30], 2)
    queries = np.round(rng.normal(size=(300, 3)) * [5, 1, 30], 2)
    if metric == "shared":
        donors[rng.random(donors.shape) < 0.02] = np.nan
        queries[rng.random(queries.shape) < 0.02] = np.nan
    donors[100:150] = donors[7]

    def frame(rows, names):
        return [[None if x != x else float(x) for x in r] for r in rows], ", ".join(f"{n} double" for n in names)

    values, schema = frame(donors, ["f0", "f1", "f2"])
    held = spark.createDataFrame([(*v, i, float(i)) for i, v in enumerate(values)], schema + ", tie long, y double")
    values, schema = frame(queries, ["f0", "f1", "f2"])
    asked = spark.createDataFrame([(str(i), *v) for i, v in enumerate(values)], "qid string, " + schema)
    report = []
    got = {}
    for r in knn.nearest(asked, held, 3, 4, metric, report).collect():
        got.setdefault(int(r["qid"]), {})[r["place"]] = (r["tie"], r["distance"])
    gaps = knn._distances(queries, donors, metric)
    for i in range(len(queries)):
        want = sorted((gaps[i, j], j) for j in range(len(donors)))[:4]
        assert [got[i][p][1] for p in range(1, 5)] == pytest.approx([w[0] for w in want])
        if np.isfinite(want[-1][0]):
            assert [got[i][p][0] for p in range(1, 5)] == [w[1] for w in want]
    if metric != "shared":
        assert sum(r["pairs"] for r in report) < 0.35 * len(queries) * report[0]["donors"]


@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_fills_in_file_order(spark, tmp_path, split):
    """The same rows, whatever the splits; keys that fall show that they aren't used."""
    import datetime

    base = datetime.datetime(2020, 1, 1)
    rows = [(5000 - i, float(i) if i % 7 == 3 else None, base + datetime.timedelta(hours=i) if i % 5 == 2 else None) for i in range(3000)]
    body = "k,v,t\n" + "".join(f"{k},{'' if v is None else v},{'' if t is None else t.isoformat()}\n" for k, v, t in rows)
    (tmp_path / "a.csv").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.read.csv(str(tmp_path), header=True, schema="k int, v double, t timestamp")
        filled = {r["k"]: r["v"] for r in I.forward_backward_fill(df, ["v"]).collect()}
        between = {r["k"]: r["v"] for r in I.interpolate(df, ["v"]).collect()}
        out, log = I.impute(df, {"t": "automatic"})
        times = {r["k"]: r["t"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last, when = 3.0, base + datetime.timedelta(hours=2)
    for i, (k, v, t) in enumerate(rows):
        last, when = last if v is None else v, when if t is None else t
        assert filled[k] == last and times[k] == when
        assert between[k] == min(max(i, 3), 2999 - (2999 - 3) % 7)
    assert log[0].kind == "value_imputed" if hasattr(log[0], "kind") else log
    with pytest.raises(ValueError, match="order key"):
        I.forward_backward_fill(spark.createDataFrame([(1.0,)], "v double"), ["v"])


@pytest.mark.parametrize("metric", ["shared", "euclidean", "manhattan"])
@pytest.mark.parametrize("bounded", [False, True])
def test_a_block_is_searched_by_leaves(monkeypatch, metric, bounded):
    """A query meets few donors of its block, and the nearest are those of all pairs, ties in donor order."""
    rng = np.random.default_rng(3)
    donors, queries = rng.integers(0, 3000, (6000, 2)).astype(float), rng.integers(0, 3000, (300, 2)).astype(float)
    donors[:100], queries[:10] = 7.0, 7.0
    if metric == "shared":
        donors[200:900, 1], queries[20:60, 0] = np.nan, np.nan
    gaps = knn._distances(queries, donors, metric)
    wanted = np.argsort(gaps, axis=1, kind="stable")[:, :5]
    at = np.arange(len(queries))[:, None]
    bound = gaps[at, wanted][:, -1] if bounded else np.full(len(queries), np.inf)
    met, pair_distances = [], knn._pair_distances
    monkeypatch.setattr(knn, "_pair_distances", lambda q, d, m: met.append(len(q)) or pair_distances(q, d, m))
    row, donor, gap = knn.Leaves(donors, 5, metric).nearest(queries, bound)
    assert (row.reshape(-1, 5) == at).all() and (donor.reshape(-1, 5) == wanted).all()
    assert np.allclose(gap.reshape(-1, 5), gaps[at, wanted], atol=0)
    assert sum(met) < (0.5 if metric == "shared" else 0.15) * gaps.size
