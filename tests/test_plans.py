"""Order statistics, ranks and splits, on the paths of small and of large tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.learning.encode import split_rows
from tablewright.operators import correlate, select
from tablewright.operators.select import page, row_range, sample_values
from tablewright.plans import orderstats, ranks
from tablewright.plans.analysis import analyze
from tablewright.session import cut_lineage


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value; the rest is spread, with nulls."""
    v = F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.xxhash64("id") % 100000) / 10.0)
    rows = spark.range(0, 3000, 1, 5).select("id", F.when(F.col("id") % 50 != 1, v).alias("v"), (F.col("id") % 4).alias("g"))
    return rows.cache()


def values(skewed):
    return np.sort(skewed.where("v is not null").toPandas()["v"].to_numpy())


def test_index_quantiles_large_path(skewed, small_blocks):
    v = values(skewed)
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    assert orderstats.index_quantiles(skewed, ["v"], shares)["v"] == [v[int(len(v) * q)] for q in shares]


def test_interpolated_quantiles_both_paths(skewed, monkeypatch):
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    wanted = np.quantile(values(skewed), shares)
    assert np.allclose(orderstats.interpolated_quantiles(skewed, ["v"], shares)["v"], wanted)
    monkeypatch.setattr(orderstats, "DIRECT_ROWS", 150)
    monkeypatch.setattr(orderstats, "SKETCH_ACCURACY", 20)
    assert np.allclose(orderstats.interpolated_quantiles(skewed, ["v"], shares)["v"], wanted)


def test_wrong_sketch_still_gives_exact_values(skewed, monkeypatch):
    """Brackets are proven by counts, so a useless sketch costs passes, not correctness."""
    monkeypatch.setattr(orderstats, "DIRECT_ROWS", 50)
    monkeypatch.setattr(orderstats, "SKETCH_ACCURACY", 3)
    v = values(skewed)
    assert orderstats.index_quantiles(skewed, ["v"], [0.5, 0.9])["v"] == [v[int(len(v) * q)] for q in (0.5, 0.9)]


def test_ranks_large_path(skewed, small_blocks):
    counted = skewed.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    splits = ranks.range_splits(skewed.where("v is not null"), F.col("v"), 3000)
    assert len(splits) > 3
    got = ranks.rank_values(counted, ["g"], "v", "n", splits).toPandas()
    pdf = skewed.where("v is not null").toPandas()
    pdf["rank"] = pdf.groupby("g")["v"].rank()
    wanted = pdf.groupby(["g", "v"])["rank"].first().reset_index()
    merged = got.merge(wanted, on=["g", "v"])
    assert len(merged) == len(wanted) == len(got)
    assert np.allclose(merged["rank_x"], merged["rank_y"])


def test_group_quantiles_large_path(skewed, small_blocks):
    got = {r["g"]: r["quantiles"] for r in ranks.group_quantiles(skewed, ["g"], "v", [0.25, 0.5], 3000).collect()}
    pdf = skewed.where("v is not null").toPandas()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], [0.25, 0.5]))


@pytest.mark.parametrize("partitions", [1, 2, 17])
def test_partitioning_changes_nothing(skewed, partitions):
    moved = skewed.repartition(partitions, "v")
    assert orderstats.index_quantiles(moved, ["v"], [0.3])["v"] == orderstats.index_quantiles(skewed, ["v"], [0.3])["v"]
    assert sample_values(moved, ["v"], key=["id"]) == sample_values(skewed, ["v"], key=["id"])
    a, b = (sorted(r["id"] for r in split_rows(d, "g", key=["id"])[1].collect()) for d in (moved, skewed))
    assert a == b


def test_sample_is_the_smallest_hashes(skewed):
    got = sample_values(skewed, ["v"], k=10, seed=5, key=["id"])["v"]
    rows = skewed.where("v is not null").orderBy(F.xxhash64("id", F.lit(5))).limit(10)
    assert got == [str(r["v"]) for r in rows.collect()]


def test_sample_of_copies_counts_them(spark):
    rows = spark.range(5).select(F.lit("yes").alias("v"))
    assert sample_values(rows) == {"v": ["yes"] * 5}


def test_split_is_stratified_and_complete(skewed):
    train, test = split_rows(skewed, "g", 0.2, key=["id"])
    assert train.count() + test.count() == 3000
    assert {r["g"]: r["count"] for r in test.groupBy("g").count().collect()} == {g: 150 for g in range(4)}
    assert train.join(test, "id").count() == 0


def test_deep_row_range(skewed, small_blocks, monkeypatch):
    monkeypatch.setattr(select, "SHALLOW_ROWS", 10)
    got = sorted(r["id"] for r in row_range(skewed.withColumn("id", F.col("id") * 3), 2500, 2600, "id").collect())
    assert got == [3 * i for i in range(2500, 2600)]
    rows, total = page(skewed, 2990, 500, "id")
    assert total == 3000 and rows.count() == 10


def test_spearman_with_nulls_and_ties(skewed, small_blocks):
    d = skewed.withColumn("w", F.when(F.col("id") % 7 != 0, F.col("id") % 11)).drop("g")
    got = correlate.spearman_pairs(d, ["id", "v", "w"])
    pdf = d.toPandas()
    for (a, b), (r, n) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both)
        assert r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-9)


def test_cut_lineage_uses_the_checkpoint_folder(spark):
    out = cut_lineage(spark.range(10))
    assert out.count() == 10 and spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize("kind", ["number", "text", "large"])
def test_row_ranges_agree_at_every_depth(spark, small_blocks, monkeypatch, kind):
    """Null keys come first, text keys and keys beyond 2^53 work, whichever way rows are found."""
    keys = {"number": F.col("id"), "text": F.lpad(F.col("id").cast("string"), 5, "0"), "large": F.col("id") + F.lit(2**60)}
    rows = spark.range(1000).select("id", F.when(F.col("id") % 250 != 7, keys[kind]).alias("k"))
    for start, end in ((0, 16), (2, 5), (150, 420), (996, 1100), (5, 5)):
        shallow = [r["k"] for r in select.row_range(rows, start, end, "k").collect()]
        with monkeypatch.context() as m:
            m.setattr(select, "SHALLOW_ROWS", 0)
            deep = [r["k"] for r in select.row_range(rows, start, end, "k").collect()]
        assert sorted(map(str, deep)) == sorted(map(str, shallow)) and len(shallow) == max(0, min(end, 1000) - start)


def test_group_quantiles_keep_the_null_group(spark, small_blocks):
    rows = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    large = ranks.group_quantiles(rows, ["g"], "v", [0.5], 900)
    small = ranks.group_quantiles(rows, ["g"], "v", [0.5], 1)  # few rows by its own account: one aggregation
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect())) and large.count() == 3


def test_analysis_reads_numbers_in_text(spark):
    rows = spark.range(200).select(F.col("id").alias("a"), F.when(F.col("id") % 40 == 0, "N/A").otherwise((F.col("id") * 2).cast("string")).alias("b"))
    found = analyze(rows)
    pair = found["pearson"].where("x = 'a' AND y = 'b'").first()
    assert abs(pair["value"] - 1) < 1e-9 and pair["n"] == 195


def test_lineage_is_cut_without_any_setting(tmp_path):
    """A local session whose configuration names no checkpoint folder."""
    import os
    import subprocess
    import sys

    code = (
        "from tablewright.session import cut_lineage, local_session, shared_folder\n"
        "spark = local_session(2)\n"
        "assert shared_folder(spark) == shared_folder(spark)\n"
        "print(cut_lineage(spark.range(5)).count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("5"), done.stderr[-2000:]


def test_queries_without_a_library_of_the_subpackage():
    """The entry point works where the subpackage can't be imported."""
    import os
    import subprocess
    import sys

    code = (
        "import sys\n"
        "sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert len(names) > 150 and not any(n.startswith('op1') for n in names) and 'pipeline' not in names\n"
        "print('fine')\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_text_keys_of_one_beginning_are_cut_evenly(spark, monkeypatch):
    """40,000 keys that share their first bytes give ranges of like size, in the order of the keys."""
    from tablewright.operators import select
    from tablewright.plans import ranks

    monkeypatch.setattr(ranks, "BUCKET_ROWS", 2000)
    monkeypatch.setattr(select, "SHALLOW_ROWS", 10)
    rows = spark.range(0, 40_000, 1, 4).select(F.concat(F.lit("http://example.org/"), F.sha1(F.col("id").cast("string").cast("binary"))).alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(None,), ("",), ("é",)], "k string"))
    splits = ranks.range_splits(rows, F.col("k"), 40_003)
    cut = ranks.with_bucket(rows, F.col("k"), splits)
    sizes = {r["bucket"]: r["count"] for r in cut.groupBy("bucket").count().collect()}
    assert len(sizes) >= 20 and max(sizes.values()) < 3 * 2000 and sizes[ranks.NULL_BUCKET] == 1
    edges = cut.groupBy("bucket").agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("bucket").collect()
    assert all(a["high"] is None or a["high"] < b["low"] for a, b in zip(edges, edges[1:]))
    wanted = [r["k"] for r in rows.orderBy("k").collect()]
    got = [r["k"] for r in select.row_range(rows, 15_000, 25_000, "k").orderBy("k").collect()]
    assert got == wanted[15_000:25_000]


def test_dashboard_names_its_tables(spark):
    from tablewright.operators.charts import dashboard

    original = spark.createDataFrame([(float(i % 7), "ab"[i % 2]) for i in range(40)] + [(None, None)], "v double, c string")
    processed = original.dropna()
    both = dashboard({"original": original, "processed": processed})
    assert {r.dataset for r in both.collect()} == {"original", "processed"}
    one = dashboard({"original": original, "processed": processed}, "processed").collect()
    assert {r.dataset for r in one} == {"processed"}
    assert sum(r.value for r in one if r.series == "categories" and r.column == "c") == 40
    with pytest.raises(ValueError, match="processed"):
        dashboard({"original": original}, "processed")
