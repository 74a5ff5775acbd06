import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lineax.operators import aggs, windows
from lineax.operators.features import task_vectors
from lineax.operators.ordinal import with_global_ordinal, with_group_ordinal
from lineax.plans.training import dedupe_cells


def test_global_ordinal_is_dense_and_partition_invariant(spark):
    base = spark.range(5000).withColumn("k", F.xxhash64("id"))
    a = {r.id: r.o for r in with_global_ordinal(base.repartition(3), ["k"], "o").collect()}
    b = {r.id: r.o for r in with_global_ordinal(base.repartition(17), ["k"], "o").collect()}
    assert a == b and sorted(a.values()) == list(range(5000))


def test_group_ordinal_with_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 7 + 1))
    got = with_group_ordinal(df, ["g"], ["id"], "k").groupBy("g").agg(F.min("k"), F.max("k"), F.count("*")).collect()
    for r in got:
        assert r[1] == 0 and r[2] == r[3] - 1


def test_scale_within_group(spark):
    rows = [("g1", float(i)) for i in range(21)] + [("g2", 5.0)] * 4
    out = windows.scale_within_group(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()
    g1 = {r.x: r.outcome for r in out if r.g == "g1"}
    assert g1[0.0] == 0.0 and g1[19.0] == 1.0 and g1[20.0] == 1.0 and abs(g1[9.5 - 0.5] - 9 / 19) < 1e-12
    assert all(r.outcome is None for r in out if r.g == "g2")


def test_first_seen_quantile_discrete(spark):
    d100 = [("h", f"2020-01-01") for _ in range(0)] + [("h", str(pd.Timestamp("2020-01-01") + pd.Timedelta(days=i))[:10]) for i in range(100)]
    df = spark.createDataFrame(d100, "k string, d string")
    assert str(aggs.first_seen_quantile(df, "k", "d").first().date_first) == "2020-01-01"
    d101 = d100 + [("h", "2021-01-01")]
    assert str(aggs.first_seen_quantile(spark.createDataFrame(d101, "k string, d string"), "k", "d").first().date_first) == "2020-01-02"


def test_exact_quantile_matches_numpy(spark):
    xs = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    q = aggs.exact_quantile(df, "x", 0.95).first().q
    assert abs(q - np.percentile(xs, 95)) < 1e-12


def test_spearman_ties_and_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (3.0, 3.0)], "y double, p double")
    s = aggs.spearman(df, "y", "p").first().spearman
    ref = pd.DataFrame({"y": [1, 1, 2, 3], "p": [2, 1, 1, 3]}).corr(method="spearman").iloc[0, 1]
    assert abs(s - ref) < 1e-12
    r2 = aggs.r2_score(spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.9), (4.0, 3.0)], "y double, p double"), "y", "p")
    assert abs(r2.first().r2 - 0.538) < 1e-9


def test_dedupe_and_top_one(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, "z"), (1, 2, "a")], "k int, o int, v string")
    got = {r.k: r.v for r in aggs.dedupe_keep_first(df, "k", ["o", "v"]).collect()}
    assert got == {1: "a", 2: "z"}
    cnt = spark.createDataFrame([("x", "h2", 5), ("x", "h1", 5), ("y", "h3", 1)], "g string, h string, n int")
    top = {r.g: r.h for r in windows.top_one_per_group(cnt, "g", "n", "h").collect()}
    assert top == {"x": "h1", "y": "h3"}


def test_count_having_null_group(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("a",)] * 2, "m string")
    got = {r.m: r.n for r in aggs.count_having(df, "m", 2, strict=True).collect()}
    assert got == {None: 3}
    assert aggs.value_counts(df, "m").count() == 1
    assert aggs.filter_groups_by_size(df, "m", 2).count() == 2


def test_stratified_folds_round_robin(spark):
    rows = [("a", i) for i in range(7)] + [("b", i) for i in range(5)] + [("c", 0)]
    df = spark.createDataFrame(rows, "cls string, rid int")
    f = windows.stratified_folds(df, "cls", ["cls", "rid"], 5, 13).collect()
    sizes = sorted(pd.Series([r.fold for r in f]).value_counts().tolist(), reverse=True)
    assert sizes == [3, 3, 3, 2, 2]
    a = sorted(pd.Series([r.fold for r in f if r.cls == "a"]).value_counts().tolist(), reverse=True)
    assert a == [2, 2, 1, 1, 1]


def test_fold_split_shares(spark):
    df = spark.range(10000).select(F.col("id").alias("rid"), (F.col("id") % 3).cast("string").alias("cls"))
    s = {r.split: r["count"] for r in windows.fold_split(df, 0, "cls", ["rid"]).groupBy("split").count().collect()}
    assert s == {"test": 2000, "val": 2000, "train": 6000}


def test_task_chunks_and_vectors(spark):
    df = spark.createDataFrame([(1, t) for t in range(23)], "seq_id long, task_id int")
    ch = windows.task_chunks(df, "seq_id", "task_id", 10).collect()
    sizes = sorted(pd.Series([r.chunk for r in ch]).value_counts().tolist(), reverse=True)
    assert sizes == [10, 10, 3] and sorted(r.task_id for r in ch) == list(range(23))
    cells = spark.createDataFrame([(1, 1, 0.5, 1.0, 10), (1, 1, 0.7, 1.0, 11), (1, 2, 0.1, 2.0, 3)],
                                  "seq_id long, task_id int, outcome double, weight double, row_id long")
    v = task_vectors(dedupe_cells(cells)).first().labels
    assert [(x.task_id, x.outcome, x.row_id) for x in v] == [(1, 0.7, 11), (2, 0.1, 3)]


def test_dense_ids_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "h string")
    got = {r.h: r.id for r in windows.dense_ids(df, "h", "id", base=1, prefix="hap_").collect()}
    assert got == {"a": "hap_1", "b": "hap_2", "c": "hap_3", None: None}
