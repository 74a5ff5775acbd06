"""Files to samples, and predictions of labelled cells."""

import numpy as np
from pyspark.sql import functions as F

from lineax.operators import features
from lineax.plans import samples, training


def head(country, name, date="2021-05-06", virus="hCoV-19"):
    return f"{virus}/{country}/{name}/2021|{date}|2021-06-01"


def test_samples_take_every_filter_in_turn(spark):
    heads = [head("England", "a"), head("Wales", "b"), head("Japan", "c"), head("Japan", "d", "2021-05"), head("Japan", "e", virus="other"), head("Japan", "f", "2022-01-01"), head("Japan", "g", "2021-13-01"),
             "hCoV-19/Japan", head("Japan", "mink"), head("Japan", "poor"), head("Japan", "stops"), head("Peru", "lone"), head("Japan", "h"), head("Japan", "unknown")]
    calls = spark.createDataFrame([(h, f"cl{i}") for i, h in enumerate(heads)] + [(heads[0], "zz"), (None, "x")], "seqName string, clade string")
    quality = spark.createDataFrame([(h, 1000, 50 if "poor" in h else 3, 2 if "stops" in h else 1) for h in heads], "name string, length int, count_n int, count_stop int")
    records = [(f"hCoV-19/Any/{n}/2021", "Mink" if n == "mink" else "Human") for n in ("a", "b", "c", "d", "e", "f", "g", "mink", "poor", "stops", "lone", "h")] + [("hCoV-19/Any/h/2021", "Human"), ("short", "Human")]
    out = samples.surveillance_samples(calls, quality, spark.createDataFrame(records, "virus_name string, host string"), "2021-12-31", min_country=1).collect()
    assert sorted((r.country, r.name, r.clade) for r in out) == [("Japan", "c", "cl2"), ("Japan", "h", "cl12"), ("Japan", "h", "cl12"), ("UK", "a", "cl0"), ("UK", "b", "cl1")]
    assert {str(r.collection_date) for r in out} == {"2021-05-06"}


def scorer():
    def make():  # a local function travels with its code
        return lambda x: np.stack([x.sum(axis=1), x[:, 0], -x[:, 1]], axis=1)

    return make


def test_predictions_are_picked_in_place(spark):
    cells = [(1, 0, 0.5, 1.0, 10, "p"), (1, 2, 0.7, 1.0, 11, "q"), (1, 2, 0.9, 1.0, 12, "r"), (2, 1, None, 1.0, 13, None), (3, 5, 0.1, 1.0, 14, "s")]
    rows = spark.createDataFrame(cells, "seq_id long, task_id int, outcome double, weight double, row_id long, clade string")
    codes = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0]), (4, [7.0, 8.0])], "seq_id long, x array<double>")
    vectors = features.task_vectors(rows, carry=["clade"]).join(codes, "seq_id")
    got = training.prediction_table(vectors, scorer(), "x", 3, 2)
    assert sorted((r.seq_id, r.task_id, r.row_id, r.clade or "", r.predicted_outcome) for r in got.collect()) == [(1, 0, 10, "p", 3.0), (1, 2, 12, "r", -2.0), (2, 1, 13, "", 3.0), (3, 5, 14, "s", None)]


def test_prediction_table_scores_once_and_shuffles_nothing(spark, tmp_path):
    labels = F.array(F.struct(F.lit(0).alias("task_id"), F.lit(1.0).alias("outcome"), F.lit(1.0).alias("weight"), F.lit(1).alias("row_id")))
    spark.range(20).select(F.col("id").alias("seq_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"), labels.alias("labels")).write.parquet(f"{tmp_path}/v")
    out = training.prediction_table(spark.read.parquet(f"{tmp_path}/v"), scorer(), "x", 3, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
