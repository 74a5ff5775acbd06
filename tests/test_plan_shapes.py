"""Plan-shape checks: the scale properties the operators promise show up in the physical plan."""

from pyspark.sql import functions as F

from lineax.operators import aggs, windows
from lineax.operators.ordinal import with_global_ordinal


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_is_partial_aggregate_not_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    plan = _plan(aggs.dedupe_keep_first(df, "k", ["o"]))
    assert "Window" not in plan and "partial_min" in plan


def test_top_one_and_sample_one_are_partial_aggregates(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"), F.col("id").alias("t"))
    for out in (windows.top_one_per_group(df, "g", "n", "t"), windows.sample_one_per_group(df, "g", "t")):
        plan = _plan(out)
        assert "Window" not in plan and "partial_min" in plan


def test_few_groups_filter_without_join(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("string").alias("country"), F.col("id"))
    plan = _plan(aggs.filter_groups_by_size(df, "country", 10))
    assert "Join" not in plan


def test_ordinal_gathers_only_partition_offsets(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id"))
    plan = _plan(with_global_ordinal(df, ["k"], "o"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    from lineax.plans import standins as S

    d = "/root/testdata/sf0.001"
    plan = _plan(S.samples(spark, d).select("seq_name", "country"))
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
