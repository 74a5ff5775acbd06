"""Hot keys: joins that deal them over tasks, and sets told apart by digests."""

import pytest
from pyspark.sql import functions as F

from lineax.operators import aggs, joins
from lineax.plans import haplotypes as H


def tables(spark):
    big = [("hot", i) for i in range(600)] + [(f"k{i % 40}", i) for i in range(600, 1200)] + [(None, i) for i in range(1200, 1500)] + [("alone", 1500)]
    small = [("hot", "a"), ("hot", "b"), ("k1", "c"), ("k2", "d"), ("gone", "e"), (None, "f")]
    return spark.createDataFrame(big, "k string, v int").repartition(5), spark.createDataFrame(small, "k string, w string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_is_a_plain_join(spark, how):
    big, small = tables(spark)
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, joins.skew_join(big, small, ["k"], how, salts=7, share=0.1).collect())) == want
    assert sorted(map(str, joins.lookup_join(big, small, ["k"], how, max_rows=0).collect())) == want
    assert sorted(map(str, joins.lookup_join(big, small, ["k"], how).collect())) == want


def test_only_keys_of_many_rows_are_heavy(spark):
    big, _ = tables(spark)
    hot = big.where("k = 'hot'").select(F.xxhash64("k")).first()[0]
    assert joins.heavy_keys(big, ["k"], 0.1) == [hot]
    assert joins.heavy_keys(big.where("k is null"), ["k"], 0.1) == [] == joins.heavy_keys(big.limit(0), ["k"], 0.1)
    with pytest.raises(ValueError, match="full"):
        joins.skew_join(big, big, ["k"], "full")


def test_no_task_gets_a_hot_key_s_rows_alone(spark):
    """A key with a third of the rows and nulls with another: the largest task stays near the mean."""
    n = 30_000
    big = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    small = big.where("k is not null").select("k").distinct().withColumn("w", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.skew_join(big, small, ["k"], "left", salts=64)
        most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == n and most < 2 * n / 8


def test_set_digests_tell_sets_apart_in_any_order(spark):
    sets = [["a", "b"], ["b", "a"], ["ab"], [], ["a"], ["b"], ["a", "b", "c"], ["c", "a", "b"], ["é"], ["a, b"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<string>")
    coded = df.select("i", "s", *aggs.set_digest(F.col("s")))
    z = {r.i: (r.z1, r.z2) for r in coded.collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (z[i] == z[j]) == (set(a) == set(b))
    names = {r.haplotype: (r.z1, r.z2) for r in aggs.set_dictionary(coded, "s").where("haplotype <> 'a, b'").collect()}
    assert names["a, b, c"] == z[6] and names["NA"] == z[3]


def test_haplotypes_of_literals_and_of_a_join_agree(spark):
    samples = spark.createDataFrame([(f"s{i}", "X" if i % 2 else "Y") for i in range(60)], "seq_name string, country string")
    muts = spark.createDataFrame([(f"s{i}", f"S:{m}") for i in range(50) for m in "ABCD"[: i % 4]] + [("s3", "S:A"), ("s1", "S:rare"), ("s59", "S:rare2")], "seq_name string, mut string")
    per = H.sample_mutations(samples, muts)
    frequent = spark.createDataFrame([("S:A",), ("S:B",), ("S:C",), (None,)], "mut string")
    for keys in (frequent, frequent.where("mut is not null"), frequent.limit(0)):
        few, many = (sorted((r.seq_name, sorted(r.set)) for r in H._frequent_sets(per, keys, "seq_name", n).collect()) for n in (100, 0))
        assert few == many
    got = {r.seq_name: (r.haplotype, r.hap_id) for r in H.build_haplotypes(samples, muts, min_mut=5, min_hap=1).collect()}
    assert got["s1"] == ("S:A", "hap_2") and got["s3"] == ("S:A, S:B, S:C", "hap_4") and got["s0"] == ("NA", "hap_1") and "s59" not in got


def test_hot_keys_can_be_told_by_another_table(spark):
    from lineax.operators import joins

    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    small = spark.createDataFrame([(i, f"n{i}") for i in range(200)], "k int, n string")
    want = sorted(map(str, big.join(small, "k").select("k", "v", "n").collect()))
    for seen in (big, big.limit(0)):
        got = joins.lookup_join(big, small, ["k"], max_rows=0, seen=seen)
        assert sorted(map(str, got.select("k", "v", "n").collect())) == want
