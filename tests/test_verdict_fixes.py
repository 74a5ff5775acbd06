import numpy as np
import pytest
from pyspark.sql import functions as F

from lineax.operators import aggs, features, growth
from lineax.operators.joins import checked_broadcast
from lineax.plans import haplotypes as H
from lineax.plans import registry as R
from lineax.plans import standins as S
from lineax.plans import training as TR
from lineax.plans.reports import prediction_report
from lineax.sources import read_tsv

SF = "/root/testdata/sf0.001"


def test_one_hot_has_one_column_per_country(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "country string")
    got = [(r.country, r.country_vec.toArray().tolist()) for r in features.one_hot_country(df)[0].collect()]
    assert sorted(got, key=str) == sorted([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0]), (None, [0.0, 0.0])], key=str)


def test_columns_are_found_by_header_name(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/wide.tsv"
    with open(path, "w") as f:
        f.write("other\tb\tVirus.name\nx\t2\tname\n")
    assert [tuple(r) for r in read_tsv(spark, path, "virus_name string, b int").collect()] == [("name", 2)]
    with pytest.raises(ValueError, match="absent"):
        read_tsv(spark, path, "absent string")


def test_each_row_is_scored_once_without_a_shuffle(spark):
    for query in ("score_batch", "prediction_report"):
        plan = R.QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_report_keeps_rows_of_one_name_apart(spark):
    scored = spark.createDataFrame([("a", [1.0, 3.0, 5.0]), ("a", [2.0, None, 6.0])], "name string, predicted array<double>")
    got = sorted(tuple(r) for r in prediction_report(scored, ["x", "y", "z"], ["x", "y"]).collect())
    assert got == [("a", 2.0, 1.0, 3.0, 5.0), ("a", 2.0, 2.0, None, 6.0)]


def test_vocabulary_limit_is_an_error(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c"],)], "tokens array<string>")
    assert sorted(features.multi_hot(df)[1].vocabulary) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="max_vocab"):
        features.multi_hot(df, max_vocab=2)


def test_missing_reference_haplotype_is_an_error(spark):
    counts = spark.createDataFrame([("X", 1, "h0", 30), ("X", 2, "h1", 30), ("Y", 1, "h1", 30)], "country string, day_bin int, hap_id string, n long")
    for ref, message in ((None, "no reference"), ("h0", "Y")):
        with pytest.raises(ValueError, match=message):
            growth.growth_design(counts, ref)


def test_unfinished_fit_is_not_converged(spark):
    rows = [("X", day, f"h{k}", 50 + 3 * day * k) for day in range(1, 21) for k in range(3)]
    counts = spark.createDataFrame(rows, "country string, day_bin int, hap_id string, n long")
    design = growth.growth_design(counts, "h0").persist()
    assert {r.converged for r in growth.fit_growth(design, 20).collect()} == {True}
    assert {r.converged for r in growth.fit_growth(design, 20, max_iter=1).collect()} == {False}


def test_count_filters_drop_rows_of_the_stand_in(spark):
    sf = "/root/testdata/sf0.01"
    s, m = S.samples(spark, sf), S.mutations(spark, sf)
    assert R.QUERIES["count_having"](spark, sf).count() < m.select("mut").distinct().count()
    kept = R.QUERIES["build_haplotypes"](spark, sf).select("seq_name").distinct().count()
    assert 0 < kept < s.count()
    assert R.QUERIES["lineage_growth"](spark, sf).count() < R.QUERIES["fitness_over_time"](spark, sf).count()


def test_mutations_are_read_once(spark, monkeypatch):
    """Haplotypes, all-mutation haplotypes and the samples' counts come from one written table."""
    sf = "/root/testdata/sf0.001"
    made = []
    real = H.sample_mutations
    monkeypatch.setattr(H, "sample_mutations", lambda *a, **k: made.append(1) or real(*a, **k))
    stage = H.prepare(S.samples(spark, sf), S.mutations(spark, sf), "1-URGENT", 100, 1)
    full = H.build_all_mutation_haplotypes(stage.rows, S.mutations(spark, sf), per_sample=stage.mutations)
    assert full.count() == stage.rows.count()
    assert made == [1]
    for table in (stage.rows, stage.haplotypes, full):
        assert "lineitem" not in table._jdf.queryExecution().executedPlan().toString()


def test_broadcast_is_bounded_in_bytes_too(spark):
    ids = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array("id").alias("many"))

    def hinted(df):
        return "hint" in df._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(checked_broadcast(ids))
    assert not hinted(checked_broadcast(ids, max_bytes=50_000))
    assert not hinted(checked_broadcast(ids, max_rows=99))
    assert hinted(checked_broadcast(ids.limit(0)))


def test_every_backbone_is_used(spark):
    sf = "/root/testdata/sf0.01"
    targets = S.escape_rows(spark, sf).select(F.col("target_virus").alias("target")).distinct()
    assert S.backbones(spark, sf).join(targets, "target", "left_anti").count() == 0


def test_quantile_of_repeated_values(spark):
    df = spark.createDataFrame([("a", x) for x in [1.0] * 90 + [2.0] * 10 + [None]] + [("b", 5.0)], "g string, x double")
    got = {r.g: r.q for r in aggs.exact_quantile(df, "x", [0.0, 0.9, 0.95], ["g"]).collect()}
    want = [float(np.quantile([1.0] * 90 + [2.0] * 10, p)) for p in (0.0, 0.9, 0.95)]
    assert got["a"] == pytest.approx(want) and got["b"] == [5.0] * 3


def test_clade_exclusion_keeps_the_future(spark):
    def counts(exclude):
        rows = R._train_table(spark, SF, exclude_clades=exclude)
        return {(r.clade, r.future): r["count"] for r in rows.groupBy("clade", (F.col("split") == "future").alias("future")).count().collect()}

    everything = counts(())
    clade = max((c for c, future in everything if c and future), key=lambda c: everything[c, True])
    assert (clade, False) in everything
    assert counts((clade,)) == {k: n for k, n in everything.items() if k != (clade, False)}
