import numpy as np
from pyspark.sql import functions as F

from lineax.operators import growth, models
from lineax.plans import haplotypes as H
from lineax.plans import reports as R


def _samples(spark, names, country="X"):
    return spark.createDataFrame([(n, i, country, "2021-01-01", "c", "p") for i, n in enumerate(names)],
                                 "seq_name string, sample_id long, country string, collection_date string, clade string, pango string") \
        .withColumn("collection_date", F.col("collection_date").cast("date"))


def test_build_haplotypes_rare_and_none(spark):
    s = _samples(spark, [f"s{i}" for i in range(1, 9)])
    muts = [(f"s{i}", m) for i in (1, 2, 3) for m in ("S:A1B", "S:C2D")] + [("s4", "S:E3F"), ("s8", "ORF1a:T1I")]
    m = spark.createDataFrame(muts, "seq_name string, mut string")
    h = {r.seq_name: r.haplotype for r in H.build_haplotypes(s, m, min_mut=2, min_hap=1).collect()}
    assert h["s1"] == h["s2"] == h["s3"] == "S:A1B, S:C2D"
    assert "s4" not in h
    assert h["s5"] == h["s6"] == h["s7"] == h["s8"] == "NA"


def test_duplicate_metadata_doubles_counts(spark):
    s = _samples(spark, ["a", "a", "b"])
    m = spark.createDataFrame([("a", "S:X1Y"), ("b", "S:X1Y")], "seq_name string, mut string")
    h = H.build_haplotypes(s, m, min_mut=0, min_hap=1)
    assert h.count() == 3  # the duplicated name is counted twice before de-duplication
    assert h.select("seq_name").distinct().count() == 2


def test_loss_weights_variants(spark):
    rows = [("fitness", f"2020-01-0{i}") for i in range(1, 5)] + [("fitness", "2023-01-01")] * 2 + [("imm", None)] * 10
    df = spark.createDataFrame(rows, "group string, date_first string").withColumn("date_first", F.col("date_first").cast("date"))
    sliding = {r.major_group2: r.weight for r in models.loss_weights(df, "2022-01-01", "2022-01-01", 1.0, 2.0).collect()}
    assert sliding == {"fitness": 1.0, "fitness_recent": 2.0, "immune": 0.4}
    oct24 = {r.major_group2: r.weight for r in models.loss_weights(df, "2022-01-01", "2022-01-01", 2.0, 1.0).collect()}
    assert oct24 == {"fitness": 2.0, "fitness_recent": 2.0, "immune": 0.4}


def test_presence_matrix(spark):
    fit = spark.createDataFrame([("h1", "A", "2022-03-15"), ("h2", "A", "2022-04-02")], "hap_id string, clade string, date_first string") \
        .withColumn("date_first", F.col("date_first").cast("date"))
    months = [f"2022-0{m}-01" for m in range(1, 6)]
    out = R.clade_presence_matrix(fit, ["A", "Z"], months).orderBy("clade", "month").collect()
    assert [r.value for r in out if r.clade == "A"] == [0, 0, 0, 1, 1]
    assert [r.value for r in out if r.clade == "Z"] == [0] * 5


def test_growth_recovers_slopes_and_certifies(spark):
    rng = np.random.default_rng(7)
    slopes = np.array([0.0, 0.05, -0.03, 0.08])
    inter = np.array([0.0, -0.5, 0.2, -1.5])
    rows = []
    for day in range(1, 31):
        p = np.exp(inter + slopes * day)
        p /= p.sum()
        for k, n in enumerate(rng.multinomial(4000, p)):
            rows += [("X", day, f"h{k}")] * 0
            if n:
                rows.append(("X", day, f"h{k}", int(n)))
    counts = spark.createDataFrame(rows, "country string, day_bin int, hap_id string, n long")
    design = growth.growth_design(counts, "h0", 20).persist()
    coefs = growth.fit_growth(design, 30, max_iter=300, tol=1e-12)
    got = {r.class_idx: r.slope / 30 for r in coefs.collect()}
    cls = {r.hap_id: r.class_idx for r in design.select("hap_id", "class_idx").distinct().collect()}
    for k in range(4):
        assert abs(got[cls[f"h{k}"]] - slopes[k]) < 0.01
    cert = growth.growth_certificate(design, coefs, 30).first().max_score_per_n
    assert cert < 1e-4
    again = growth.fit_growth(growth.growth_design(counts.repartition(7), "h0", 20), 30, max_iter=300, tol=1e-12)
    g2 = {r.class_idx: r.slope / 30 for r in again.collect()}
    assert all(abs(g2[k] - got[k]) < 1e-4 for k in got)
