import pytest
from pyspark.sql import functions as F

from lineax.functions import columns as C
from lineax.operators import filters, joins


def test_split_header_and_full_dates(spark):
    rows = [("v/England/n1/2021|2021-03-04|2021-03-20",), ("v/Japan/n2",), ("v/Japan/n3/2021|2021-03|x/extra",),
            ("v/Wales/n4/2021|2021-13-01|2021-03-20",)]
    df = spark.createDataFrame(rows, "h string")
    df = C.split_header(df, "h", "/", ["virus", "country", "name", "time"])
    df = C.split_header(df, "time", r"\|", ["year", "cdate", "sdate"])
    got = {r.name: r for r in df.collect()}
    assert got["n2"].time is None and got["n2"].cdate is None
    assert got["n3"].time == "2021|2021-03|x"  # extra piece dropped
    df = C.recode_members(df, "country", ["England", "Scotland", "Wales"], "UK")
    parsed = C.parse_full_date(df, "cdate", "2021-12-31").collect()
    assert [(r.name, r.country, str(r.cdate)) for r in parsed] == [("n1", "UK", "2021-03-04")]


def test_exclude_members_keeps_null(spark):
    df = spark.createDataFrame([("x",), (None,), ("bad",)], "source string")
    assert filters.exclude_members(df, "source", ["bad"]).count() == 2
    assert filters.keep_members(df, "source", ["x", "bad"]).count() == 2


def test_cutoff_or_null(spark):
    df = spark.createDataFrame(
        [("A", "2022-01-01"), ("A", "2022-02-01"), ("A", None), ("B", "2020-01-01")], "clade string, d string"
    ).withColumn("date_first", F.col("d").cast("date"))
    cut = spark.createDataFrame([("A", "2022-02-01")], "clade string, c string").withColumn("cutoff", F.col("c").cast("date"))
    kept = filters.cutoff_or_null_filter(joins.left_join(df, cut.drop("c"), "clade")).select("clade", "d").collect()
    assert sorted((r.clade, r.d) for r in kept) == [("A", "2022-02-01"), ("B", "2020-01-01")]


def test_substitution_and_positions(spark):
    df = spark.createDataFrame([("ABCDE", 3, "x"), ("A-CDE", 2, "y"), ("ABC", 5, "z")], "seq string, position int, mutant string")
    assert [r.seq for r in C.apply_substitution(df).collect()] == ["ABxDE", "AyCDE", "ABCz"]
    m = spark.createDataFrame([("S:E484K",), ("S:214:EPE",), ("NA",)], "mut string")
    assert [r.pos for r in C.mutation_position(m).collect()] == [484, 214, None]


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(-0.5,), (0.3,), (7.0,), (None,), (float("nan"),)], "x double")
    assert [r.x for r in C.clip01(df, "x").collect()] == [0.0, 0.3, 1.0, None, None]


def test_recode_pattern_null_key(spark):
    df = spark.createDataFrame([("BA.2.86.3", "22F"), ("JN.1", "23A"), (None, "22B"), ("XBB", "22F")], "pango string, clade string")
    got = [r.clade for r in C.recode_pattern(df, "pango", [r"BA\.2\.86", r"JN\."], "BA.2.86", "clade").collect()]
    assert got == ["BA.2.86", "BA.2.86", None, "22F"]


def test_day_bins_right_closed(spark):
    df = spark.createDataFrame([(f"2021-01-{d:02d}",) for d in range(1, 18)], "d string")
    out = {r.day_num: r.day_bin for r in C.day_index_and_bin(df, "d", 7).collect()}
    assert out[1] == 1 and out[7] == 1 and out[8] == 2 and out[14] == 2
    assert 15 not in out  # days past the last full bin are dropped


def test_encode_and_mask(spark):
    vocab = {c: i + 4 for i, c in enumerate("ACDEFGHIKLMNPQRSTVWY")}
    df = spark.createDataFrame([(1, "ACDZ"), (2, "A" * 30)], "id long, seq string")
    enc = C.encode_residues(df, vocab, "seq", max_len=10).collect()
    assert enc[0].input_ids == [0, 4, 5, 6, 3, 2, 1, 1, 1, 1] and enc[0].attention_mask == [1] * 6 + [0] * 4
    assert enc[1].input_ids == [0] + [4] * 8 + [2]
    big = spark.range(400).select(F.col("id"), F.lit("ACDEFGHIKLMNPQRSTVWY" * 10).alias("seq"))
    m = C.mask_residues(C.encode_residues(big, vocab, "seq", max_len=202), "id", mask_id=32)
    share = m.select(F.size(F.filter("labels", lambda x: x != -100)).alias("k")).agg(F.sum("k")).first()[0] / (400 * 200)
    assert 0.13 < share < 0.17


def test_attach_sequence_fails_on_unknown_name(spark):
    meta = spark.createDataFrame([("a",), ("zz",)], "seq_name string")
    fasta = spark.createDataFrame([("a", "MKV")], "name string, seq string")
    with pytest.raises(Exception, match="no sequence for name"):
        joins.attach_sequence(meta, fasta).collect()
    ok = joins.attach_sequence(meta.where("seq_name = 'a'"), fasta).collect()
    assert ok[0].seq == "MKV"


def test_null_safe_join_matches_null(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, mut string")
    b = spark.createDataFrame([(None,), ("x",)], "mut string")
    assert joins.null_safe_join(a, b, ["mut"]).count() == 2
    assert a.join(b, "mut").count() == 1
