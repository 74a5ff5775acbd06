from pyspark.sql import functions as F

from lineax.sources import read_fasta, read_tsv, write_tsv

FASTA = ">a d1\nMF\nVF*\n>b\nMXX-Q*\n>a d1\nMM*\n"


def _write(tmp, text, name="x.fa"):
    p = f"{tmp}/{name}"
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_fasta_duplicates_and_headers(spark, tmpdir_fresh):
    p = _write(tmpdir_fresh, FASTA)
    first = {r.name: r.seq for r in read_fasta(spark, p, "description", "first").collect()}
    last = {r.name: r.seq for r in read_fasta(spark, p, "description", "last").collect()}
    assert first == {"a d1": "MFVF*", "b": "MXX-Q*"}
    assert last == {"a d1": "MM*", "b": "MXX-Q*"}
    ids = {r.name for r in read_fasta(spark, p, "id", "first").collect()}
    assert ids == {"a", "b"}
    numbered = sorted((r.name, r.seq) for r in read_fasta(spark, p, "description", "number").collect())
    assert numbered == [("0_a d1", "MFVF*"), ("1_b", "MXX-Q*"), ("2_a d1", "MM*")]
    assert read_fasta(spark, p, dup="all").count() == 3


def test_fasta_many_splits_same_as_one(spark, tmpdir_fresh):
    recs = "".join(f">r{i} x\n{'ACDEFGHIK' * (i % 7 + 1)}\n{'LMN' * (i % 3)}\n" for i in range(3000))
    p = _write(tmpdir_fresh, recs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.option("lineSep", "\n>").text(p).rdd.getNumPartitions() > 5
        rows = {r.name: r.seq for r in read_fasta(spark, p, "id", "first").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000
    assert rows["r10"] == "ACDEFGHIK" * 4 + "LMN"


def test_residue_counts_on_fasta(spark, tmpdir_fresh):
    from lineax.functions.columns import gap_counts, residue_counts

    p = _write(tmpdir_fresh, FASTA)
    df = residue_counts(read_fasta(spark, p), "seq")
    df = gap_counts(df, "seq")
    b = df.where(F.col("name") == "b").first()
    assert (b.length, b.count_n, b.count_stop, b.count_hyphen) == (6, 2, 1, 1)


def test_tsv_round_trip_keeps_nulls_and_quotes(spark, tmpdir_fresh):
    df = spark.createDataFrame([("x", 1, None), (None, 2, 'say "hi"')], "a string, b int, c string")
    path = f"{tmpdir_fresh}/t"
    write_tsv(df, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert "NA\t2\tsay \"hi\"" in lines and "x\t1\tNA" in lines
    back = read_tsv(spark, path, "a string, b int, c string")
    assert sorted(back.collect(), key=lambda r: r.b) == sorted(df.collect(), key=lambda r: r.b)


def test_read_tsv_without_schema_snake_cases(spark, tmpdir_fresh):
    p = _write(tmpdir_fresh, "Virus.name\tdate.first\nhCoV-19/x\t2021-01-01\n", "m.tsv")
    df = read_tsv(spark, p)
    assert df.columns == ["virus_name", "date_first"]


def test_fasta_crlf_and_first_wins_across_files(spark, tmpdir_fresh):
    import os

    os.makedirs(f"{tmpdir_fresh}/a")
    os.makedirs(f"{tmpdir_fresh}/b")
    _write(f"{tmpdir_fresh}/a", ">x one\r\nMK\r\nV*\r\n>y\r\nAA\r\n", "1.fa")
    _write(f"{tmpdir_fresh}/b", ">x two\nZZ\n", "2.fa")
    got = {r.name: r.seq for r in read_fasta(spark, [f"{tmpdir_fresh}/a", f"{tmpdir_fresh}/b"], "id", "first").collect()}
    assert got == {"x": "MKV*", "y": "AA"}
    last = {r.name: r.seq for r in read_fasta(spark, [f"{tmpdir_fresh}/a", f"{tmpdir_fresh}/b"], "id", "last").collect()}
    assert last == {"x": "ZZ", "y": "AA"}
    desc = {r.name for r in read_fasta(spark, f"{tmpdir_fresh}/a", "description", "all").collect()}
    assert desc == {"x one", "y"}
