"""Fitness rows with facts of their text are the rows with the text itself, documents that come twice included."""

from pyspark.sql import functions as F

from lineax.plans import standins as S


def test_fitness_facts_are_those_of_the_texts(spark, tmp_path):
    d = str(tmp_path)

    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")

    put("region", "r_regionkey int, r_name string", [(0, "ASIA"), (1, None)])
    put("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "JAPAN", 0), (1, "X", 1)])
    put("customer", "c_custkey int, c_name string, c_nationkey int", [(1, "a", 0), (1, "b", 0), (2, None, 1), (3, "c", None)])
    put("orders", "o_orderkey int, o_custkey int, o_orderpriority string, o_orderstatus string", [(10, 1, "1-URGENT", "P"), (10, 2, None, "F"), (11, 3, "x", "O"), (12, None, "x", "O"), (13, 2, "y", None)])
    put("lineitem", "l_orderkey int, l_linenumber int, l_partkey int, l_extendedprice double, l_shipdate string",
        [(10, 1, 2, 5.0, "1995-01-01"), (10, 1, 2, 5.0, "1995-01-01"), (13, 1, 5, None, None), (11, 1, 2, 1.0, None), (None, 1, 2, 1.0, None), (10, 2, 9, 1.0, None), (10, 3, None, 1.0, None)])
    put("documents", "doc_id int, text string", [(1, "AX"), (1, "AX"), (1, "B"), (2, None), (None, "Z")])
    texts = S.backbones(spark, d).withColumn("seq_md5", F.md5("seq"))
    cols = ["relative_re", "country", "date_first", "clade", "pango"]
    want = S.fitness_rows(spark, d).select(*cols, F.md5("seq").alias("seq_md5"))
    got = S.fitness_facts(spark, d, texts, ["seq_md5"]).select(*cols, "seq.seq_md5")
    assert want.count() == 19 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
