"""Stand-in inputs built from the driver's tables.

Every stand-in is a lazy projection/join of the given parquet tables, so its
size grows with the scale factor.  Roles:

S1 samples + mutations — sample = order; country = region name
   (orders→customer→nation→region); date = order date; clade = order
   priority; lineage label = order status; mutations = one label per line
   item: a rare one per part for every tenth part (some 30 rows at every
   scale), one of two for quantities up to 2 (4 % of rows), else one of
   three by return flag.
S2 duplicates — lineitem, where (orderkey, linenumber) is not a key.
S3 sequences — ``documents.text`` / ``benchmark.text``.
S4 partially labelled rows — documents left join labels.
S5 escape measurements — lineitem ⋈ part.
S6 fitness rows — lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region.
S7 predictions — y = discount, p = tax, weight = quantity.
S8 header strings — ``v/<nation>/<customer>/<yyyy>|<date>|<date>``.
S9 tokens — words of ``p_name``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineax.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scale_of(sf_dir: str) -> float:
    m = re.search(r"sf([0-9.]+)", sf_dir)
    return float(m.group(1).rstrip(".")) if m else 0.01


def region_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", "c_name", "n_name", "r_name"))


# S1
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: seq_name, sample_id, country, collection_date, clade, pango."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    cr = region_of_customer(spark, sf_dir)
    return o.join(cr, o.o_custkey == cr.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("seq_name"),
        F.col("o_orderkey").alias("sample_id"),
        F.col("r_name").alias("country"),
        F.col("o_orderdate").cast("date").alias("collection_date"),
        F.col("o_orderpriority").alias("clade"),
        F.col("o_orderstatus").alias("pango"),
    )


def mutation_label():
    rare = F.concat(F.lit("S:K"), F.col("l_partkey").cast("string"), F.lit("N"))
    some = F.concat(F.lit("S:L"), F.col("l_quantity").cast("int").cast("string"), F.lit("P"))
    common = F.concat(F.lit("S:"), F.col("l_returnflag"), F.lit("79O"))
    return F.when(F.col("l_partkey") % 10 == 0, rare).when(F.col("l_quantity") <= 2, some).otherwise(common)


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long mutation table (seq_name, mut): one row per line item (duplicates included)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("seq_name"), mutation_label().alias("mut"))


# S3
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def backbones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, seq): one backbone sequence per document, named by its id."""
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("target"), F.col("text").alias("seq"))


def backbone_of_part():
    """Target of a line item: there are two parts per document, so every backbone is used."""
    return F.expr("CAST(l_partkey div 2 AS STRING)")


# S4
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left")


# S5
def escape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ic50, target_virus, mutation, site, group, condition, mut_escape, neg_log_ic50, row_key)."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_returnflag").alias("source"),
        (F.col("l_quantity") / F.lit(5.0)).alias("ic50"),
        backbone_of_part().alias("target_virus"),
        F.upper(F.substring("p_name", 1, 1)).alias("mutation"),
        F.col("p_size").alias("site"),
        F.col("p_type").alias("group"),
        F.col("p_brand").alias("condition"),
        F.col("l_discount").alias("mut_escape"),
        F.col("l_tax").alias("neg_log_ic50"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
    )


# S6
def fitness_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relative_re, country, base, date_first, clade, pango, l_orderkey, l_linenumber, l_partkey); base: name of the sequence."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                                  "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    cr = region_of_customer(spark, sf_dir)
    # Orders get their country before they meet the line items, which move by order only.
    placed = o.join(cr, o.o_custkey == cr.c_custkey).select("o_orderkey", "o_orderpriority", "o_orderstatus", "r_name")
    j = li.join(placed, li.l_orderkey == placed.o_orderkey).withColumn("base", backbone_of_part())
    known = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("base"))
    j = j.join(known, "base", "left_semi")
    return j.select(
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("relative_re"),
        F.col("r_name").alias("country"),
        F.col("base"),
        F.col("l_shipdate").cast("date").alias("date_first"),
        F.col("o_orderpriority").alias("clade"),
        F.col("o_orderstatus").alias("pango"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def fitness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fitness_refs`` with the sequence's text as seq."""
    rows = fitness_refs(spark, sf_dir)
    seqs = backbones(spark, sf_dir)
    out = ["seq" if c == "base" else c for c in rows.columns]
    return rows.join(seqs, rows.base == seqs.target).select(*out)


def fitness_facts(spark: SparkSession, sf_dir: str, texts: DataFrame, facts: list[str]) -> DataFrame:
    """The rows of ``fitness_rows`` with a struct of ``facts``, columns of ``texts`` (target, ...; one row per document),
    as seq instead of the text; written once."""
    rows = fitness_refs(spark, sf_dir).drop("l_orderkey", "l_linenumber", "l_partkey")
    known = texts.select("target", F.struct(*facts).alias("seq"))
    return materialize(rows.join(known, rows.base == known.target).drop("base", "target"), "fitness_rows")


# S8
def header_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, header): full headers, with pieces missing for some keys to exercise parsing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    cr = region_of_customer(spark, sf_dir)
    j = o.join(cr, o.o_custkey == cr.c_custkey)
    d = F.col("o_orderdate").cast("date").cast("string")
    y = F.year("o_orderdate").cast("string")
    full = F.concat(F.lit("v/"), F.col("n_name"), F.lit("/"), F.col("c_name"), F.lit("/"), y, F.lit("|"), d,
                    F.lit("|"), d)
    # status F: full header; O: month-only date; P: no time piece at all.
    month_only = F.concat(F.lit("v/"), F.col("n_name"), F.lit("/"), F.col("c_name"), F.lit("/"), y, F.lit("|"),
                          F.substring(d, 1, 7))
    no_time = F.concat(F.lit("v/"), F.col("n_name"), F.lit("/"), F.col("c_name"))
    h = F.when(F.col("o_orderstatus") == "F", full).when(F.col("o_orderstatus") == "O", month_only).otherwise(no_time)
    return j.select(F.col("o_orderkey").alias("sample_id"), h.alias("header"))
