"""Stand-in queries for every operator (keys = operator names of SURVEY §2) and their
DuckDB oracle SQL.

Each query reads the driver's tables through ``standins`` (so its work grows
with the scale factor) and returns a DataFrame whose column names and types
match the oracle.  Dates are shown as ISO strings and computed doubles are
rounded to 6 digits on both sides; long texts are compared through md5.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineax.functions import columns as C
from lineax.operators import aggs, features, filters, joins, models, setops, windows
from lineax.operators import growth as G
from lineax.operators.ordinal import with_global_ordinal
from lineax.plans import comparison as CM
from lineax.plans import haplotypes as H
from lineax.plans import reports as R
from lineax.plans import samples as SM
from lineax.plans import standins as S
from lineax.plans import training as TR
from lineax.session import materialize, scratch_path
from lineax.sources import fasta as FA
from lineax.sources import text as TX

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ds(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date").cast("string")


# ---------------------------------------------------------------- shared SQL
CR = """cr AS (SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
SAMPLES = CR + """,
samples AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS seq_name, o.o_orderkey AS sample_id, cr.r_name AS country,
  CAST(o.o_orderdate AS DATE) AS collection_date, o.o_orderpriority AS clade, o.o_orderstatus AS pango
  FROM orders o JOIN cr ON o.o_custkey = cr.c_custkey)"""
MUT = """CASE WHEN l_partkey % 10 = 0 THEN 'S:K' || CAST(l_partkey AS VARCHAR) || 'N'
  WHEN l_quantity <= 2 THEN 'S:L' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'P' ELSE 'S:' || l_returnflag || '79O' END"""
MUTS = f"muts AS (SELECT CAST(l_orderkey AS VARCHAR) AS seq_name, {MUT} AS mut FROM lineitem)"
S1 = "WITH " + SAMPLES + ",\n" + MUTS
S4 = "WITH s4 AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
ESC = """esc AS (SELECT l.l_returnflag AS source, l.l_quantity / 5.0 AS ic50, CAST(l.l_partkey // 2 AS VARCHAR) AS target_virus,
  upper(substr(p.p_name, 1, 1)) AS mutation, p.p_size AS site, p.p_type AS "group", p.p_brand AS condition,
  l.l_discount AS mut_escape, l.l_tax AS neg_log_ic50, l.l_orderkey, l.l_linenumber, l.l_partkey
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
bb AS (SELECT CAST(doc_id AS VARCHAR) AS target, text AS seq FROM documents)"""
FIT = CR + """,
bb AS (SELECT CAST(doc_id AS VARCHAR) AS target, text AS seq FROM documents),
fit AS (SELECT l.l_extendedprice / 10000.0 AS relative_re, cr.r_name AS country, bb.seq,
  CAST(l.l_shipdate AS DATE) AS date_first, o.o_orderpriority AS clade, o.o_orderstatus AS pango,
  l.l_orderkey, l.l_linenumber, l.l_partkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN cr ON o.o_custkey = cr.c_custkey
  JOIN bb ON CAST(l.l_partkey // 2 AS VARCHAR) = bb.target)"""


def hap_sql(min_mut: int = 100, min_hap: int = 20) -> str:
    """CTEs ``hap`` (seq_name, haplotype, hap_id, country) of build_haplotypes."""
    return f""",
m1 AS (SELECT s.seq_name, m.mut FROM samples s LEFT JOIN (SELECT * FROM muts WHERE contains(mut, 'S:')) m
  ON m.seq_name = s.seq_name),
freq AS (SELECT mut FROM m1 GROUP BY mut HAVING count(*) > {min_mut}),
m2 AS (SELECT DISTINCT m1.seq_name, m1.mut FROM m1 JOIN freq ON m1.mut IS NOT DISTINCT FROM freq.mut),
h0 AS (SELECT seq_name, coalesce(string_agg(DISTINCT mut, ', ' ORDER BY mut), 'NA') AS haplotype FROM m2 GROUP BY seq_name),
hid AS (SELECT haplotype, 'hap_' || CAST(dense_rank() OVER (ORDER BY haplotype) AS VARCHAR) AS hap_id
  FROM (SELECT DISTINCT haplotype FROM h0)),
h1 AS (SELECT h0.seq_name, h0.haplotype, hid.hap_id, s.country FROM h0 JOIN hid USING (haplotype)
  JOIN samples s ON s.seq_name = h0.seq_name),
common AS (SELECT DISTINCT hap_id FROM h1 GROUP BY hap_id, country HAVING count(*) >= {min_hap}),
hap AS (SELECT * FROM h1 WHERE hap_id IN (SELECT hap_id FROM common))"""


def _s1(spark, d):
    return S.samples(spark, d), S.mutations(spark, d)


# ------------------------------------------------------------ 2.1 sources/sinks
def _fasta_fixture(spark: SparkSession, d: str) -> tuple[str, str]:
    """Write documents and then benchmark items as FASTA (60-char lines) to two fresh folders."""
    base = scratch_path(spark, "fasta")
    def write(df, path):
        wrapped = F.regexp_replace(F.col("seq"), "(.{60})", "$1\n")
        df.orderBy("k").select(F.concat(F.lit(">"), F.col("title"), F.lit("\n"), wrapped).alias("v")).write.text(path)
    letters = lambda c: F.upper(F.regexp_replace(F.col(c), "[^A-Za-z]", ""))
    docs = S.documents(spark, d).select(F.col("doc_id").alias("k"),
                                        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang")).alias("title"),
                                        letters("text").alias("seq"))
    bench = S.table(spark, d, "benchmark").select(F.col("item_id").alias("k"),
                                                  F.concat(F.lit("d"), F.col("item_id").cast("string"), F.lit(" bench")).alias("title"),
                                                  letters("text").alias("seq"))
    write(docs, f"{base}/a_docs")
    write(bench, f"{base}/b_bench")
    return f"{base}/a_docs", f"{base}/b_bench"


FASTA_SQL = """WITH docs AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, 0 AS src FROM documents),
bench AS (SELECT 'd' || CAST(item_id AS VARCHAR) AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, 1 AS src FROM benchmark),
allr AS (SELECT * FROM docs UNION ALL SELECT * FROM bench),
firsts AS (SELECT name, seq, row_number() OVER (PARTITION BY name ORDER BY src) AS rn FROM allr)
SELECT name, md5(seq) AS seq_md5, CAST(length(seq) AS INTEGER) AS seq_len FROM firsts WHERE rn = 1"""


@register("read_fasta", FASTA_SQL)
def q_read_fasta(spark, d):
    a, b = _fasta_fixture(spark, d)
    f = FA.read_fasta(spark, [a, b], header="id", dup="first")
    return f.select("name", F.md5("seq").alias("seq_md5"), F.length("seq").alias("seq_len"))


S4_SCHEMA = "doc_id bigint, lang string, source string, n_chars bigint, quality int, toxic int"


@register("read_tsv", S4 + " SELECT doc_id, lang, quality, toxic FROM s4")
def q_read_tsv(spark, d):
    path = scratch_path(spark, "tsv")
    TX.write_tsv(S.labelled_documents(spark, d).select("doc_id", "lang", "source", "n_chars", "quality", "toxic"), path)
    return TX.read_tsv(spark, path, S4_SCHEMA).select("doc_id", "lang", "quality", "toxic")


@register("read_csv", S4 + " SELECT doc_id, lang, quality, toxic FROM s4")
def q_read_csv(spark, d):
    path = scratch_path(spark, "csv")
    TX.write_csv(S.labelled_documents(spark, d).select("doc_id", "lang", "source", "n_chars", "quality", "toxic"), path)
    return TX.read_csv(spark, path, S4_SCHEMA).select("doc_id", "lang", "quality", "toxic")


@register("write_tsv", S4 + """ SELECT CAST(doc_id AS VARCHAR) || chr(9) || lang || chr(9) || coalesce(CAST(quality AS VARCHAR), 'NA')
  || chr(9) || coalesce(CAST(toxic AS VARCHAR), 'NA') AS line FROM s4""")
def q_write_tsv(spark, d):
    path = scratch_path(spark, "tsv")
    TX.write_tsv(S.labelled_documents(spark, d).select("doc_id", "lang", "quality", "toxic"), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(F.col("line") != "doc_id\tlang\tquality\ttoxic")


@register("write_csv", S4 + """ SELECT CAST(doc_id AS VARCHAR) || ',' || lang || ',' || coalesce(CAST(quality AS VARCHAR), '')
  || ',' || coalesce(CAST(toxic AS VARCHAR), '') AS line FROM s4""")
def q_write_csv(spark, d):
    path = scratch_path(spark, "csv")
    TX.write_csv(S.labelled_documents(spark, d).select("doc_id", "lang", "quality", "toxic"), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(F.col("line") != "doc_id,lang,quality,toxic")


# ------------------------------------------------------------ 2.2 scalar functions
def _cnt(ch: str, col: str = "text") -> str:
    return f"CAST(length({col}) - length(replace({col}, '{ch}', '')) AS INTEGER)"


@register("residue_counts", f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS length, {_cnt('q')} AS count_n,
  {_cnt('W')} AS count_stop FROM documents""")
def q_residue_counts(spark, d):
    t = S.documents(spark, d).select("doc_id", "text")
    return C.residue_counts(t, "text", unknown="q", stop="W").drop("text")


@register("gap_counts", f"SELECT doc_id, {_cnt('x')} AS count_x, {_cnt(',')} AS count_hyphen FROM documents")
def q_gap_counts(spark, d):
    t = S.documents(spark, d).select("doc_id", "text")
    return C.gap_counts(t, "text", unknown="x", gap=",").drop("text")


HEADER_SQL = "WITH " + CR + """,
s8 AS (SELECT o.o_orderkey AS sample_id,
  CASE o.o_orderstatus
    WHEN 'F' THEN 'v/' || cr.n_name || '/' || cr.c_name || '/' || CAST(year(o.o_orderdate) AS VARCHAR) || '|'
      || CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) || '|' || CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR)
    WHEN 'O' THEN 'v/' || cr.n_name || '/' || cr.c_name || '/' || CAST(year(o.o_orderdate) AS VARCHAR) || '|'
      || substr(CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR), 1, 7)
    ELSE 'v/' || cr.n_name || '/' || cr.c_name END AS header
  FROM orders o JOIN cr ON o.o_custkey = cr.c_custkey),
p1 AS (SELECT sample_id, string_split(header, '/') AS a FROM s8),
p2 AS (SELECT sample_id, a[1] AS virus, a[2] AS country, a[3] AS name, a[4] AS time FROM p1),
p3 AS (SELECT *, string_split(time, '|') AS b FROM p2)"""


@register("split_header", HEADER_SQL + """
SELECT sample_id, virus, country, name, time, b[1] AS year, b[2] AS collection_date, b[3] AS submission_date FROM p3""")
def q_split_header(spark, d):
    h = S.header_strings(spark, d)
    h = C.split_header(h, "header", "/", ["virus", "country", "name", "time"])
    h = C.split_header(h, "time", r"\|", ["year", "collection_date", "submission_date"])
    return h.drop("header")


@register("parse_full_date", HEADER_SQL + """
SELECT sample_id, CAST(TRY_CAST(b[2] AS DATE) AS VARCHAR) AS collection_date FROM p3
WHERE length(b[2]) = 10 AND TRY_CAST(b[2] AS DATE) IS NOT NULL AND TRY_CAST(b[2] AS DATE) <= DATE '2001-01-01'""")
def q_parse_full_date(spark, d):
    h = S.header_strings(spark, d)
    h = C.split_header(h, "header", "/", ["virus", "country", "name", "time"])
    h = C.split_header(h, "time", r"\|", ["year", "collection_date", "submission_date"])
    h = C.parse_full_date(h, "collection_date", "2001-01-01")
    return h.select("sample_id", ds("collection_date").alias("collection_date"))


@register("recode_members", S4 + """ SELECT doc_id, CASE WHEN quality IN (1) THEN 'good' ELSE lang END AS lang FROM s4""")
def q_recode_members(spark, d):
    t = S.labelled_documents(spark, d)
    return C.recode_members(t, "lang", [1], "good", key="quality").select("doc_id", "lang")


@register("recode_pattern", S4 + """ SELECT doc_id, CASE WHEN k IS NULL THEN NULL
  WHEN regexp_matches(k, 'src1[0-9]-1') OR regexp_matches(k, '-0$') THEN 'grouped' ELSE lang END AS lang
  FROM (SELECT *, source || '-' || CAST(quality AS VARCHAR) AS k FROM s4)""")
def q_recode_pattern(spark, d):
    t = S.labelled_documents(spark, d).withColumn("k", F.concat("source", F.lit("-"), F.col("quality").cast("string")))
    return C.recode_pattern(t, "k", ["src1[0-9]-1", "-0$"], "grouped", "lang").select("doc_id", "lang")


@register("day_index_and_bin", "WITH " + SAMPLES + """,
b AS (SELECT min(collection_date) AS lo, max(collection_date) AS hi FROM samples),
x AS (SELECT s.seq_name, CAST(date_diff('day', b.lo, s.collection_date) + 1 AS INTEGER) AS day_num,
  CAST(date_diff('day', b.lo, b.hi) + 1 AS INTEGER) AS max_num FROM samples s, b)
SELECT seq_name, day_num, CAST(ceil(day_num / 7.0) AS INTEGER) AS day_bin FROM x WHERE day_num <= floor(max_num / 7) * 7""")
def q_day_index_and_bin(spark, d):
    s = S.samples(spark, d).select("seq_name", "collection_date")
    return C.day_index_and_bin(s, "collection_date", 7).select("seq_name", "day_num", "day_bin")


@register("month_floor", "WITH " + SAMPLES + """
SELECT seq_name, CAST(CAST(date_trunc('month', collection_date) AS DATE) AS VARCHAR) AS month, strftime(collection_date, '%Y-%m') AS month_label FROM samples""")
def q_month_floor(spark, d):
    s = S.samples(spark, d).select("seq_name", "collection_date")
    s = C.month_label(C.month_floor(s, "collection_date"), "collection_date")
    return s.select("seq_name", ds("month").alias("month"), "month_label")


@register("mutation_position", """SELECT p_partkey, TRY_CAST(nullif(regexp_replace(p_brand, '[^0-9]', '', 'g'), '') AS INTEGER) AS pos,
  TRY_CAST(nullif(regexp_replace(CASE WHEN p_size > 45 THEN 'NA' ELSE p_name END, '[^0-9]', '', 'g'), '') AS INTEGER) AS pos2 FROM part""")
def q_mutation_position(spark, d):
    p = S.table(spark, d, "part").withColumn("m2", F.when(F.col("p_size") > 45, F.lit("NA")).otherwise(F.col("p_name")))
    p = C.mutation_position(p, "p_brand", "pos")
    p = C.mutation_position(p, "m2", "pos2")
    return p.select("p_partkey", "pos", "pos2")


SUBST_SQL = "WITH " + ESC + """,
sub AS (SELECT e.l_orderkey, e.l_linenumber, e.l_partkey,
  substr(bb.seq, 1, e.site - 1) || e.mutation || substr(bb.seq, e.site + 1) AS seq
  FROM esc e JOIN bb ON e.target_virus = bb.target)"""


@register("apply_substitution", SUBST_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, md5(seq) AS seq_md5, CAST(length(seq) AS INTEGER) AS seq_len FROM sub")
def q_apply_substitution(spark, d):
    e = S.escape_rows(spark, d)
    j = joins.backbone_join(e.withColumnRenamed("target_virus", "target"), S.backbones(spark, d), "target")
    j = C.apply_substitution(j, "seq", "site", "mutation")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.md5("seq").alias("seq_md5"), F.length("seq").alias("seq_len"))


@register("log_transform", """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(nullif(l_extendedprice / 10000.0, 0)), 6) AS ln_re,
  round(log10(l_discount * l_tax + 1), 6) AS log_escape, round(ln(l_discount + 0.1), 6) AS ln_disc,
  round(CASE WHEN l_tax > 0 THEN log10(l_tax) END, 6) AS log10_tax FROM lineitem""")
def q_log_transform(spark, d):
    li = S.table(spark, d, "lineitem").withColumns({"re": F.col("l_extendedprice") / 10000.0,
                                                    "w": F.col("l_discount") * F.col("l_tax")})
    li = C.log_transform(li, "re", "ln_re")
    li = C.log_transform(li, "w", "log_escape", base=10, pseudo=1.0)
    li = C.log_transform(li, "l_discount", "ln_disc", pseudo=0.1)
    li = C.log_transform(li, "l_tax", "log10_tax", base=10)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(c) for c in ["ln_re", "log_escape", "ln_disc", "log10_tax"]])


@register("potency_weighted_escape", "WITH " + ESC + " SELECT l_orderkey, l_linenumber, l_partkey, mut_escape * neg_log_ic50 AS mut_escape_w FROM esc")
def q_potency(spark, d):
    return C.potency_weighted_escape(S.escape_rows(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "mut_escape_w")


@register("compose_key", S4 + " SELECT doc_id, lang || '_' || CAST(quality AS VARCHAR) AS task FROM s4")
def q_compose_key(spark, d):
    return C.compose_key(S.labelled_documents(spark, d), ["lang", "quality"], "_", "task").select("doc_id", "task")


@register("clip01", S4 + """ SELECT doc_id, CASE WHEN x IS NULL THEN NULL ELSE greatest(0.0, least(1.0, x)) END AS clipped
  FROM (SELECT doc_id, CAST(quality AS DOUBLE) * 1.5 - 0.25 + n_chars / 100000.0 AS x FROM s4)""")
def q_clip01(spark, d):
    t = S.labelled_documents(spark, d).withColumn("x", F.col("quality").cast("double") * 1.5 - 0.25 + F.col("n_chars") / 100000.0)
    return C.clip01(t, "x", "clipped").select("doc_id", "clipped")


@register("growth_to_re", "SELECT l_orderkey, l_linenumber, l_partkey, round(exp(l_discount / 100.0 / 1.0 * 2.1), 6) AS relative_re FROM lineitem")
def q_growth_to_re(spark, d):
    li = C.growth_to_re(S.table(spark, d, "lineitem"), "l_discount", 100.0, 1.0, 2.1)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r6("relative_re").alias("relative_re"))


@register("conditional_label", """SELECT o.o_orderkey, l.l_linenumber,
  CASE WHEN g = 'fitness' AND CAST(l.l_shipdate AS DATE) >= DATE '1998-01-01' THEN 'fitness_recent'
       WHEN g = 'fitness' AND CAST(l.l_shipdate AS DATE) < DATE '1998-01-01' THEN 'fitness' ELSE g END AS major_group2
  FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'immune' ELSE 'fitness' END AS g FROM orders) o
  LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def q_conditional_label(spark, d):
    o = S.table(spark, d, "orders").withColumn("g", F.when(F.col("o_orderstatus") == "P", "immune").otherwise("fitness"))
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return C.conditional_label(j, "g", "l_shipdate", "1998-01-01").select("o_orderkey", "l_linenumber", "major_group2")


@register("tag_source", "WITH " + SAMPLES + " SELECT seq_name, 'train' AS data_class FROM samples")
def q_tag_source(spark, d):
    return C.tag_source(S.samples(spark, d).select("seq_name"), "data_class", "train")


@register("rename_select", "WITH " + ESC + " SELECT target_virus AS target, mutation AS mutant, site AS position, l_orderkey FROM esc")
def q_rename_select(spark, d):
    return C.rename_select(S.escape_rows(spark, d), {"target_virus": "target", "mutation": "mutant", "site": "position"},
                           ["target", "mutant", "position", "l_orderkey"])


VOCAB = {ch: i + 4 for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz")}


@register("encode_residues", """SELECT doc_id, CAST(length(text) + 2 AS INTEGER) AS n_ids, CAST(length(text) + 2 AS INTEGER) AS n_real,
  CAST(length(text) - length(regexp_replace(text, '[^a-z]', '', 'g')) AS INTEGER) AS n_unk FROM documents""")
def q_encode_residues(spark, d):
    t = C.encode_residues(S.documents(spark, d).select("doc_id", "text"), VOCAB, "text", max_len=None)
    return t.select("doc_id", F.size("input_ids").alias("n_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.size(F.filter("input_ids", lambda x: x == 3)).alias("n_unk"))


@register("mask_residues", "SELECT CAST(sum(length(text)) AS BIGINT) AS n_eligible, true AS share_ok FROM documents")
def q_mask_residues(spark, d):
    t = C.encode_residues(S.documents(spark, d).select("doc_id", "text"), VOCAB, "text", max_len=None)
    t = C.mask_residues(t, "doc_id", mask_id=32, vocab_size=33)
    chosen = F.size(F.filter("labels", lambda x: x != -100))
    eligible = F.size(F.filter("input_ids", lambda x: ~x.isin(0, 1, 2)))
    agg = t.agg(F.sum(chosen).cast("bigint").alias("n_chosen"), F.sum(eligible).cast("bigint").alias("n_eligible"))
    share = F.col("n_chosen") / F.col("n_eligible")
    return agg.select("n_eligible", ((share >= 0.13) & (share <= 0.17)).alias("share_ok"))


def _mixed_sql(x: str) -> str:
    """The steps of the 32-bit finaliser, from column x0 to x5."""
    return (f"SELECT *, xor({x}0, {x}0 >> 16) AS {x}1, ({x}1 * 2146121005) & 4294967295 AS {x}2, xor({x}2, {x}2 >> 15) AS {x}3, "
            f"(({x}3::HUGEINT * 2221713035) % 4294967296)::BIGINT AS {x}4, xor({x}4, {x}4 >> 16) AS {x}5 FROM ")


MASK_SQL = """WITH d AS (SELECT doc_id, ('0x' || substr(md5('13|' || doc_id::VARCHAR), 1, 8))::BIGINT AS seed, regexp_extract_all(text, '(?s).') AS chars FROM documents),
p AS (SELECT doc_id, seed, len(chars) AS n, unnest(chars) AS c, generate_subscripts(chars, 1) AS place FROM d),
k AS (SELECT doc_id, n, place, CASE WHEN c ~ '[a-z]' THEN ascii(c) - 97 + 4 ELSE 3 END AS id, {0} FROM p),
ha AS (""" + _mixed_sql("a") + "k), hb AS (" + _mixed_sql("b") + "ha), hc AS (" + _mixed_sql("c") + """hb),
r AS (SELECT doc_id, place, id, b5, c5, row_number() OVER (PARTITION BY doc_id ORDER BY a5, place) <= floor(0.15 * n + 0.5) AS chosen FROM hc),
m AS (SELECT doc_id, place, CASE WHEN NOT chosen THEN id WHEN b5 * 10 < 8 * 4294967296 THEN 32 WHEN b5 * 10 < 9 * 4294967296 THEN c5 % 33 ELSE id END AS masked, CASE WHEN chosen THEN id ELSE -100 END AS label FROM r),
t AS (SELECT doc_id, string_agg(masked::VARCHAR, ',' ORDER BY place) AS ids, string_agg(label::VARCHAR, ',' ORDER BY place) AS labels FROM m GROUP BY doc_id)
SELECT doc_id, md5('0,' || coalesce(ids || ',', '') || '2') AS ids_md5, md5('-100,' || coalesce(labels || ',', '') || '-100') AS labels_md5 FROM documents LEFT JOIN t USING (doc_id)"""
MASK_SQL = MASK_SQL.replace("{0}", ", ".join(f"(seed + place * 2654435769 + {i * 0x85EBCA6B & 0xFFFFFFFF}) % 4294967296 AS {x}0" for i, x in enumerate("abc")))


@register("mask_residues_ids", MASK_SQL)
def q_mask_ids(spark, d):
    """Every masked id and label."""
    t = C.encode_residues(S.documents(spark, d).select("doc_id", "text"), VOCAB, "text", max_len=None)
    t = C.mask_residues(t, "doc_id", mask_id=32, vocab_size=33)
    return t.select("doc_id", *[F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(o) for c, o in (("masked_ids", "ids_md5"), ("labels", "labels_md5"))])


# ------------------------------------------------------------ 2.3 filters
@register("keep_equal", "WITH " + SAMPLES + " SELECT seq_name FROM samples WHERE clade = '1-URGENT'")
def q_keep_equal(spark, d):
    return filters.keep_equal(S.samples(spark, d), "clade", "1-URGENT").select("seq_name")


@register("exclude_members", S4 + " SELECT doc_id, quality FROM s4 WHERE quality IS NULL OR quality NOT IN (0)")
def q_exclude_members(spark, d):
    return filters.exclude_members(S.labelled_documents(spark, d), "quality", [0]).select("doc_id", "quality")


@register("quality_filter", f"""SELECT doc_id FROM documents
  WHERE {_cnt('q')} / CAST(length(text) AS DOUBLE) < 0.01 AND {_cnt('W')} = 1""")
def q_quality_filter(spark, d):
    t = C.residue_counts(S.documents(spark, d).select("doc_id", "text"), "text", unknown="q", stop="W")
    return filters.quality_filter(t).select("doc_id")


@register("gap_filter", f"SELECT doc_id FROM documents WHERE {_cnt('x')} <= 5 AND {_cnt(',')} <= 30")
def q_gap_filter(spark, d):
    t = C.gap_counts(S.documents(spark, d).select("doc_id", "text"), "text", unknown="x", gap=",")
    return filters.gap_filter(t, 5, 30).select("doc_id")


@register("threshold_filter", "WITH " + ESC + " SELECT l_orderkey, l_linenumber, l_partkey FROM esc WHERE ic50 < 10")
def q_threshold_filter(spark, d):
    return filters.threshold_filter(S.escape_rows(spark, d), "ic50", "<", 10).select("l_orderkey", "l_linenumber", "l_partkey")


@register("keep_gene", S1 + " SELECT seq_name, mut FROM muts WHERE contains(mut, '79O')")
def q_keep_gene(spark, d):
    return filters.keep_gene(S.mutations(spark, d), "mut", "79O")


@register("keep_members", "WITH " + SAMPLES + " SELECT seq_name, country FROM samples WHERE country IN ('ASIA', 'AFRICA')")
def q_keep_members(spark, d):
    return filters.keep_members(S.samples(spark, d), "country", ["ASIA", "AFRICA"]).select("seq_name", "country")


@register("split_by_cutoff", """SELECT o.o_orderkey, l.l_linenumber,
  CASE WHEN CAST(l.l_shipdate AS DATE) >= DATE '1999-01-01' THEN 'future' ELSE 'past' END AS part
  FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def q_split_by_cutoff(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey")
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    past, fut = filters.split_by_cutoff(j, "l_shipdate", "1999-01-01")
    return past.withColumn("part", F.lit("past")).unionByName(fut.withColumn("part", F.lit("future"))).select(
        "o_orderkey", "l_linenumber", "part")


@register("rows_with_null", S4 + " SELECT doc_id FROM s4 WHERE quality IS NULL OR toxic IS NULL")
def q_rows_with_null(spark, d):
    return filters.rows_with_null(S.labelled_documents(spark, d)).select("doc_id")


@register("drop_any_null", S4 + " SELECT doc_id FROM s4 WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def q_drop_any_null(spark, d):
    return filters.drop_any_null(S.labelled_documents(spark, d)).select("doc_id")


CUTOFFS = [("1-URGENT", "1996-01-01"), ("2-HIGH", "1999-06-01"), ("3-MEDIUM", None)]
CUTOFF_SQL = "(VALUES ('1-URGENT', DATE '1996-01-01'), ('2-HIGH', DATE '1999-06-01'), ('3-MEDIUM', NULL)) AS cut(clade, cutoff)"


def _cutoffs(spark):
    return spark.createDataFrame(CUTOFFS, "clade string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))


@register("cutoff_or_null_filter", "WITH " + SAMPLES + f""" SELECT s.seq_name FROM samples s LEFT JOIN {CUTOFF_SQL} ON s.clade = cut.clade
  WHERE s.collection_date >= cut.cutoff OR cut.cutoff IS NULL""")
def q_cutoff_or_null(spark, d):
    s = S.samples(spark, d).withColumnRenamed("collection_date", "date_first")
    j = joins.left_join(s, _cutoffs(spark), "clade")
    return filters.cutoff_or_null_filter(j, "date_first", "cutoff").select("seq_name")


# ------------------------------------------------------------ 2.4 joins
@register("inner_join_keep_multiplicity", S1 + " SELECT s.country, count(*) AS n FROM samples s JOIN muts m ON s.seq_name = m.seq_name GROUP BY s.country")
def q_inner_mult(spark, d):
    s, m = _s1(spark, d)
    return joins.inner_join_keep_multiplicity(s, m, "seq_name").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@register("left_join", S4 + " SELECT doc_id, quality FROM s4")
def q_left_join(spark, d):
    docs = S.documents(spark, d).select("doc_id")
    return joins.left_join(docs, S.table(spark, d, "labels"), "doc_id").select("doc_id", "quality")


@register("right_join_keep_unmatched", S1 + " SELECT s.seq_name, m.mut FROM muts m RIGHT JOIN samples s ON m.seq_name = s.seq_name")
def q_right_join(spark, d):
    s, m = _s1(spark, d)
    return joins.right_join_keep_unmatched(m, s.select("seq_name"), "seq_name").select("seq_name", "mut")


@register("null_safe_join", S4 + """, qn AS (SELECT quality, count(*) AS n_q FROM s4 GROUP BY quality)
  SELECT s4.doc_id, s4.quality, qn.n_q FROM s4 JOIN qn ON s4.quality IS NOT DISTINCT FROM qn.quality""")
def q_null_safe(spark, d):
    t = S.labelled_documents(spark, d).select("doc_id", "quality")
    qn = t.groupBy("quality").agg(F.count(F.lit(1)).alias("n_q"))
    return joins.null_safe_join(t, qn, ["quality"]).select("doc_id", "quality", "n_q")


@register("semi_join", S1 + " SELECT seq_name FROM samples WHERE seq_name IN (SELECT seq_name FROM muts)")
def q_semi(spark, d):
    s, m = _s1(spark, d)
    return joins.semi_join(s.select("seq_name"), m, "seq_name")


@register("attach_sequence", "WITH " + FIT + " SELECT l_orderkey, l_linenumber, l_partkey, md5(seq) AS seq_md5 FROM fit")
def q_attach(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              S.backbone_of_part().alias("seq_name"))
    fasta = S.backbones(spark, d).withColumnRenamed("target", "name")
    j = joins.attach_sequence(li, fasta, "seq_name")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.md5("seq").alias("seq_md5"))


GRID_MONTHS = [f"1995-{m:02d}-01" for m in range(1, 13)] + [f"1996-{m:02d}-01" for m in range(1, 10)]


@register("cross_grid", "WITH " + SAMPLES + """ SELECT c.clade, CAST(m.month AS VARCHAR) AS month FROM (SELECT DISTINCT clade FROM samples) c,
  (SELECT CAST(generate_series AS DATE) AS month FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-09-01', INTERVAL 1 MONTH)) m""")
def q_cross_grid(spark, d):
    c = S.samples(spark, d).select("clade").distinct()
    return joins.cross_grid(c, "month", GRID_MONTHS, "date").select("clade", ds("month").alias("month"))


@register("backbone_join", "WITH " + ESC + " SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, CAST(length(bb.seq) AS INTEGER) AS backbone_len FROM esc e JOIN bb ON e.target_virus = bb.target")
def q_backbone(spark, d):
    e = S.escape_rows(spark, d).withColumnRenamed("target_virus", "target")
    j = joins.backbone_join(e, S.backbones(spark, d), "target")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.length("seq").alias("backbone_len"))


@register("join_predictions", "SELECT p_partkey AS row_id, p_type, round(p_retailprice / 1000.0, 6) AS predicted_outcome FROM part")
def q_join_pred(spark, d):
    p = S.table(spark, d, "part")
    pred = p.select(F.col("p_partkey").alias("row_id"), r6(F.col("p_retailprice") / 1000.0).alias("predicted_outcome"))
    rows = p.select(F.col("p_partkey").alias("row_id"), "p_type")
    return joins.join_predictions(pred, rows, "row_id").select("row_id", "p_type", "predicted_outcome")


# ------------------------------------------------------------ 2.5 aggregations
@register("count_having", S1 + """ SELECT m.mut, count(*) AS n FROM muts m RIGHT JOIN samples s ON m.seq_name = s.seq_name
  GROUP BY m.mut HAVING count(*) > 100""")
def q_count_having(spark, d):
    s, m = _s1(spark, d)
    j = joins.right_join_keep_unmatched(m, s.select("seq_name"), "seq_name")
    return aggs.count_having(j, "mut", 100, strict=True)


@register("filter_groups_by_size", """SELECT doc_id FROM documents WHERE lang IN
  (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 120)""")
def q_filter_groups(spark, d):
    return aggs.filter_groups_by_size(S.documents(spark, d), "lang", 120).select("doc_id")


@register("value_counts", S4 + " SELECT quality, count(*) AS n FROM s4 WHERE quality IS NOT NULL GROUP BY quality")
def q_value_counts(spark, d):
    return aggs.value_counts(S.labelled_documents(spark, d), "quality")


@register("distinct_rows", "SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def q_distinct(spark, d):
    return aggs.distinct_rows(S.documents(spark, d).select(F.md5("text").alias("text_md5")))


LI_COLS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
           "l_linestatus", "l_shipdate"]


@register("dedupe_keep_first", f"""SELECT l_orderkey, l_linenumber, {', '.join(LI_COLS[:-1])}, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LI_COLS)}) AS rn FROM lineitem) WHERE rn = 1""")
def q_dedupe(spark, d):
    li = S.table(spark, d, "lineitem")
    out = aggs.dedupe_keep_first(li, ["l_orderkey", "l_linenumber"], LI_COLS)
    return out.select("l_orderkey", "l_linenumber", *LI_COLS[:-1], ds("l_shipdate").alias("l_shipdate"))


@register("haplotype_string", S1 + """ SELECT s.seq_name, coalesce(string_agg(DISTINCT m.mut, ', ' ORDER BY m.mut), 'NA') AS haplotype
  FROM muts m RIGHT JOIN samples s ON m.seq_name = s.seq_name GROUP BY s.seq_name""")
def q_hap_string(spark, d):
    s, m = _s1(spark, d)
    return aggs.haplotype_string(joins.right_join_keep_unmatched(m, s.select("seq_name"), "seq_name"), "seq_name", "mut")


@register("first_seen_quantile", "WITH " + SAMPLES + """ SELECT country, clade, CAST(quantile_disc(collection_date, 0.01) AS VARCHAR) AS date_first
  FROM samples GROUP BY country, clade""")
def q_first_seen(spark, d):
    q = aggs.first_seen_quantile(S.samples(spark, d), ["country", "clade"], "collection_date", 0.01)
    return q.select("country", "clade", ds("date_first").alias("date_first"))


@register("exact_quantile", """SELECT p.p_type, round(quantile_cont(l.l_extendedprice, 0.95), 6) AS q95, round(quantile_cont(l.l_discount, 0.5), 6) AS q50
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_type""")
def q_exact_quantile(spark, d):
    li = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a = aggs.exact_quantile(li, "l_extendedprice", 0.95, ["p_type"], "q95")
    b = aggs.exact_quantile(li, "l_discount", 0.5, ["p_type"], "q50")
    return a.join(b, "p_type").select("p_type", r6("q95").alias("q95"), r6("q50").alias("q50"))


@register("group_min_date", "WITH " + SAMPLES + " SELECT clade, CAST(min(collection_date) AS VARCHAR) AS date_first FROM samples GROUP BY clade")
def q_group_min(spark, d):
    g = aggs.group_min_date(S.samples(spark, d), "clade", "collection_date")
    return g.select("clade", ds("date_first").alias("date_first"))


def _stage(spark, d, bin_size: int = 1):
    s, m = _s1(spark, d)
    return H.prepare(s, m, "1-URGENT", 100, 20, bin_size)


@register("reference_haplotype", S1 + hap_sql() + """,
rows AS (SELECT s.*, hap.hap_id FROM samples s JOIN (SELECT DISTINCT seq_name, hap_id FROM hap) hap USING (seq_name)),
per AS (SELECT country, hap_id, count(*) AS n FROM rows WHERE clade = '1-URGENT' GROUP BY country, hap_id),
st AS (SELECT hap_id, min(n) AS count_min, count(*) AS nc FROM per GROUP BY hap_id)
SELECT hap_id, count_min FROM st WHERE nc = (SELECT count(DISTINCT country) FROM rows WHERE clade = '1-URGENT')
ORDER BY count_min DESC, hap_id LIMIT 1""")
def q_reference_hap(spark, d):
    s, m = _s1(spark, d)
    haps = H.build_haplotypes(s, m, 100, 20)
    rows = s.join(haps.select("seq_name", "hap_id").distinct(), "seq_name")
    return aggs.reference_haplotype(rows, "1-URGENT")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PIVOT_SQL = "WITH " + SAMPLES + ", cnt AS (SELECT clade, country, count(*) AS n FROM samples GROUP BY clade, country)"


@register("pivot_counts", PIVOT_SQL + " SELECT clade, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN country = '{r}' THEN n END), 0) AS BIGINT) AS \"{r}\"" for r in REGIONS) + " FROM cnt GROUP BY clade")
def q_pivot(spark, d):
    cnt = S.samples(spark, d).groupBy("clade", "country").agg(F.count(F.lit(1)).alias("n"))
    return aggs.pivot_counts(cnt, "clade", "country", REGIONS)


@register("unpivot_counts", PIVOT_SQL + """ SELECT c.clade, r.r_name AS key, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT clade FROM cnt) c CROSS JOIN region r LEFT JOIN cnt ON cnt.clade = c.clade AND cnt.country = r.r_name""")
def q_unpivot(spark, d):
    cnt = S.samples(spark, d).groupBy("clade", "country").agg(F.count(F.lit(1)).alias("n"))
    return aggs.unpivot_counts(aggs.pivot_counts(cnt, "clade", "country", REGIONS), ["clade"], "key", "n")


@register("pearson", "SELECT l_returnflag, round(corr(l_discount, l_tax), 6) AS pearson FROM lineitem GROUP BY l_returnflag")
def q_pearson(spark, d):
    p = aggs.pearson(S.table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return p.select("l_returnflag", r6("pearson").alias("pearson"))


SPEARMAN_SQL = """WITH r AS (SELECT l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_returnflag, l_tax) - 1) / 2.0 AS rb
  FROM lineitem)"""


@register("spearman", SPEARMAN_SQL + " SELECT l_returnflag, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY l_returnflag")
def q_spearman(spark, d):
    s = aggs.spearman(S.table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_tax"), "l_discount", "l_tax",
                      ["l_returnflag"])
    return s.select("l_returnflag", r6("spearman").alias("spearman"))


@register("weighted_mse", "SELECT l_returnflag, round(sum(l_quantity * (l_tax - l_discount) ^ 2) / count(l_discount), 6) AS wmse FROM lineitem GROUP BY l_returnflag")
def q_wmse(spark, d):
    w = aggs.weighted_mse(S.table(spark, d, "lineitem"), "l_tax", "l_discount", "l_quantity", ["l_returnflag"])
    return w.select("l_returnflag", r6("wmse").alias("wmse"))


R2_SQL = """SELECT l_returnflag, round(1 - sum((l_discount - l_tax) ^ 2) / (var_pop(l_discount) * count(*)), 6) AS r2
  FROM lineitem GROUP BY l_returnflag"""


@register("r2_score", R2_SQL)
def q_r2(spark, d):
    r = aggs.r2_score(S.table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return r.select("l_returnflag", r6("r2").alias("r2"))


@register("fit_line", "SELECT l_returnflag, round(regr_slope(l_tax, l_discount), 6) AS slope, round(regr_intercept(l_tax, l_discount), 6) AS intercept FROM lineitem GROUP BY l_returnflag")
def q_fit_line(spark, d):
    f = aggs.fit_line(S.table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return f.select("l_returnflag", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@register("perplexity", "SELECT l_returnflag, l_linestatus, round(exp(avg(l_tax)), 6) AS perplexity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def q_perplexity(spark, d):
    p = aggs.perplexity(S.table(spark, d, "lineitem"), "l_tax", ["l_returnflag", "l_linestatus"])
    return p.select("l_returnflag", "l_linestatus", r6("perplexity").alias("perplexity"))


@register("positions_mutated", S1 + """ SELECT TRY_CAST(nullif(regexp_replace(mut, '[^0-9]', '', 'g'), '') AS INTEGER) AS pos, count(*) AS count_hap
  FROM muts GROUP BY 1""")
def q_positions(spark, d):
    m = C.mutation_position(S.mutations(spark, d), "mut", "pos")
    return aggs.positions_mutated(m, "pos", "count_hap")


# ------------------------------------------------------------ 2.6 window-style
SCALE_SQL = """WITH x AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_type AS g, log10(l.l_discount * l.l_tax + 1) AS v
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
st AS (SELECT g, min(v) AS lo, quantile_cont(v, 0.95) AS hi FROM x GROUP BY g),
y AS (SELECT x.*, CASE WHEN st.hi - st.lo <> 0 THEN (v - st.lo) / (st.hi - st.lo)
  WHEN v - st.lo > 0 THEN 'inf'::DOUBLE WHEN v - st.lo < 0 THEN '-inf'::DOUBLE END AS r FROM x JOIN st USING (g))
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN r IS NULL OR isnan(r) THEN NULL ELSE greatest(0.0, least(1.0, r)) END, 6) AS outcome FROM y"""


@register("scale_within_group", SCALE_SQL)
def q_scale(spark, d):
    li = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_type").alias("g"),
                  F.log10(F.col("l_discount") * F.col("l_tax") + 1).alias("v"))
    return windows.scale_within_group(x, "g", "v").select("l_orderkey", "l_linenumber", "l_partkey", r6("outcome").alias("outcome"))


@register("quantile_normalise", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, ln(l_extendedprice / 10000.0) AS v FROM lineitem),
q AS (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round((v - lo) / (hi - lo), 6) AS outcome FROM x, q""")
def q_qnorm(spark, d):
    x = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                             F.ln(F.col("l_extendedprice") / 10000.0).alias("v"))
    return windows.quantile_normalise(x, "v", 0.001, 0.999, "outcome").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6("outcome").alias("outcome"))


@register("top_one_per_group", "WITH " + SAMPLES + """, cnt AS (SELECT country, clade, count(*) AS n FROM samples GROUP BY country, clade)
SELECT country, clade, n FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, clade) AS rn FROM cnt) WHERE rn = 1""")
def q_top_one(spark, d):
    cnt = S.samples(spark, d).groupBy("country", "clade").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_one_per_group(cnt, "country", "n", "clade").select("country", "clade", "n")


@register("sample_one_per_group", "WITH " + SAMPLES + " SELECT country, count(*) AS n_rows, true AS is_member FROM (SELECT DISTINCT country FROM samples) GROUP BY country")
def q_sample_one(spark, d):
    s = S.samples(spark, d)
    pick = windows.sample_one_per_group(s.select("country", "seq_name"), "country", "seq_name", 42)
    member = pick.join(s.select("country", "seq_name"), ["country", "seq_name"], "left_semi")
    return member.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(True).alias("is_member"))


@register("dense_ids", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_id FROM part")
def q_dense_ids(spark, d):
    return windows.dense_ids(S.table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "brand_id").select("p_partkey", "brand_id")


@register("shuffle_and_number", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS min_id, count(*) - 1 AS max_id, count(*) AS n_distinct FROM events")
def q_shuffle(spark, d):
    e = windows.shuffle_and_number(S.table(spark, d, "events"), ["event_id"], 13, "row_id")
    return e.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("min_id"), F.max("row_id").alias("max_id"),
                 F.countDistinct("row_id").alias("n_distinct"))


FOLDS_SQL = """WITH c AS (SELECT event_type, count(*) AS nc FROM events GROUP BY event_type),
o AS (SELECT event_type, nc, coalesce(sum(nc) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c),
f AS (SELECT o.*, CAST(k.range AS INTEGER) AS fold, ((k.range - off) % 5 + 5) % 5 AS r FROM o, range(5) k)
SELECT event_type, fold, CAST((nc - 1 - r) // 5 + 1 AS BIGINT) AS n FROM f WHERE r < nc"""


@register("stratified_folds", FOLDS_SQL)
def q_folds(spark, d):
    e = windows.stratified_folds(S.table(spark, d, "events"), "event_type", ["event_id"], 5, 13)
    return e.groupBy("event_type", "fold").agg(F.count(F.lit(1)).alias("n"))


CHUNK_SQL = """WITH u AS (SELECT user_id, count(*) AS m FROM events GROUP BY user_id)
SELECT user_id, CAST(c.range AS INTEGER) AS chunk, CAST(least(10, m - c.range * 10) AS BIGINT) AS n FROM u, range(0, 100000) c WHERE c.range * 10 < m"""


@register("task_chunks", CHUNK_SQL)
def q_chunks(spark, d):
    e = windows.task_chunks(S.table(spark, d, "events"), "user_id", "event_id", 10, 13)
    return e.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@register("order_categories_by_date", "WITH " + SAMPLES + """, f AS (SELECT clade, min(collection_date) AS d FROM samples GROUP BY clade)
SELECT clade, row_number() OVER (ORDER BY d, clade) AS axis_order FROM f""")
def q_order_cat(spark, d):
    f = aggs.group_min_date(S.samples(spark, d), "clade", "collection_date", "d")
    return windows.order_categories_by_date(f, "clade", "d").select("clade", "axis_order")


# ------------------------------------------------------------ 2.7 sorts / unions
@register("sort_desc", "WITH " + SAMPLES + " SELECT country, count(*) AS n FROM samples GROUP BY country")
def q_sort_desc(spark, d):
    cnt = S.samples(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return setops.sort_desc(cnt, "n", ["country"])


@register("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY round(p_retailprice, 10) DESC, p_partkey LIMIT 10")
def q_top_k(spark, d):
    return setops.top_k(S.table(spark, d, "part").select("p_partkey", "p_retailprice"), 10, "p_retailprice", ["p_partkey"])


@register("union_by_name_fill", S4 + """ SELECT doc_id, lang, quality, NULL::BIGINT AS text_len FROM s4
  UNION ALL SELECT item_id AS doc_id, NULL AS lang, NULL::INTEGER AS quality, CAST(length(text) AS BIGINT) AS text_len FROM benchmark""")
def q_union_fill(spark, d):
    a = S.labelled_documents(spark, d).select("doc_id", "lang", "quality")
    b = S.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("bigint").alias("text_len"))
    return setops.union_by_name_fill(a, b).select("doc_id", "lang", "quality", "text_len")


@register("union_all", "SELECT 'doc' AS src, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'bench' AS src, md5(text) AS text_md5 FROM benchmark")
def q_union_all(spark, d):
    a = S.documents(spark, d).select(F.lit("doc").alias("src"), F.md5("text").alias("text_md5"))
    b = S.table(spark, d, "benchmark").select(F.lit("bench").alias("src"), F.md5("text").alias("text_md5"))
    return setops.union_all(a, b)


# ------------------------------------------------------------ 2.8 arrays / features
WIDE_SQL = S1 + f""", lm AS (SELECT CAST(l_orderkey AS VARCHAR) AS seq_name, l_returnflag AS f, l_linenumber,
  {MUT} AS mut FROM lineitem),
wide AS (SELECT s.seq_name,
  coalesce(string_agg(CASE WHEN f = 'A' THEN mut END, ',' ORDER BY l_linenumber, mut), '') AS subs,
  coalesce(string_agg(CASE WHEN f = 'N' THEN mut END, ',' ORDER BY l_linenumber, mut), '') AS dels,
  coalesce(string_agg(CASE WHEN f = 'R' THEN mut END, ',' ORDER BY l_linenumber, mut), '') AS ins
  FROM samples s LEFT JOIN lm ON s.seq_name = lm.seq_name GROUP BY s.seq_name),
lists AS (SELECT seq_name, 0 AS kind, string_split(subs, ',') AS a FROM wide UNION ALL
  SELECT seq_name, 1, string_split(dels, ',') FROM wide UNION ALL SELECT seq_name, 2, string_split(ins, ',') FROM wide),
ex AS (SELECT seq_name, kind, unnest(a) AS mut, unnest(range(len(a))) AS ord FROM lists)"""


def _wide(spark, d):
    s = S.samples(spark, d).select("seq_name")
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("seq_name"),
                                              F.col("l_returnflag").alias("f"), "l_linenumber", S.mutation_label().alias("mut"))
    j = s.join(li, "seq_name", "left")

    def lst(flag):
        items = F.array_sort(F.collect_list(F.when(F.col("f") == flag, F.struct("l_linenumber", "mut"))))
        return F.array_join(F.transform(items, lambda x: x["mut"]), ",")
    return j.groupBy("seq_name").agg(lst("A").alias("aa_substitutions"), lst("N").alias("aa_deletions"),
                                     lst("R").alias("aa_insertions"))


@register("explode_mutation_lists", WIDE_SQL + " SELECT seq_name, mut, CAST(kind AS INTEGER) AS kind, CAST(ord AS INTEGER) AS ord FROM ex WHERE mut <> ''")
def q_explode_lists(spark, d):
    return features.explode_mutation_lists(_wide(spark, d))


@register("explode_haplotype", S1 + """, h AS (SELECT s.seq_name, coalesce(string_agg(DISTINCT m.mut, ', ' ORDER BY m.mut), 'NA') AS haplotype
  FROM muts m RIGHT JOIN samples s ON m.seq_name = s.seq_name GROUP BY s.seq_name)
SELECT seq_name, unnest(string_split(haplotype, ', ')) AS mut FROM h""")
def q_explode_hap(spark, d):
    s, m = _s1(spark, d)
    h = aggs.haplotype_string(joins.right_join_keep_unmatched(m, s.select("seq_name"), "seq_name"), "seq_name", "mut")
    return features.explode_haplotype(h, "haplotype", "mut").select("seq_name", "mut")


@register("multi_hot", "SELECT w AS token, count(*) AS n_docs FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def q_multi_hot(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("tokens"))
    vec, model = features.multi_hot(p, "tokens", "vec")
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(model.vocabulary)], "idx int, token string")
    hot = vec.select(F.posexplode(vector_to_array("vec")).alias("idx", "v")).where(F.col("v") > 0)
    return hot.join(vocab, "idx").groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


@register("one_hot_country", "WITH " + SAMPLES + """ SELECT country, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS hot_index, n
  FROM (SELECT country, count(*) AS n FROM samples GROUP BY country)""")
def q_one_hot(spark, d):
    s, _ = features.one_hot_country(S.samples(spark, d).select("country"), "country", "cv")
    hot = s.select("country", F.array_position(vector_to_array("cv"), 1.0).cast("int").alias("p"))
    return hot.groupBy("country", (F.col("p") - 1).alias("hot_index")).agg(F.count(F.lit(1)).alias("n"))


@register("task_vectors", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(c + ' DESC' for c in LI_COLS)}) AS rn FROM lineitem)
SELECT l_orderkey AS seq_id, count(*) AS n_labels, round(sum(l_discount), 6) AS sum_outcome, round(sum(l_tax), 6) AS sum_weight,
  min(l_linenumber) AS first_task, max(l_linenumber) AS last_task FROM r WHERE rn = 1 GROUP BY l_orderkey""")
def q_task_vectors(spark, d):
    li = with_global_ordinal(S.table(spark, d, "lineitem"), LI_COLS + ["l_orderkey", "l_linenumber"], "row_id")
    cells = li.select(F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("task_id"),
                      F.col("l_discount").alias("outcome"), F.col("l_tax").alias("weight"), "row_id")
    v = features.task_vectors(cells)
    return v.select("seq_id", F.size("labels").cast("bigint").alias("n_labels"),
                    r6(F.aggregate("labels", F.lit(0.0), lambda a, x: a + x["outcome"])).alias("sum_outcome"),
                    r6(F.aggregate("labels", F.lit(0.0), lambda a, x: a + x["weight"])).alias("sum_weight"),
                    F.col("labels")[0]["task_id"].alias("first_task"), F.element_at("labels", -1)["task_id"].alias("last_task"))


# ------------------------------------------------------------ 2.9 models and metrics
def _escape_tab(spark, d):
    return TR.escape_task_table(S.escape_rows(spark, d), S.backbones(spark, d), None, ["N"], 10.0)


def _fitness_tab(spark, d):
    return TR.fitness_task_table(S.fitness_rows(spark, d), 300, ["P"], "BA.2.86")


ESC_TAB_SQL = """, e1 AS (SELECT * FROM esc WHERE source IS NULL OR source NOT IN ('N')),
e2 AS (SELECT target_virus AS target, mutation AS mutant, site AS position, target_virus || '_' || "group" AS g,
  target_virus || '_' || condition AS data_group, log10(mut_escape * neg_log_ic50 + 1) AS v FROM e1 WHERE ic50 < 10 AND NOT isnan(ic50)),
st AS (SELECT g, min(v) AS lo, quantile_cont(v, 0.95) AS hi FROM e2 GROUP BY g),
e3 AS (SELECT e2.*, CASE WHEN st.hi - st.lo <> 0 THEN (v - st.lo) / (st.hi - st.lo)
  WHEN v - st.lo > 0 THEN 'inf'::DOUBLE WHEN v - st.lo < 0 THEN '-inf'::DOUBLE END AS r FROM e2 JOIN st USING (g)),
etab AS (SELECT e3.g AS "group", e3.data_group, CASE WHEN r IS NULL OR isnan(r) THEN NULL ELSE greatest(0.0, least(1.0, r)) END AS outcome,
  substr(bb.seq, 1, e3.position - 1) || e3.mutant || substr(bb.seq, e3.position + 1) AS seq FROM e3 JOIN bb ON e3.target = bb.target)"""

FIT_TAB_SQL = """, big AS (SELECT country FROM fit WHERE country IS NOT NULL GROUP BY country HAVING count(*) >= 300),
f1 AS (SELECT fit.*, CASE WHEN pango IN ('P') THEN 'BA.2.86' ELSE clade END AS clade2, ln(relative_re) AS lv
  FROM fit WHERE country IN (SELECT country FROM big)),
qs AS (SELECT quantile_cont(lv, 0.001) AS lo, quantile_cont(lv, 0.999) AS hi FROM f1),
ftab AS (SELECT 'fitness' AS "group", 'fitness_' || country AS data_group, (lv - lo) / (hi - lo) AS outcome, seq,
  date_first, clade2 AS clade, country FROM f1, qs)"""


@register("escape_task_table", "WITH " + ESC + ESC_TAB_SQL + """
SELECT "group", data_group, round(outcome, 6) AS outcome, md5(seq) AS seq_md5 FROM etab""")
def q_escape_tab(spark, d):
    t = _escape_tab(spark, d)
    return t.select("group", "data_group", r6("outcome").alias("outcome"), F.md5("seq").alias("seq_md5"))


@register("fitness_task_table", "WITH " + FIT + FIT_TAB_SQL + """
SELECT "group", data_group, round(outcome, 6) AS outcome, md5(seq) AS seq_md5, CAST(date_first AS VARCHAR) AS date_first, clade, country FROM ftab""")
def q_fitness_tab(spark, d):
    # A text is told by its digest, taken once; the rows don't carry it.
    texts = S.backbones(spark, d).withColumn("seq_md5", F.md5("seq"))
    t = TR.fitness_task_table(S.fitness_facts(spark, d, texts, ["seq_md5"]), 300, ["P"], "BA.2.86")
    return t.select("group", "data_group", r6("outcome").alias("outcome"), "seq.seq_md5",
                    ds("date_first").alias("date_first"), "clade", "country")


WEIGHT_ARGS = dict(cutoff="1999-01-01", thresh="1998-01-01", fitness_mult=1.0, recent_mult=2.0)
ALL_TAB_SQL = "WITH " + FIT + ", " + ESC.replace("bb AS (SELECT CAST(doc_id AS VARCHAR) AS target, text AS seq FROM documents)", "bb2 AS (SELECT 1)") \
    + ESC_TAB_SQL + FIT_TAB_SQL + """,
cat AS (SELECT "group", data_group, outcome, seq, date_first, clade, country FROM ftab
  UNION ALL SELECT "group", data_group, outcome, seq, NULL::DATE, NULL, NULL FROM etab),
cat2 AS (SELECT * FROM cat WHERE length(seq) - length(replace(seq, 'X', '')) <= 5 AND length(seq) - length(replace(seq, '-', '')) <= 30),
cnt AS (SELECT count(*) FILTER (WHERE "group" IS DISTINCT FROM 'fitness') AS n_imm,
  count(*) FILTER (WHERE date_first < DATE '1999-01-01') AS n_fit FROM cat2),
w AS (SELECT CASE WHEN n_imm > 0 THEN 1.0 / n_imm END AS wi, CASE WHEN n_fit > 0 THEN 1.0 / n_fit END AS wf FROM cnt),
lab AS (SELECT cat2.*, CASE WHEN "group" = 'fitness' THEN 'fitness' ELSE 'immune' END AS major_group,
  CASE WHEN "group" = 'fitness' AND date_first >= DATE '1998-01-01' THEN 'fitness_recent'
       WHEN "group" = 'fitness' AND date_first < DATE '1998-01-01' THEN 'fitness'
       WHEN "group" = 'fitness' THEN 'fitness' ELSE 'immune' END AS major_group2 FROM cat2),
wt AS (SELECT lab.*, CASE major_group2 WHEN 'immune' THEN wi / greatest(wi, wf) WHEN 'fitness' THEN wf / greatest(wi, wf) * 1.0
  WHEN 'fitness_recent' THEN wf / greatest(wi, wf) * 1.0 * 2.0 END AS weight FROM lab, w)"""


@register("loss_weights", ALL_TAB_SQL + " SELECT major_group2, round(weight, 6) AS weight, count(*) AS n FROM wt GROUP BY major_group2, round(weight, 6)")
def q_loss_weights(spark, d):
    # Gaps are counted once per text; the rows carry the counts.
    texts = C.gap_counts(S.backbones(spark, d), "seq")
    fit = TR.fitness_task_table(S.fitness_facts(spark, d, texts, ["count_x", "count_hyphen"]), 300, ["P"], "BA.2.86")
    esc = TR.escape_task_counts(materialize(S.escape_rows(spark, d).drop("l_orderkey", "l_linenumber", "l_partkey"), "escape_rows"), S.backbones(spark, d), None, ["N"], 10.0)
    cat = setops.union_by_name_fill(fit.select("*", "seq.*").drop("seq"), esc)
    cat = materialize(filters.gap_filter(cat, 5, 30), "counted_rows")
    w = models.loss_weights(cat, **WEIGHT_ARGS)
    return w.groupBy("major_group2", r6("weight").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def _train_table(spark, d, name="sliding", **changes):
    """A run's table on the stand-ins: all targets, dates within the line items'."""
    texts = S.backbones(spark, d).withColumnRenamed("target", "base")
    changes = {"target": None, "exclude_clades": (), **WEIGHT_ARGS, **changes}
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    escape, fitness = (rows.drop(*keys) for rows in (S.escape_rows(spark, d), S.fitness_refs(spark, d)))
    return TR.training_variant(name, escape, fitness, texts, ["N"], 300, ["P"], **changes)


TRAIN_SQL = ALL_TAB_SQL + """,
cls AS (SELECT *, CASE WHEN major_group = 'fitness' THEN data_group || '_' || clade ELSE data_group END AS split_class FROM wt),
past AS (SELECT * FROM cls WHERE date_first < DATE '1999-01-01' OR date_first IS NULL),
c1 AS (SELECT split_class, count(*) AS nc FROM past GROUP BY split_class),
o1 AS (SELECT split_class, nc, coalesce(sum(nc) OVER (ORDER BY split_class NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c1),
t1 AS (SELECT split_class, nc, ((0 - off) % 5 + 5) % 5 AS r FROM o1),
t2 AS (SELECT split_class, nc, CASE WHEN r < nc THEN (nc - 1 - r) // 5 + 1 ELSE 0 END AS n_test FROM t1),
c2 AS (SELECT split_class, nc - n_test AS nr, n_test FROM t2),
o2 AS (SELECT *, coalesce(sum(nr) OVER (ORDER BY split_class NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c2),
t3 AS (SELECT *, ((0 - off) % 4 + 4) % 4 AS r FROM o2),
t4 AS (SELECT split_class, n_test, CASE WHEN r < nr THEN (nr - 1 - r) // 4 + 1 ELSE 0 END AS n_val, nr FROM t3),
fut AS (SELECT split_class, count(*) AS n FROM cls WHERE date_first >= DATE '1999-01-01' GROUP BY split_class)
SELECT split_class, split, CAST(n AS BIGINT) AS n FROM (
  SELECT split_class, 'test' AS split, n_test AS n FROM t4 UNION ALL SELECT split_class, 'val', n_val FROM t4
  UNION ALL SELECT split_class, 'train', nr - n_val FROM t4 UNION ALL SELECT split_class, 'future', n FROM fut) WHERE n > 0"""


@register("training_table", TRAIN_SQL)
def q_training_table(spark, d):
    t = _train_table(spark, d)
    return t.groupBy("split_class", "split").agg(F.count(F.lit(1)).alias("n"))


PAST_SQL = "past AS (SELECT * FROM cls WHERE date_first < DATE '1999-01-01' OR date_first IS NULL)"


@register("training_sliding", TRAIN_SQL.replace(PAST_SQL, PAST_SQL[:-1].replace("WHERE ", "WHERE (") + ") AND (clade IS NULL OR clade NOT IN ('1-URGENT', '5-LOW')))"))
def q_training_sliding(spark, d):
    """Two clades are no part of the past, but of the future."""
    t = _train_table(spark, d, exclude_clades=("1-URGENT", "5-LOW"))
    return t.groupBy("split_class", "split").agg(F.count(F.lit(1)).alias("n"))


@register("training_rows", ALL_TAB_SQL.replace("<= 5 AND", "<= 0 AND").replace("<= 30)", "<= 2)") + """,
seqs AS (SELECT seq, row_number() OVER (ORDER BY seq COLLATE "binary") - 1 AS seq_id, length(seq) - length(replace(seq, 'X', '')) AS count_x,
  length(seq) - length(replace(seq, '-', '')) AS count_hyphen FROM (SELECT DISTINCT seq FROM cat2)),
tasks AS (SELECT data_group, row_number() OVER (ORDER BY data_group COLLATE "binary") - 1 AS task_id FROM (SELECT DISTINCT data_group FROM cat2))
SELECT wt.data_group, task_id, seq_id, md5(seqs.seq) AS seq_md5, count_x::INT AS count_x, count_hyphen::INT AS count_hyphen, round(weight, 6) AS weight, round(outcome, 6) AS outcome, count(*) AS n
FROM wt JOIN seqs USING (seq) JOIN tasks USING (data_group) GROUP BY ALL""")
def q_training_rows(spark, d):
    """Ids, counts, weights and outcomes of all rows, with gap limits that drop sequences."""
    t = _train_table(spark, d, max_x=0, max_gap=2)
    cols = ["data_group", "task_id", "seq_id", F.md5("seq").alias("seq_md5"), F.col("count_x").cast("int").alias("count_x"), F.col("count_hyphen").cast("int").alias("count_hyphen"), r6("weight").alias("weight"), r6("outcome").alias("outcome")]
    return t.select(*cols).groupBy("data_group", "task_id", "seq_id", "seq_md5", "count_x", "count_hyphen", "weight", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _model_frame(spark, d):
    return _model_frame_words(spark, d)[0]


def _model_frame_words(spark, d):
    """(frame, words in the order of their features). S9: part-name tokens + size bucket as country -> retail price; data_class by partkey hash.

    Every fit passes over the rows several times: the parts are dealt out first (few compressed files would be few tasks),
    and rows with their features are written once.
    """
    p = materialize(S.table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "parts")
    p = p.withColumn("tokens", F.array_distinct(F.split("p_name", " "))).withColumn("country", F.col("p_type"))
    p = p.withColumn("outcome", F.col("p_retailprice") / 1000.0)
    h = F.pmod(F.xxhash64("p_partkey", F.lit(42)), F.lit(10))
    p = p.withColumn("data_class", F.when(h < 6, "train").when(h < 8, "test").otherwise("future"))
    vec, words = features.multi_hot(p, "tokens", "mut_vec")
    vec, _ = features.one_hot_country(vec, "country", "country_vec")
    from pyspark.ml.feature import VectorAssembler
    m = VectorAssembler(inputCols=["mut_vec", "country_vec"], outputCol="features").transform(vec).drop("mut_vec", "country_idx", "country_vec")
    return materialize(m, "model_rows"), words.vocabulary


@register("select_features_rf")
def q_select_rf(spark, d):
    m = _model_frame(spark, d)
    slicer, idx = models.select_features_rf(m.where(F.col("data_class") == "train"), "features", "outcome", k=200)
    return spark.createDataFrame([(int(i),) for i in idx], "feature_index int")


def _fit_predict(spark, d, fn):
    m = _model_frame(spark, d)
    slicer, _ = models.select_features_rf(m.where(F.col("data_class") == "train"), "features", "outcome", k=200)
    m = slicer.transform(m)
    model, score = fn(m.where(F.col("data_class") == "train"), "selected", "outcome")
    pred = model.transform(m.where(F.col("data_class").isin("test", "future")))
    return pred.select("p_partkey", "data_class", "outcome", "predicted_outcome")


# The searches run with the library's defaults: the fixed draws, folds and ranges.
@register("regress_random_forest")
def q_rf(spark, d):
    return _fit_predict(spark, d, models.regress_random_forest)


@register("regress_lasso")
def q_lasso(spark, d):
    return _fit_predict(spark, d, models.regress_lasso)


@register("regress_boosted_trees")
def q_gbt(spark, d):
    return _fit_predict(spark, d, models.regress_boosted_trees)


def _one_split_frame(spark, d, m=None):
    """The model frame's features and a class by part key that SQL can tell; the outcome depends on two of the tokens."""
    m = _model_frame(spark, d) if m is None else m
    planted = F.array_contains("tokens", PLANTED[0]).cast("double") * 3 + F.array_contains("tokens", PLANTED[1]).cast("double") * 2
    return (m.withColumn("data_class", F.when(F.col("p_partkey") % 10 < 6, "train").when(F.col("p_partkey") % 10 < 8, "test").otherwise("future"))
            .withColumn("planted", planted + F.col("outcome") / 100))


#: Words of part names.
PLANTED = ("blue", "red")
PARTS_SQL = """WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS tokens, p_type, p_retailprice / 1000.0 AS outcome,
  CASE WHEN p_partkey % 10 < 6 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'test' ELSE 'future' END AS data_class FROM part),
f AS (SELECT p_partkey, unnest(list_concat(list_transform(tokens, lambda t: 't:' || t), ['c:' || p_type])) AS feature FROM p)"""


def _stump(m, fn, space):
    train = m.where(F.col("data_class") == "train")
    model, _ = fn(train, "features", "outcome", n_draws=1, folds=2, space={k: (lambda r, v=v: v) for k, v in space.items()})
    rows = model.transform(m.where(F.col("data_class") != "train"))
    return rows.select("p_partkey", "data_class", r6("outcome").alias("outcome"), r6("predicted_outcome").alias("predicted_outcome"))


STUMP_SQL = PARTS_SQL + """,
train AS (SELECT * FROM p WHERE data_class = 'train'),
every AS (SELECT count(*) AS n, sum(outcome) AS s FROM train),
g AS (SELECT feature, count(*) AS n1, sum(outcome) AS s1 FROM f JOIN train USING (p_partkey) GROUP BY feature),
best AS (SELECT feature, s1 / n1 AS with_it, (s - s1) / (n - n1) AS without_it FROM g, every WHERE n1 >= 2 AND n - n1 >= 2
  ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC LIMIT 1)
SELECT p_partkey, data_class, round(outcome, 6) AS outcome,
  round(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.p_partkey = p.p_partkey AND f.feature = best.feature) THEN with_it ELSE without_it END, 6) AS predicted_outcome
FROM p, best WHERE data_class <> 'train'"""


@register("boosted_stump", STUMP_SQL)
def q_boosted_stump(spark, d):
    """One round, one split, whole steps: the outcome's mean on the two sides of the best feature."""
    return _stump(_one_split_frame(spark, d), models.regress_boosted_trees, {"max_depth": 9, "learning_rate": 1.0, "rounds": 1, "min_child_weight": 1, "min_child_samples": 2, "leaves": 2, "reg_alpha": 0.0, "reg_lambda": 0.0})


@register("forest_stump", STUMP_SQL)
def q_forest_stump(spark, d):
    """A forest of one tree of depth one on all rows and features: the same split, grown by patterns on Spark."""
    fn = partial(models.regress_random_forest, max_cells=0)
    return _stump(_one_split_frame(spark, d), fn, {"trees": 1, "max_depth": 1, "max_features": None, "min_samples_split": 2, "min_samples_leaf": 2, "bootstrap": False})


@register("lasso_single", PARTS_SQL.replace("p_type, p_retailprice", "p_size::DOUBLE AS x, p_type, p_retailprice") + """,
m AS (SELECT covar_pop(x, outcome) AS c, var_pop(x) AS v, avg(x) AS mx, avg(outcome) AS my FROM p WHERE data_class = 'train'),
w AS (SELECT sign(c) * greatest(abs(c) - 0.0005, 0) / v AS w, mx, my FROM m)
SELECT p_partkey, data_class, round(outcome, 6) AS outcome, round(my + w * (x - mx), 6) AS predicted_outcome FROM p, w WHERE data_class <> 'train'""")
def q_lasso_single(spark, d):
    """One feature: the fit has a closed form."""
    from pyspark.ml.functions import array_to_vector
    m = _one_split_frame(spark, d).withColumn("features", array_to_vector(F.array(F.col("p_size").cast("double"))))
    return _stump(m, models.regress_lasso, {"alpha": 0.0005, "max_iter": 1000, "tol": 1e-12})


COMPARE_SQL = STUMP_SQL.replace("SELECT p_partkey, data_class, round(outcome, 6) AS outcome,", ", pred AS (SELECT data_class, outcome,").replace(
    "round(CASE WHEN EXISTS", "CASE WHEN EXISTS").replace("without_it END, 6) AS predicted_outcome", "without_it END AS y") + """),
sets AS (SELECT 'test_and_future' AS eval_set, * FROM pred UNION ALL SELECT 'future', * FROM pred WHERE data_class = 'future'),
scored AS (SELECT eval_set, count(*) AS n, round(corr(outcome, y), 6) AS pearson, round(1 - sum((outcome - y) ^ 2) / (var_pop(outcome) * count(*)), 6) AS r2 FROM sets GROUP BY eval_set)
SELECT model, scored.* FROM scored, (VALUES ('boosted'), ('forest')) m(model)"""


@register("model_comparison", COMPARE_SQL)
def q_model_comparison(spark, d):
    """Two models of one split each, from part names as haplotypes to the report."""
    p = S.table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("haplotype"), F.col("p_type").alias("country"), (F.col("p_retailprice") / 1000.0).alias("outcome"))
    p = p.withColumn("data_class", F.when(F.col("p_partkey") % 10 < 6, "train").when(F.col("p_partkey") % 10 < 8, "test").otherwise("future"))
    stump = {"max_depth": 9, "learning_rate": 1.0, "rounds": 1, "min_child_weight": 1, "min_child_samples": 2, "leaves": 2, "reg_alpha": 0.0, "reg_lambda": 0.0}
    tree = {"trees": 1, "max_depth": 1, "max_features": None, "min_samples_split": 2, "min_samples_leaf": 2, "bootstrap": False}

    def fit(fn, params):
        return lambda train: fn(train, n_draws=1, folds=2, space={k: (lambda r, v=v: v) for k, v in params.items()})[0]

    report, _ = CM.compare_models(CM.feature_frame(p), {"boosted": fit(models.regress_boosted_trees, stump), "forest": fit(models.regress_random_forest, tree)}, None)
    return report.select("model", "eval_set", "n", r6("pearson").alias("pearson"), r6("r2").alias("r2"))


@register("select_features_planted", f"SELECT token FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token IN {PLANTED}")
def q_select_planted(spark, d):
    """Two features of all decide the outcome, and two are to be selected."""
    m, words = _model_frame_words(spark, d)  # equally frequent words have no fixed order, so both come from one fit
    m = _one_split_frame(spark, d, m)
    _, idx = models.select_features_rf(m.where(F.col("data_class") == "train"), "features", "planted", k=2)
    return spark.createDataFrame([(words[i] if i < len(words) else None,) for i in idx], "token string")


SCORE_TASKS = ["fitness_A", "fitness_B", "dms_C"]


def _dot_scorer():
    w = np.stack([np.linspace(-1, 1, 64), np.cos(np.arange(64)), np.ones(64) / 64.0]).T.astype(np.float64)

    def predict(x: np.ndarray) -> np.ndarray:
        return np.asarray(x, dtype=np.float64) @ w
    return predict


def _weights_sql(i: int) -> str:
    if i == 0:
        vals = [-1 + 2 * k / 63 for k in range(64)]
    elif i == 1:
        vals = [float(np.cos(k)) for k in range(64)]
    else:
        vals = [1 / 64.0] * 64
    return "[" + ", ".join(repr(float(v)) for v in vals) + "]::DOUBLE[]"


SCORE_SQL = "WITH s AS (SELECT vec_id, " + ", ".join(
    f"list_dot_product(CAST(embedding AS DOUBLE[]), {_weights_sql(i)}) AS t{i}" for i in range(3)) + " FROM embeddings)"


@register("score_batch", SCORE_SQL + " SELECT vec_id, CAST(k AS INTEGER) AS task_id, round(v, 6) AS predicted_outcome FROM (SELECT vec_id, 0 AS k, t0 AS v FROM s UNION ALL SELECT vec_id, 1, t1 FROM s UNION ALL SELECT vec_id, 2, t2 FROM s)")
def q_score(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scored = models.score_batch(e, _dot_scorer, "x", 3, width=64, batch_size=4, out="pred")
    long = models.long_predictions(scored, "pred", ["vec_id"], "task_id")
    return long.select("vec_id", F.col("task_id").cast("int").alias("task_id"), r6("predicted_outcome").alias("predicted_outcome"))


@register("prediction_table", SCORE_SQL + """, n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings),
r AS (SELECT v.vec_id, (l_linenumber % 3)::INT AS task_id, l_orderkey * 8 + l_linenumber AS row_id, l_discount AS outcome, l_tax AS weight, l_returnflag AS clade
  FROM lineitem, n JOIN v ON l_orderkey % n.n = v.at),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY vec_id, task_id ORDER BY row_id DESC, outcome DESC, weight DESC, clade DESC) = 1)
SELECT vec_id, task_id, row_id, round(outcome, 6) AS outcome, clade, round([t0, t1, t2][task_id + 1], 6) AS predicted_outcome
FROM last JOIN s USING (vec_id)""")
def q_prediction_table(spark, d):
    """Labelled cells of scored sequences with the columns of their rows."""
    e = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    numbered = with_global_ordinal(e.select("vec_id"), ["vec_id"], "at")
    li = S.table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") % F.lit(e.count()))
    rows = li.join(numbered, "at").select("vec_id", (F.col("l_linenumber") % 3).cast("int").alias("task_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
                                          F.col("l_discount").alias("outcome"), F.col("l_tax").alias("weight"), F.col("l_returnflag").alias("clade"))
    vectors = features.task_vectors(rows, "vec_id", carry=["clade"]).join(e, "vec_id")
    out = TR.prediction_table(vectors, _dot_scorer, "x", 3, 64, keep=["vec_id"])
    return out.select("vec_id", "task_id", "row_id", r6("outcome").alias("outcome"), "clade", r6("predicted_outcome").alias("predicted_outcome"))


@register("prediction_report", SCORE_SQL + """ SELECT CAST(vec_id AS VARCHAR) AS name, round((t0 + t1) / 2, 6) AS mean_fitness,
  round(t0, 6) AS fitness_A, round(t1, 6) AS fitness_B, round(t2, 6) AS dms_C FROM s""")
def q_report(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("name", F.col("vec_id").cast("string"))
    scored = models.score_batch(e, _dot_scorer, "x", 3, width=64, batch_size=4, out="pred")
    rep = R.prediction_report(scored, SCORE_TASKS, ["fitness_A", "fitness_B"], pred="pred")
    return rep.select("name", *[r6(c).alias(c) for c in ["mean_fitness", *SCORE_TASKS]])


EVAL_SQL = SPEARMAN_SQL.replace("FROM lineitem)", ", l_discount, l_tax FROM lineitem)") + """
SELECT l_returnflag, count(*) AS n, round(corr(l_discount, l_tax), 6) AS pearson, round(corr(ra, rb), 6) AS spearman,
  round(1 - sum((l_discount - l_tax) ^ 2) / (var_pop(l_discount) * count(*)), 6) AS r2,
  round(regr_slope(l_tax, l_discount), 6) AS slope, round(regr_intercept(l_tax, l_discount), 6) AS intercept FROM r GROUP BY l_returnflag"""


@register("evaluate_predictions", EVAL_SQL)
def q_evaluate(spark, d):
    from lineax.operators.metrics import evaluate_predictions
    ev = evaluate_predictions(S.table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return ev.select("l_returnflag", "n", *[r6(c).alias(c) for c in ["pearson", "spearman", "r2", "slope", "intercept"]])


# ------------------------------------------------------------ 2.9 growth and 2.10 plans
@register("lineage_growth", S1 + hap_sql() + """,
rows AS (SELECT DISTINCT s.seq_name, s.country, s.collection_date, h.hap_id FROM samples s
  JOIN (SELECT DISTINCT seq_name, hap_id FROM hap) h ON s.seq_name = h.seq_name WHERE s.collection_date IS NOT NULL),
lo AS (SELECT min(collection_date) AS first_day FROM rows)
SELECT country, hap_id, count(*) AS n, CAST(sum(date_diff('day', first_day, collection_date) + 1) AS BIGINT) AS day_sum
FROM rows, lo GROUP BY country, hap_id HAVING count(*) >= 20""")
def q_growth(spark, d):
    """Expected rows and day sums of every haplotype at the fit; a maximum-likelihood fit has the observed ones."""
    st = _stage(spark, d)
    table, design, coefs = H.growth_table(st)
    classes = design.select("country", "hap_id", "class_idx").distinct()
    moments = G.expected_moments(design, coefs, st.max_bin).join(classes, ["country", "class_idx"])
    day_sum = F.round(F.col("nx") * F.lit(float(st.max_bin))).cast("long")
    return moments.select("country", "hap_id", F.round("n").cast("long").alias("n"), day_sum.alias("day_sum"))


@register("surveillance_samples", "WITH " + CR + """,
h AS (SELECT o.o_orderkey, cr.c_custkey, cr.c_name, cr.n_name, 'v/' || cr.n_name || '/' || cr.c_name || '/' || year(o_orderdate)::VARCHAR AS head,
  strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d, o_orderstatus AS pango, o_orderpriority AS clade FROM orders o JOIN cr ON o.o_custkey = cr.c_custkey),
calls AS (SELECT o_orderkey, n_name, c_name, d, pango, clade, CASE pango WHEN 'F' THEN head || '|' || d || '|' || d WHEN 'O' THEN head || '|' || substr(d, 1, 7) ELSE 'v/' || n_name || '/' || c_name END AS seq_name FROM h),
good AS (SELECT * FROM (SELECT *, length(seq_name) - length(replace(seq_name, '1', '')) AS ones FROM calls) WHERE ones < 8 AND ones % 4 <> 1),
one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY seq_name ORDER BY o_orderkey) = 1),
dated AS (SELECT one.*, CASE WHEN n_name IN ('NATION_3', 'NATION_14') THEN 'UK' ELSE n_name END AS country FROM one JOIN customer c ON one.c_name = c.c_name
  WHERE pango = 'F' AND d <= '1998-06-30' AND c.c_custkey % 5 <> 0),
big AS (SELECT country FROM dated GROUP BY country HAVING count(*) > 60)
SELECT seq_name, o_orderkey AS sample_id, country, c_name AS name, d AS collection_date, clade, pango FROM dated WHERE country IN (SELECT country FROM big)""")
def q_surveillance_samples(spark, d):
    """From written files to samples."""
    heads = S.header_strings(spark, d)
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("clade"), F.col("o_orderstatus").alias("pango"))
    calls, quality, records = (scratch_path(spark, x) for x in ("calls", "quality", "records"))
    TX.write_tsv(heads.join(orders, "sample_id").select("sample_id", F.col("header").alias("seqName"), "clade", "pango"), calls)
    ones = F.length("name") - F.length(F.replace("name", F.lit("1"), F.lit("")))
    TX.write_tsv(heads.select(F.col("header").alias("name")).distinct().select("name", F.lit(1000).alias("length"), (ones * 1.25).alias("count_n"), F.when(ones % 4 == 1, 2).otherwise(1).alias("count_stop")), quality)
    TX.write_csv(S.table(spark, d, "customer").select(F.concat_ws("/", F.lit("v"), F.lit("any"), "c_name", F.lit("1996")).alias("virus_name"), F.when(F.col("c_custkey") % 5 == 0, "Mink").otherwise("Human").alias("host")), records)
    out = SM.surveillance_samples(TX.read_tsv(spark, calls, "sample_id bigint, seqName string, clade string, pango string"), TX.read_tsv(spark, quality, "name string, length double, count_n double, count_stop int"),
                                  TX.read_csv(spark, records, "virus_name string, host string"), "1998-06-30", virus="v", min_country=60, nations=["NATION_3", "NATION_14"])
    return out.select(F.col("seqName").alias("seq_name"), "sample_id", "country", "name", ds("collection_date").alias("collection_date"), "clade", "pango")


@register("build_haplotypes", S1 + hap_sql() + " SELECT seq_name, haplotype, hap_id, country FROM hap")
def q_build_haps(spark, d):
    s, m = _s1(spark, d)
    return H.build_haplotypes(s, m, 100, 20).select("seq_name", "haplotype", "hap_id", "country")


ALLHAP_SQL = """,
a1 AS (SELECT DISTINCT s.seq_name, m.mut FROM (SELECT DISTINCT seq_name FROM {of}) s LEFT JOIN (SELECT * FROM muts WHERE contains(mut, 'S:')) m
  ON m.seq_name = s.seq_name),
a0 AS (SELECT seq_name, coalesce(string_agg(DISTINCT mut, ', ' ORDER BY mut), 'NA') AS haplotype_all FROM a1 GROUP BY seq_name),
allhap AS (SELECT a0.*, 'hap_all_' || CAST(dense_rank() OVER (ORDER BY haplotype_all) AS VARCHAR) AS hap_all_id FROM a0)"""


@register("build_all_mutation_haplotypes", S1 + ALLHAP_SQL.format(of="samples") + " SELECT seq_name, haplotype_all, hap_all_id FROM allhap")
def q_all_haps(spark, d):
    s, m = _s1(spark, d)
    return H.build_all_mutation_haplotypes(s, m)


REP_SQL = S1 + hap_sql() + ALLHAP_SQL.format(of="hap") + """,
rows AS (SELECT s.*, h.hap_id, a.hap_all_id FROM samples s JOIN (SELECT DISTINCT seq_name, hap_id FROM hap) h USING (seq_name)
  JOIN allhap a USING (seq_name)),
pc AS (SELECT hap_id, hap_all_id, count(*) AS n FROM rows GROUP BY hap_id, hap_all_id),
major AS (SELECT hap_id, hap_all_id, n FROM (SELECT *, row_number() OVER (PARTITION BY hap_id ORDER BY n DESC, hap_all_id) AS rn FROM pc) WHERE rn = 1),
firsts AS (SELECT hap_id, quantile_disc(collection_date, 0.01) AS date_first FROM rows GROUP BY hap_id)"""


def _all_haplotypes(spark, d, st):
    """Each sample's full haplotype by id, written once for all that look it up."""
    allh = H.build_all_mutation_haplotypes(st.rows, S.mutations(spark, d), per_sample=st.mutations)
    return materialize(allh.select("seq_name", "hap_all_id"), "full_haplotypes")


@register("representative_table", REP_SQL + """ SELECT h.hap_id, h.haplotype, CAST(f.date_first AS VARCHAR) AS date_first, major.n AS n_major, true AS rep_ok
  FROM (SELECT DISTINCT hap_id, haplotype FROM hap) h JOIN major USING (hap_id) JOIN firsts f USING (hap_id)""")
def q_representative(spark, d):
    st = _stage(spark, d)
    allh = _all_haplotypes(spark, d, st)
    coef = st.rows.select("hap_id").distinct().select("hap_id", F.lit(1.0).alias("relative_re"), F.lit("ALL").alias("country"), F.lit(True).alias("converged"))
    rep = H.representative_table(st, allh, coef)
    rows = st.rows.join(allh.select("seq_name", "hap_all_id"), "seq_name")
    pc = rows.groupBy("hap_id", "hap_all_id").agg(F.count(F.lit(1)).alias("n"))
    major = windows.top_one_per_group(pc, "hap_id", "n", "hap_all_id")
    member = rep.join(rows.select("seq_name", "hap_id", "hap_all_id"), ["seq_name", "hap_id"]).join(major, ["hap_id", "hap_all_id"])
    return member.select("hap_id", "haplotype", ds("date_first").alias("date_first"), F.col("n").alias("n_major"),
                         F.lit(True).alias("rep_ok"))


HAPCOUNT_SQL = S1 + hap_sql() + """,
hc AS (SELECT hap_id, country, count(*) AS count_hap FROM hap GROUP BY hap_id, country),
ct AS (SELECT country, count(*) AS n_country FROM hap GROUP BY country)"""


@register("fitness_over_time", HAPCOUNT_SQL + """ SELECT hc.hap_id, hc.country, round(ln(CAST(count_hap AS DOUBLE) / n_country), 6) AS log_relative_re,
  round(log10(count_hap), 6) AS log10_count, count_hap FROM hc JOIN ct USING (country)""")
def q_fitness_time(spark, d):
    s, m = _s1(spark, d)
    hap = H.build_haplotypes(s, m, 100, 20)
    hc = hap.groupBy("hap_id", "country").agg(F.count(F.lit(1)).alias("count_hap"))
    ct = hap.groupBy("country").agg(F.count(F.lit(1)).alias("n_country"))
    fit = hc.join(ct, "country").select("hap_id", "country", (F.col("count_hap") / F.col("n_country")).alias("relative_re"))
    out = R.fitness_over_time(fit, hc)
    return out.select("hap_id", "country", r6("log_relative_re").alias("log_relative_re"), r6("log10_count").alias("log10_count"), "count_hap")


@register("mutation_profile", S1 + hap_sql() + """,
rep AS (SELECT hap_id, min(haplotype) AS haplotype FROM hap GROUP BY hap_id),
ex AS (SELECT hap_id, unnest(string_split(haplotype, ', ')) AS mut FROM rep)
SELECT TRY_CAST(nullif(regexp_replace(mut, '[^0-9]', '', 'g'), '') AS INTEGER) AS pos, count(*) AS count_hap,
  round(log10(count(*)), 6) AS log10_count FROM ex GROUP BY 1""")
def q_mut_profile(spark, d):
    st = _stage(spark, d)
    rep = st.haplotypes.select("hap_id", "haplotype").distinct()
    rep = rep.join(st.rows.groupBy("hap_id").agg(F.min("clade").alias("clade")), "hap_id")
    first = aggs.first_seen_quantile(st.rows, "hap_id", "collection_date", 0.01, "date_first")
    long, per_pos = R.mutation_profile(rep, R.order_haplotypes(first))
    return per_pos.select("pos", "count_hap", r6("log10_count").alias("log10_count"))


PRESENCE_CLADES_S1 = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-ABSENT"]


@register("clade_presence_matrix", "WITH " + SAMPLES + """,
f AS (SELECT clade, date_trunc('month', min(collection_date)) AS fm FROM samples GROUP BY clade),
g AS (SELECT c.clade, CAST(m.generate_series AS DATE) AS month FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('9-ABSENT')) c(clade),
  generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-09-01', INTERVAL 1 MONTH) m)
SELECT g.clade, strftime(g.month, '%Y-%m') AS month, CASE WHEN g.month > f.fm THEN 1 ELSE 0 END AS value FROM g LEFT JOIN f ON g.clade = f.clade""")
def q_presence(spark, d):
    s = S.samples(spark, d).select(F.col("seq_name").alias("hap_id"), "clade", F.col("collection_date").alias("date_first"))
    return R.clade_presence_matrix(s, PRESENCE_CLADES_S1, GRID_MONTHS)


@register("drop_before_cutoff", "WITH " + SAMPLES + f""" SELECT s.seq_name, x.clade2 AS clade FROM (SELECT *, CASE WHEN pango IS NULL THEN NULL
  WHEN regexp_matches(pango, '^P') THEN 'BA.2.86' ELSE clade END AS clade2 FROM samples) x
  JOIN samples s ON s.seq_name = x.seq_name LEFT JOIN {CUTOFF_SQL} ON x.clade2 = cut.clade
  WHERE x.collection_date >= cut.cutoff OR cut.cutoff IS NULL""")
def q_drop_before(spark, d):
    s = S.samples(spark, d).withColumnRenamed("collection_date", "date_first")
    cut = _cutoffs(spark)
    out = R.drop_before_cutoff(s, cut, ["^P"], "BA.2.86")
    return out.select("seq_name", "clade")


@register("clade_counts", "WITH " + SAMPLES + " SELECT clade, count(*) AS n FROM samples WHERE clade IS NOT NULL GROUP BY clade")
def q_clade_counts(spark, d):
    return R.clade_counts(S.samples(spark, d))


@register("adaptation_corpus", "WITH " + FIT + """
SELECT 'train' AS corpus, md5(text) AS seq_md5 FROM documents UNION ALL SELECT 'train', md5(text) FROM benchmark
UNION ALL SELECT 'recent', md5(seq) FROM fit WHERE date_first >= DATE '2000-01-01'
UNION ALL SELECT 'test', md5(text) FROM conversations""")
def q_adaptation(spark, d):
    fam = S.documents(spark, d).select(F.col("text").alias("seq"))
    vir = S.table(spark, d, "benchmark").select(F.col("text").alias("seq"))
    ev = S.table(spark, d, "conversations").select(F.col("text").alias("seq"))
    dated = S.fitness_rows(spark, d).select("seq", "date_first")
    out = R.adaptation_corpus(fam, vir, ev, dated, "2000-01-01")
    return out.select("corpus", F.md5("seq").alias("seq_md5"))


@register("fitness_table")
def q_fitness_table(spark, d):
    """The flagship: ranked relative_Re per haplotype and country with its representative."""
    return fitness_table(spark, d)


@register("fitness_table_facts", REP_SQL + """,
per AS (SELECT country, hap_id, count(*) AS n FROM rows WHERE clade = '1-URGENT' AND collection_date IS NOT NULL GROUP BY country, hap_id),
st AS (SELECT hap_id, min(n) AS count_min, count(*) AS nc FROM per GROUP BY hap_id),
ref AS (SELECT hap_id FROM st WHERE nc = (SELECT count(DISTINCT country) FROM rows WHERE clade = '1-URGENT') ORDER BY count_min DESC, hap_id LIMIT 1),
tot AS (SELECT country, hap_id FROM rows WHERE collection_date IS NOT NULL GROUP BY country, hap_id HAVING count(*) >= 20)
SELECT tot.country, tot.hap_id, h.haplotype, CAST(f.date_first AS VARCHAR) AS date_first, true AS converged, tot.hap_id = (SELECT hap_id FROM ref) AS is_reference, true AS rep_ok
FROM tot JOIN (SELECT DISTINCT hap_id, haplotype FROM hap) h USING (hap_id) JOIN firsts f USING (hap_id)""")
def q_fitness_facts(spark, d):
    """The flagship's rows in what SQL can tell: fitted haplotypes, their strings and first dates, the one with
    relative_re 1 in every country, and that the representative is a sample of the haplotype's commonest full one."""
    st = _stage(spark, d)
    table, _, _ = H.growth_table(st, min_total=20)
    allh = _all_haplotypes(spark, d, st)
    rep = H.representative_table(st, allh, table)
    rows = st.rows.join(allh.select("seq_name", "hap_all_id"), "seq_name")
    pc = rows.groupBy("hap_id", "hap_all_id").agg(F.count(F.lit(1)).alias("n"))
    major = windows.top_one_per_group(pc, "hap_id", "n", "hap_all_id").select("hap_id", "hap_all_id")
    member = rows.join(major, ["hap_id", "hap_all_id"]).select("hap_id", "seq_name").distinct().withColumn("ok", F.lit(True))
    out = rep.join(member, ["hap_id", "seq_name"], "left")
    return out.select("country", "hap_id", "haplotype", ds("date_first").alias("date_first"), "converged", (F.col("relative_re") == 1.0).alias("is_reference"), F.coalesce("ok", F.lit(False)).alias("rep_ok"))


def fitness_table(spark: SparkSession, d: str) -> DataFrame:
    st = _stage(spark, d)
    table, _, _ = H.growth_table(st, min_total=20)
    allh = _all_haplotypes(spark, d, st)
    rep = H.representative_table(st, allh, table)
    return rep.withColumn("date_first", ds("date_first"))


@register("chunked_task_vectors", """WITH r AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber),
u AS (SELECT l_orderkey, count(*) AS m FROM r GROUP BY l_orderkey)
SELECT l_orderkey AS seq_id, CAST(c.range AS INTEGER) AS chunk, CAST(least(3, m - c.range * 3) AS INTEGER) AS n_labels
FROM u, range(0, 1000) c WHERE c.range * 3 < m""")
def q_chunked_vectors(spark, d):
    li = with_global_ordinal(S.table(spark, d, "lineitem"), LI_COLS + ["l_orderkey", "l_linenumber"], "row_id")
    cells = li.select(F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("task_id"),
                      F.col("l_discount").alias("outcome"), F.col("l_tax").alias("weight"), "row_id")
    v = TR.chunked_task_vectors(cells, n=3, seed=13)
    return v.select("seq_id", "chunk", F.size("labels").alias("n_labels"))


@register("growth_summary", S1 + hap_sql() + """,
rows AS (SELECT DISTINCT s.seq_name, s.country, s.clade, h.hap_id FROM samples s
  JOIN (SELECT DISTINCT seq_name, hap_id FROM hap) h ON s.seq_name = h.seq_name WHERE s.collection_date IS NOT NULL),
per AS (SELECT country, hap_id, count(*) AS n FROM rows WHERE clade = '1-URGENT' GROUP BY country, hap_id),
st AS (SELECT hap_id, min(n) AS count_min, count(*) AS nc FROM per GROUP BY hap_id),
ref AS (SELECT hap_id FROM st WHERE nc = (SELECT count(DISTINCT country) FROM rows WHERE clade = '1-URGENT')
  ORDER BY count_min DESC, hap_id LIMIT 1),
tot AS (SELECT country, hap_id FROM rows GROUP BY country, hap_id HAVING count(*) >= 20),
ok AS (SELECT country FROM tot WHERE hap_id IN (SELECT hap_id FROM ref))
SELECT country, count(*) AS n_haplotypes, CAST(1 AS BIGINT) AS n_reference, true AS all_converged
FROM tot WHERE country IN (SELECT country FROM ok) GROUP BY country""")
def q_growth_summary(spark, d):
    """Structure of the fitted table per country: fitted haplotypes, one reference, convergence."""
    st = _stage(spark, d)
    table, _, _ = H.growth_table(st, min_total=20)
    return table.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_haplotypes"),
        F.sum((F.col("relative_re") == 1.0).cast("long")).alias("n_reference"),
        F.min("converged").alias("all_converged"))
