"""FASTA as a splittable text scan.

Records are cut at ``\\n>`` by the text source itself, so a multi-GB FASTA is
read by many tasks in parallel; no driver loop, no per-record Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineax.operators.ordinal import with_global_ordinal

HEADER_MODES = ("description", "id")
DUP_MODES = ("first", "last", "number", "all")


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(path)
    rec = F.regexp_replace(F.col("value"), r"^>", "")
    # A record's input position: file, split start, then read order inside the split.
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return raw.select(rec.alias("rec"), order.alias("_order")).where(F.regexp_replace("rec", r"\s+", "") != "")


def _parse(rec: Column, header: str) -> tuple[Column, Column]:
    # Strip all surrounding whitespace (including the \r of CRLF files), not only spaces.
    title = F.regexp_replace(F.regexp_extract(rec, r"^([^\n]*)", 1), r"^\s+|\s+$", "")
    name = title if header == "description" else F.regexp_extract(title, r"^(\S*)", 1)
    body = F.regexp_replace(rec, r"^[^\n]*", "")
    seq = F.regexp_replace(body, r"\s+", "")
    return name, seq


def read_fasta(
    spark: SparkSession,
    path: str | list[str],
    header: str = "description",
    dup: str = "first",
) -> DataFrame:
    """(name, seq) per FASTA record.

    header: ``description`` = the whole title line, ``id`` = its first word.
    dup: ``first`` / ``last`` keep one record per name by input order,
    ``number`` prefixes every name with its 0-based record index (``i_name``),
    ``all`` keeps every record.
    """
    if header not in HEADER_MODES or dup not in DUP_MODES:
        raise ValueError(f"header in {HEADER_MODES}, dup in {DUP_MODES}")
    recs = _records(spark, path)
    name, seq = _parse(F.col("rec"), header)
    parsed = recs.select(name.alias("name"), seq.alias("seq"), "_order")
    if dup == "all":
        return parsed.drop("_order")
    if dup == "number":
        numbered = with_global_ordinal(parsed, [F.col("_order")], "_i")
        return numbered.select(F.concat(F.col("_i").cast("string"), F.lit("_"), "name").alias("name"), "seq")
    pick = F.min if dup == "first" else F.max
    # Partial aggregation keeps a hot name from landing in one task whole.
    kept = parsed.groupBy("name").agg(pick(F.struct("_order", "seq")).alias("_k"))
    return kept.select("name", F.col("_k.seq").alias("seq"))
