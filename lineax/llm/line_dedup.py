"""Operator 2, line dedup by distinct-site spread.

A line that many sites carry is boilerplate (a licence line, a notice), however
often one site repeats it.  Lines are named by a hash of their trimmed text.
Each line's sites are counted with HyperLogLog sketches, which partial
aggregation builds in every task and merges after the shuffle, so a line on a
third of all documents is one small sketch per task.  Lines whose estimate is
within ``margin`` of the threshold get an exact distinct count; the rest are
decided by the sketch.

Cross-site lines are removed from every document they occur in, whatever their
share of it, with one exception: a document all of whose lines are cross-site
shares its whole text with others and stays whole; copies are the business of
near-duplicate operators, which keep one of them.

Only DataFrame functions; documents meet their removals in one join by a hash
of the row, and texts without removals are passed on as they are.

Defined results: a null source is a site of its own; null texts stay null and
texts without words are not touched; lines without words never count; repeated
rows are cleaned alike and kept; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.llm.common import WORD, free_name
from lineax.session import materialize

TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_rows(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(row, site, at, line, words) of every line; ``line`` and ``site`` are 64-bit hashes."""
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("none")))
    split = docs.select(_row(id_col, text_col).alias("row"), site.alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "raw"))
    return split.select("row", "site", "at", F.xxhash64(F.regexp_replace("raw", TRIM, "")).alias("line"), F.regexp_count(F.col("raw"), F.lit(WORD)).alias("words"))


def spread_lines(lines: DataFrame, min_sites: int, margin: float = 0.15, precision: int = 12) -> DataFrame:
    """(line, sites) of lines on at least ``min_sites`` sites; sites is exact near the threshold, else an estimate."""
    lines = lines.where("words > 0").select("line", "site")
    low, high = F.lit(min_sites * (1 - margin) - 1), F.lit(min_sites * (1 + margin) + 1)
    # most lines are on one site: only those that can matter are written
    about = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", precision)).alias("about"))
    about = materialize(about.where(F.col("about") >= low), "spread")
    exact = lines.join(about.where(F.col("about") <= high).select("line"), "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    sure = about.where(F.col("about") > high).select("line", F.col("about").alias("sites"))
    return exact.where(F.col("sites") >= min_sites).union(sure)


def removals(docs: DataFrame, id_col: str, site_col: str, text_col: str, min_sites: int) -> DataFrame:
    """(row, gone) per row that loses lines; gone: for each line, whether it goes."""
    lines = materialize(line_rows(docs, id_col, site_col, text_col), "lines")
    wide = materialize(spread_lines(lines, min_sites).select(F.col("line").alias("wide")), "boilerplate")
    marked = lines.join(wide, (F.col("line") == F.col("wide")) & (F.col("words") > 0), "left").select("row", "words", "at", F.col("wide").isNotNull().alias("goes"))
    # repeated rows have one hash: their lines count equally often, and the set holds each once
    per = marked.groupBy("row").agg(F.sum("words").alias("all"), F.sum(F.when(F.col("goes"), F.col("words")).otherwise(0)).alias("lost"), F.collect_set(F.struct("at", "goes")).alias("marks"))
    per = per.where((F.col("lost") > 0) & (F.col("lost") < F.col("all")))
    return per.select("row", F.transform(F.array_sort("marks"), lambda x: x["goes"]).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = 5, report: bool = False) -> DataFrame:
    """``docs`` with cross-site lines taken out of the text; ``report`` adds n_lines_removed (a column of that name is replaced)."""
    row, other, gone = (free_name(docs, c) for c in ("_row", "_other", "_gone"))
    found = materialize(removals(docs, id_col, site_col, text_col, min_sites), "removals").select(F.col("row").alias(other), F.col("gone").alias(gone)).hint("merge")  # the same plan at every size
    rows = docs.withColumn(row, _row(id_col, text_col)).join(found, F.col(row) == F.col(other), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.get(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if not (report and c == "n_lines_removed")]
    if report:
        out.append(F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).cast("long").alias("n_lines_removed"))
    return rows.select(*out)
