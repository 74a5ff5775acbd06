"""Operator 1, mixing sources to target weights, with DataFrame functions only.

Sizes (words) are summed per source before anything is joined.  Targets share
``share`` times all sizes by weight; a target stops at ``most`` times its
source's size and what it leaves is shared anew among the others until none is
above: target = least(most * size, level * weight), where the level follows
from one-row aggregates of the source table.  A source's repetition rate is
target / size: each document is taken floor(rate) times, and once more if a
number drawn from the hash of (seed, id) is below the rest.

Only the table of sources (one row each) is joined to documents; a source with
a third of all rows is a group that partial sums reduce and a join key that
adaptive execution splits.

Defined results: a null source is a source of its own, ordered last; null or
empty texts have size 0 and are taken like others (0 words); a source without
words has target 0 and its documents rate 0; rows with one id draw alike;
other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.llm.common import WORD, unit_hash
from lineax.operators.ordinal import with_global_ordinal
from lineax.session import materialize


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows; ``weights`` repeat along the sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = with_global_ordinal(totals, [F.col("source").isNull(), F.col("source")], "rank", salt=False)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(ranked.select("source", "source_size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")), "sources")
    return table.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(_level(table, share, most)) * F.col("weight")))


def _level(table: DataFrame, share: float, most: float) -> float:
    """Words per unit of weight for sources below their limit; each step fixes sources that the last level put above."""
    level = 0.0
    while True:
        held = F.lit(float(most)) * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return level
        after = (share * (row["all"] or 0) - most * row["held"]) / row["open"]
        if after <= level:
            return level
        level = after


def _rated(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[float], share: float, most: float, seed: int, carry: list[Column]) -> DataFrame:
    rows = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = materialize(source_targets(rows, weights, share, most), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(unit_hash(F.col("_id"), salt=str(seed)) < rate - F.floor(rate), 1).otherwise(0)
    doc = docs.select(*carry, F.col(id_col).alias("_id"), F.col(source_col).alias("_of"))
    return doc.join(targets, F.col("_of").eqNullSafe(F.col("_source")), "left").withColumn("_copies", copies.cast("int"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 29) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of every row; texts are only counted."""
    rated = _rated(docs, id_col, source_col, text_col, weights, share, most, seed, [word_count(F.col(text_col)).alias("size")])
    return rated.select(F.col("_id").alias(id_col), F.col("_of").alias("source"), "size", "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 29) -> DataFrame:
    """Rows of ``docs``, each as often as it is taken."""
    rated = _rated(docs, id_col, source_col, text_col, weights, share, most, seed, [F.struct(*docs.columns).alias("_row")])
    return rated.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n")).select("_row.*")
