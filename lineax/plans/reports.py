"""Report tables (#93–96, #100–102): the data behind the reference's charts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.functions import columns as C
from lineax.operators import aggs, filters, joins, setops, windows
from lineax.operators.features import explode_haplotype

# The clade and month axes of the presence chart.
PRESENCE_CLADES = ["21K", "21L", "22C", "22A", "22B", "22D", "22E", "22F", "23C", "23A", "23F", "BA.2.86"]
PRESENCE_MONTHS = [f"{y}-{m:02d}-01" for y, m in [(2022, i) for i in range(1, 13)] + [(2023, i) for i in range(1, 10)]]
BA286_PATTERNS = [r"BA\.2\.86", r"JN\."]


# 93
def fitness_over_time(fitness: DataFrame, hap_counts: DataFrame) -> DataFrame:
    """Fitness rows with their per-(haplotype, country) sample count and log scales."""
    j = fitness.join(hap_counts, ["hap_id", "country"], "inner")
    j = C.log_transform(j, "relative_re", "log_relative_re")
    return C.log_transform(j, "count_hap", "log10_count", base=10)


# 94
def mutation_profile(rep: DataFrame, order: DataFrame):
    """(long table hap × mutation with position and axis order, per-position counts with log10)."""
    long = explode_haplotype(rep.select("hap_id", "haplotype"), "haplotype", "mut")
    long = C.mutation_position(long, "mut", "pos")
    long = long.join(rep.select("hap_id", "clade").distinct(), "hap_id", "inner")
    long = long.join(order, "hap_id", "inner")
    per_pos = aggs.positions_mutated(long, "pos", "count_hap")
    return long, C.log_transform(per_pos, "count_hap", "log10_count", base=10)


# 95
def clade_presence_matrix(fitness: DataFrame, clades: Sequence[str] = PRESENCE_CLADES,
                          months: Sequence[str] = PRESENCE_MONTHS) -> DataFrame:
    """(clade, month, value): 1 iff the month is strictly after the clade's first month; an
    absent clade is 0 everywhere.
    """
    first = aggs.group_min_date(fitness.select("hap_id", "clade", "date_first").distinct(), "clade", "date_first")
    first = C.month_floor(first, "date_first", "first_month")
    grid = joins.cross_grid(fitness.sparkSession.createDataFrame([(c,) for c in clades], "clade string"),
                            "month", list(months), "date")
    j = joins.left_join(grid, first.select("clade", "first_month"), "clade")
    val = F.when(F.col("month") > F.col("first_month"), F.lit(1)).otherwise(F.lit(0))
    return j.select("clade", F.date_format("month", "yyyy-MM").alias("month"), val.alias("value"))


# 96
def drop_before_cutoff(table: DataFrame, cutoffs: DataFrame, patterns: Sequence[str] = BA286_PATTERNS,
                       new_clade: str = "BA.2.86") -> DataFrame:
    """Recode BA.2.86-like lineages by pattern, attach each clade's cutoff, drop rows first seen
    before it (clades without a cutoff stay).
    """
    t = C.recode_pattern(table, "pango", patterns, new_clade, "clade")
    t = joins.left_join(t, cutoffs, "clade")
    return filters.cutoff_or_null_filter(t, "date_first", "cutoff")


# 100
def prediction_report(scored: DataFrame, tasks: Sequence[str], country_tasks: Sequence[str],
                      name: str = "name", pred: str = "predicted") -> DataFrame:
    """Wide report, one row per scored row: name, mean_fitness (mean over the country tasks), one
    column per task.

    ``pred`` is the array of one value per task in the order of ``tasks``, so the
    report is a projection without a shuffle; rows of one name stay apart.
    NULL values don't count in the mean.
    """
    value = {t: F.get(pred, i) for i, t in enumerate(tasks)}
    known = F.filter(F.array(*[value[t].cast("double") for t in country_tasks]), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda total, v: total + v), F.size(known))
    return scored.select(name, mean.alias("mean_fitness"), *[value[t].alias(t) for t in tasks])


# 101
def clade_counts(df: DataFrame, clade: str = "clade") -> DataFrame:
    """Rows per clade, in clade order."""
    return df.where(F.col(clade).isNotNull()).groupBy(clade).agg(F.count(F.lit(1)).alias("n")).orderBy(clade)


# 102
def adaptation_corpus(family: DataFrame, virus: DataFrame, evaluation: DataFrame, dated: DataFrame,
                      cutoff: str = "2022-09-01") -> DataFrame:
    """(corpus, seq): train = family ∪ virus sequences, recent = dated rows on/after ``cutoff``,
    test = the evaluation corpus.  Duplicates are kept.
    """
    train = setops.union_all(family.select("seq"), virus.select("seq")).withColumn("corpus", F.lit("train"))
    _, future = filters.split_by_cutoff(dated, "date_first", cutoff)
    recent = future.select("seq").withColumn("corpus", F.lit("recent"))
    test = evaluation.select("seq").withColumn("corpus", F.lit("test"))
    return setops.union_all(train, recent, test).select("corpus", "seq")


def order_haplotypes(first: DataFrame) -> DataFrame:
    """(hap_id, axis_order) by first-seen date then id (#72)."""
    return windows.order_categories_by_date(first.select("hap_id", "date_first"), "hap_id", "date_first")
