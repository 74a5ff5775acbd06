"""Filters and predicates (#26–35).  All push down to the scan where the source allows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# 26
def keep_equal(df: DataFrame, col: str, value) -> DataFrame:
    """Rows equal to ``value``; NULL drops."""
    return df.where(F.col(col) == F.lit(value))


# 27
def exclude_members(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Drop rows whose value is listed; NULL rows are kept (SQL ``NOT IN`` would drop them)."""
    c = F.col(col)
    return df.where(c.isNull() | ~c.isin(list(values)))


# 28
def quality_filter(df: DataFrame, max_n_frac: float = 0.01, n_stop: int = 1, length: str = "length",
                   count_n: str = "count_n", count_stop: str = "count_stop") -> DataFrame:
    """Unknown-residue share strictly below ``max_n_frac`` and exactly ``n_stop`` stops."""
    frac = F.try_divide(F.col(count_n).cast("double"), F.col(length).cast("double"))
    return df.where((frac < F.lit(max_n_frac)) & (F.col(count_stop) == F.lit(n_stop)))


# 29
def gap_filter(df: DataFrame, max_x: int = 5, max_gap: int = 30) -> DataFrame:
    """Inclusive limits on X and gap counts."""
    return df.where((F.col("count_x") <= max_x) & (F.col("count_hyphen") <= max_gap))


_OPS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}


# 30
def threshold_filter(df: DataFrame, col: str, op: str, value) -> DataFrame:
    """Comparison filter; NULL and NaN never pass an ordering comparison."""
    c = F.col(col)
    cond = getattr(c, _OPS[op])(F.lit(value))
    if op in ("<", "<=", ">", ">="):
        cond = cond & ~F.isnan(c)
    return df.where(cond)


# 31
def keep_gene(df: DataFrame, mut: str = "mut", gene: str = "S:") -> DataFrame:
    """Substring match (not prefix), like ``grepl``."""
    return df.where(F.col(mut).contains(gene))


# 32
def keep_members(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose value is listed; NULL drops."""
    return df.where(F.col(col).isin(list(values)))


# 33
def split_by_cutoff(df: DataFrame, date: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(past, future): future is ``date >= cutoff``; past is ``date < cutoff`` or NULL date."""
    d = F.col(date).cast("date")
    c = F.lit(cutoff).cast("date")
    return df.where((d < c) | d.isNull()), df.where(d >= c)


# 34
def rows_with_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


# 35
def cutoff_or_null_filter(df: DataFrame, date: str = "date_first", cutoff: str = "cutoff") -> DataFrame:
    """Keep rows on/after their cutoff, or with no cutoff; a NULL date with a cutoff drops."""
    return df.where((F.col(date) >= F.col(cutoff)) | F.col(cutoff).isNull())
