"""Projections and scalar functions (#6–25).

Each operator is ``DataFrame -> DataFrame`` built from JVM-side expressions
(whole-stage codegen, no Python per row).  Column names and thresholds are
arguments; defaults are the reference's values.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.functions.encoding import encode_residues, mask_residues

__all__ = [
    "count_char",
    "residue_counts",
    "gap_counts",
    "split_header",
    "parse_full_date",
    "recode_members",
    "recode_pattern",
    "day_index_and_bin",
    "month_floor",
    "month_label",
    "mutation_position",
    "apply_substitution",
    "log_transform",
    "potency_weighted_escape",
    "compose_key",
    "clip01",
    "clip01_col",
    "growth_to_re",
    "conditional_label",
    "tag_source",
    "rename_select",
    "encode_residues",
    "mask_residues",
]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_char(col: str | Column, ch: str) -> Column:
    """Occurrences of a literal substring, as int (no regex engine involved)."""
    c = _c(col)
    return ((F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))) / F.lit(len(ch))).cast("int")


# 6
def residue_counts(
    df: DataFrame, seq: str = "seq", unknown: str = "X", stop: str = "*",
    names: Sequence[str] = ("length", "count_n", "count_stop"),
) -> DataFrame:
    """length, count of the unknown residue (the letter X, named ``count_N`` upstream), count of stops."""
    return df.withColumns(
        {names[0]: F.length(seq), names[1]: count_char(seq, unknown), names[2]: count_char(seq, stop)}
    )


# 7
def gap_counts(df: DataFrame, seq: str = "seq", unknown: str = "X", gap: str = "-") -> DataFrame:
    return df.withColumns({"count_x": count_char(seq, unknown), "count_hyphen": count_char(seq, gap)})


# 8
def split_header(df: DataFrame, col: str, sep_regex: str, names: Sequence[str]) -> DataFrame:
    """Split into named pieces; missing pieces are NULL and extra pieces are dropped."""
    parts = F.split(F.col(col), sep_regex)
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(names)})


# 9
def parse_full_date(df: DataFrame, col: str, max_date: str | None = None, out: str | None = None) -> DataFrame:
    """Keep rows whose text is a full ``yyyy-MM-dd`` valid date (<= max_date if given).

    The length test comes first: a plain cast would read ``2021-03`` as March 1st.
    """
    out = out or col
    text = F.col(col)
    parsed = F.when(F.length(text) == 10, text.try_cast("date"))
    res = df.withColumn(out, parsed).where(F.col(out).isNotNull())
    if max_date is not None:
        res = res.where(F.col(out) <= F.lit(max_date).cast("date"))
    return res


# 10
def recode_members(df: DataFrame, col: str, members: Iterable[str], value: str,
                   key: str | None = None, out: str | None = None) -> DataFrame:
    """``value`` where ``key`` (default ``col``) is one of ``members``; a NULL key keeps the old value."""
    key_col = F.col(key or col)
    return df.withColumn(out or col, F.when(key_col.isin(list(members)), F.lit(value)).otherwise(F.col(col)))


# 11
def recode_pattern(df: DataFrame, key: str, patterns: Sequence[str], value: str, target: str,
                   out: str | None = None) -> DataFrame:
    """``value`` where ``key`` contains any regex in ``patterns``; a NULL key gives NULL."""
    k = F.col(key)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | k.rlike(p)
    return df.withColumn(out or target, F.when(k.isNull(), F.lit(None).cast("string"))
                         .when(hit, F.lit(value)).otherwise(F.col(target).cast("string")))


# 12
def day_index_and_bin(df: DataFrame, date: str, bin_size: int = 1,
                      day: str = "day_num", bin_col: str = "day_bin",
                      bounds: tuple | None = None) -> DataFrame:
    """Day number from the global first day (1-based) and right-closed ``bin_size``-day bin.

    First and last day are global (all groups).  They enter as one scalar
    subquery (a single small aggregation job, no join), or as ``bounds`` when
    the caller already has them.  Days past the last full bin get no bin and
    are dropped.
    """
    d = F.col(date).cast("date")
    if bounds is None:
        b = df.agg(F.struct(F.min(d).alias("lo"), F.max(d).alias("hi"))).scalar()
        first, last = b["lo"], b["hi"]
    else:
        first, last = F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date")
    day_num = F.datediff(d, first) + 1
    max_num = F.datediff(last, first) + 1
    covered = F.floor(max_num / F.lit(bin_size)) * F.lit(bin_size)
    b = F.when(day_num <= covered, F.ceil(day_num / F.lit(bin_size)).cast("int"))
    return df.withColumns({day: day_num, bin_col: b}).where(F.col(bin_col).isNotNull())


# 13
def month_floor(df: DataFrame, date: str, out: str = "month") -> DataFrame:
    return df.withColumn(out, F.trunc(F.col(date).cast("date"), "MM"))


def month_label(df: DataFrame, date: str, out: str = "month_label") -> DataFrame:
    return df.withColumn(out, F.date_format(F.col(date).cast("date"), "yyyy-MM"))


# 14
def mutation_position(df: DataFrame, mut: str = "mut", out: str = "pos") -> DataFrame:
    """All digits of the mutation label as an int; none (``NA``) gives NULL."""
    return df.withColumn(out, F.regexp_replace(F.col(mut), "[^0-9]", "").try_cast("int"))


# 15
def apply_substitution(df: DataFrame, seq: str = "seq", pos: str = "position", aa: str = "mutant",
                       out: str | None = None) -> DataFrame:
    """Replace the residue at 1-based ``pos`` (gap characters count); past the end appends."""
    return df.withColumn(out or seq, F.overlay(F.col(seq), F.col(aa), F.col(pos).cast("int"), F.lit(1)))


# 16
def log_transform(df: DataFrame, col: str, out: str, base: float | None = None, pseudo: float = 0.0) -> DataFrame:
    """log_base(x + pseudo); natural log when base is None.  Non-positive input gives NULL."""
    x = F.col(col) + F.lit(pseudo) if pseudo else F.col(col)
    val = F.ln(x) if base is None else (F.log10(x) if base == 10 else F.log(float(base), x))
    return df.withColumn(out, val)


# 17
def potency_weighted_escape(df: DataFrame, escape: str = "mut_escape", potency: str = "neg_log_ic50",
                            out: str = "mut_escape_w") -> DataFrame:
    return df.withColumn(out, F.col(escape) * F.col(potency))


# 18
def compose_key(df: DataFrame, parts: Sequence[str], sep: str, out: str) -> DataFrame:
    """Join parts with ``sep``; NULL if any part is NULL (like pandas string ``+``)."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.col(p).cast("string"))
    return df.withColumn(out, F.concat(*pieces))


# 19
def clip01_col(x: Column) -> Column:
    """Clip to [0, 1]; NULL and NaN stay NULL (least/greatest would skip NULL and send NaN to 1)."""
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clip01(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clip01_col(F.col(col)))


# 20
def growth_to_re(df: DataFrame, slope: str, max_day: str | Column | float, bin_size: float = 1.0,
                 gen_time: float = 2.1, out: str = "relative_re") -> DataFrame:
    """Relative effective reproduction number from a multinomial slope on the day/max_day scale."""
    m = F.col(max_day) if isinstance(max_day, str) else (max_day if isinstance(max_day, Column) else F.lit(max_day))
    return df.withColumn(out, F.exp(F.col(slope) / m / F.lit(bin_size) * F.lit(gen_time)))


# 21
def conditional_label(df: DataFrame, group: str = "major_group", date: str = "date_first",
                      thresh: str = "2024-10-07", out: str = "major_group2") -> DataFrame:
    """fitness rows on/after ``thresh`` -> fitness_recent, before -> fitness, others keep their group.

    A NULL date matches neither branch and keeps the group (``fitness``).
    """
    g = F.col(group)
    d = F.col(date).cast("date")
    t = F.lit(thresh).cast("date")
    return df.withColumn(out, F.when((g == "fitness") & (d >= t), F.lit("fitness_recent"))
                         .when((g == "fitness") & (d < t), F.lit("fitness")).otherwise(g))


# 22
def tag_source(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


# 23
def rename_select(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Rename ``old -> new`` and optionally keep only ``keep`` (new names) in that order."""
    out = df.withColumnsRenamed(dict(mapping))
    return out.select(*keep) if keep is not None else out
