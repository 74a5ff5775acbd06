"""Window-style operators (#64–72).

Per-group statistics are aggregated once and joined back (Spark sizes the
join at runtime), instead of ``Window.partitionBy(group)`` frames that hold a
hot group in one task.  Row numbering uses the distributed ordinal in
``ordinal.py``; randomness is hash-keyed so re-partitioning never changes a
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineax.functions.columns import clip01_col
from lineax.operators.aggs import exact_quantile
from lineax.operators.joins import heavy_keys, lookup_join
from lineax.operators.ordinal import with_global_ordinal, with_group_ordinal


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _ratio_like_numpy(num: Column, den: Column) -> Column:
    """num/den where x/0 follows IEEE (then clipped): >0 -> +inf -> 1, 0 -> NaN -> NULL."""
    return (F.when(den != 0, num / den)
            .when(num > 0, F.lit(float("inf")))
            .when(num < 0, F.lit(float("-inf"))))


# 64
def scale_within_group(df: DataFrame, group: str, x: str, q: float = 0.95, out: str = "outcome",
                       clip: bool = True) -> DataFrame:
    """(x - min) / (p_q - min) per group, clipped to [0, 1]; a constant group gives NULL.

    Rows meet their group once: one shuffle and sort by group gives a group's
    least value, its quantile and its rows.  Groups with a large share of the rows,
    found first, get their two numbers from aggregates and a distributed sort,
    and a join; so do rows without a group, whose result is NULL.
    ``df`` is read three times and should be a written table or little work on one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = heavy_keys(df, [group], max(1e-3, 0.5 / parts))
    apart = F.col(group).isNull()
    if hot:
        apart = apart | F.xxhash64(group).isin(hot)
    return _scaled(_with_group_range(df.where(~apart), group, x, q), x, out, clip).unionByName(
        _scaled(_with_hot_range(df.where(apart), group, x, q) if hot else
                df.where(apart).withColumns({c: F.lit(None).cast("double") for c in ("__lo", "__hi")}), x, out, clip))


def _scaled(df: DataFrame, x: str, out: str, clip: bool) -> DataFrame:
    val = _ratio_like_numpy(F.col(x) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return df.withColumn(out, clip01_col(val) if clip else val).drop("__lo", "__hi")


def _with_hot_range(df: DataFrame, group: str, x: str, q: float) -> DataFrame:
    """``df`` with each group's minimum and quantile of ``x``, for groups of any size."""
    lo = df.groupBy(group).agg(F.min(x).alias("__lo"))
    hi = exact_quantile(df, x, q, [group], "__hi")
    return df.join(lo.join(hi, group, "left"), group, "left")


def _with_group_range(df: DataFrame, group: str, x: str, q: float) -> DataFrame:
    """The same for groups that fit into a task (non-null, their rows may be spilled): linear interpolation between the values at the neighbouring ranks."""
    rows, ranks = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.col("__x").asc_nulls_last())
    df = df.withColumn("__x", F.col(x).cast("double"))
    df = df.withColumns({"__i": F.row_number().over(ranks) - 1, "__n": F.count("__x").over(rows)})
    pos = F.lit(q) * (F.col("__n") - 1)
    lo, hi = (F.max(F.when(F.col("__i") == at, F.col("__x"))).over(rows) for at in (F.floor(pos), F.ceil(pos)))
    df = df.withColumns({"__lo": F.min(x).over(rows), "__hi": lo + (pos - F.floor(pos)) * (hi - lo)})
    return df.drop("__x", "__i", "__n")


# 65
def quantile_normalise(df: DataFrame, x: str, lo: float = 0.001, hi: float = 0.999, out: str | None = None) -> DataFrame:
    """(x - q_lo) / (q_hi - q_lo) with global interpolated quantiles; not clipped.

    The quantiles come from the sort-based ``exact_quantile`` and enter the
    projection as one scalar subquery (no join).
    """
    qs = exact_quantile(df, x, [lo, hi], (), "q").scalar()
    qlo, qhi = F.element_at(qs, 1), F.element_at(qs, 2)
    return df.withColumn(out or f"{x}_norm", F.try_divide(F.col(x) - qlo, qhi - qlo))


# 66
def top_one_per_group(df: DataFrame, group: str | Sequence[str], count: str, tie: str) -> DataFrame:
    """Row with the largest ``count`` per group (ties -> smallest ``tie``): a partial aggregate."""
    keys = _cols(group)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct((-F.col(count)).alias("_o1"), F.col(tie).alias("_o2"), F.struct(*rest).alias("r"))
    out = df.groupBy(*keys).agg(F.min(packed).alias("_k"))
    return out.select(*keys, *[F.col(f"_k.r.{c}").alias(c) for c in rest])


# 67
def sample_one_per_group(df: DataFrame, group: str | Sequence[str], id_col: str, seed: int = 42) -> DataFrame:
    """One row per group chosen by a seeded hash of its id (uniform, reproducible, skew-safe)."""
    keys = _cols(group)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"), F.col(id_col).alias("_id"),
                      F.struct(*rest).alias("r"))
    out = df.groupBy(*keys).agg(F.min(packed).alias("_k"))
    return out.select(*keys, *[F.col(f"_k.r.{c}").alias(c) for c in rest])


# 68
def dense_ids(df: DataFrame, col: str, out: str = "id", base: int = 0, prefix: str | None = None) -> DataFrame:
    """Dense codes of ``col`` in sorted (code-point) order; NULL keeps a NULL code.

    Distinct values are ranked by a distributed sort (no single-partition
    window) and joined back.  ``prefix`` makes string ids such as ``hap_1``.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = with_global_ordinal(values, [col], "__o")
    code = F.col("__o") + F.lit(base)
    code = F.concat(F.lit(prefix), code.cast("string")) if prefix is not None else code
    ranked = ranked.select(col, code.alias(out))
    return lookup_join(df, ranked, [col], "left")


# 69
def shuffle_and_number(df: DataFrame, key: Sequence[str], seed: int = 13, out: str = "row_id", written: bool = False,
                       keep: Sequence[str] | None = None, halvings: int = 0) -> DataFrame:
    """A seeded permutation numbered 0..n-1: rows ordered by xxhash64(key, seed), ties by key.
    ``written`` and ``keep`` as in ``with_global_ordinal``; the hashes' range is halved ``halvings``
    times, and each stretch of it is shuffled and sorted by itself."""
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    half = 1 << halvings >> 1
    stretches = [F.shiftright(h, 64 - halvings) == i for i in range(-half, half)] if halvings else None
    return with_global_ordinal(df, [h, *[F.col(k) for k in key]], out, written=written, keep=keep, stretches=stretches)


# 70
def stratified_folds(df: DataFrame, cls: str, key: Sequence[str], k: int = 5, seed: int = 13,
                     out: str = "fold") -> DataFrame:
    """Round-robin fold per class in a seeded order.

    With rows ordered by (class, hash), ``(class offset + rank in class) % k``
    is just the global position ``% k``; per-class fold sizes then differ by at
    most one and class remainders continue where the previous class stopped.
    """
    h = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    pos = with_global_ordinal(df, [F.col(cls).asc_nulls_first(), h, *[F.col(c) for c in key]], "__pos")
    return pos.withColumn(out, (F.col("__pos") % F.lit(k)).cast("int")).drop("__pos")


def fold_split(df: DataFrame, fold_id: int, cls: str, key: Sequence[str], k: int = 5, inner_k: int = 4,
               seed: int = 13, out: str = "split", written: bool = False) -> DataFrame:
    """train/val/test labels: test = fold ``fold_id``; the rest re-split in ``inner_k``, first = val.

    ``key`` must identify a row.  Folds are computed on the narrow (class, key)
    projection and joined back once, so wide rows are shuffled a single time.
    ``written`` as in ``with_global_ordinal``.
    """
    if not 0 <= fold_id < k:
        raise ValueError(f"fold_id should be between 0 and {k - 1}")
    narrow = df.select(cls, *key)
    h = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    rows = with_global_ordinal(narrow, [F.col(cls).asc_nulls_first(), h, *[F.col(c) for c in key]], "__pos", written=written)
    pos = F.col("__pos")
    # A row's position among the rest: its own less the test rows before it, so one sort serves both splits.
    rest = pos - F.floor((pos + F.lit(k - 1 - fold_id)) / F.lit(k))
    split = F.when(pos % k == fold_id, F.lit("test")).when(rest % inner_k == 0, F.lit("val")).otherwise(F.lit("train"))
    labels = rows.select(*key, split.alias(out))
    return df.join(labels, list(key), "inner")


# 71
def task_chunks(df: DataFrame, seq_id: str, task_id: str, n: int = 10, seed: int = 13, out: str = "chunk") -> DataFrame:
    """Split each sequence's labels into disjoint chunks of at most ``n`` (last one short).

    The in-sequence order is a seeded hash; positions come from the distributed
    ordinal, so even a sequence holding a large share of the labels is numbered
    by many tasks.
    """
    h = F.xxhash64(F.col(seq_id), F.col(task_id), F.lit(seed))
    ranked = with_group_ordinal(df, [seq_id], [h, F.col(task_id)], "__k")
    return ranked.withColumn(out, F.floor(F.col("__k") / F.lit(n)).cast("int")).drop("__k")


# 72
def order_categories_by_date(df: DataFrame, key: str, date: str, out: str = "axis_order") -> DataFrame:
    """1-based axis position of each category by (date, key)."""
    return with_global_ordinal(df, [F.col(date).asc_nulls_last(), F.col(key)], out).withColumn(out, F.col(out) + 1)
