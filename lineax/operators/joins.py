"""Joins (#36–44).

Broadcast is left to Spark's size estimate and to AQE's runtime statistics
(which re-plans to a broadcast hash join only when the measured side is small);
nothing is force-broadcast unless its size is bounded by construction or was
measured.  Beyond that bound, ``skew_join`` deals keys that hold a large share of
the rows over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# 36
def inner_join_keep_multiplicity(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Plain inner join; duplicate keys on either side multiply rows (no semi-join rewrite)."""
    return a.join(b, on, "inner")


# 37
def left_join(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on, "left")


# 38
def right_join_keep_unmatched(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Every row of ``b``; unmatched ones get NULL for ``a``'s columns."""
    return a.join(b, on, "right")


# 39
def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL matches NULL (dplyr semantics); key columns appear once."""
    keys = {k: f"__r_{k}" for k in on}
    rb = b.withColumnsRenamed(keys)
    cond = [a[k].eqNullSafe(rb[r]) for k, r in keys.items()]
    out = a.join(rb, cond, how)
    if how in ("right", "full", "outer", "full_outer"):
        out = out.withColumns({k: F.coalesce(a[k], rb[r]) for k, r in keys.items()})
    return out.drop(*keys.values())


# 40
def semi_join(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``a`` with a match in ``b`` (``%in%``); never multiplies."""
    return a.join(b, on, "left_semi")


# 41
def attach_sequence(meta: DataFrame, fasta: DataFrame, name: str = "seq_name",
                    fasta_name: str = "name", seq: str = "seq") -> DataFrame:
    """Left join the sequence by name; an unknown name fails the job (not a silent drop).

    ``fasta`` must have one row per name (``read_fasta(dup='first')``).
    """
    f = fasta.select(F.col(fasta_name).alias(name), F.col(seq).alias("__seq"))
    cols = meta.columns
    j = skew_join(meta, f, [name], "left").select(*cols, "__seq")
    checked = F.when(F.col("__seq").isNull(),
                     F.raise_error(F.concat(F.lit("no sequence for name: "), F.col(name).cast("string"))))
    return j.withColumn(seq, F.coalesce(F.col("__seq"), checked.cast("string"))).drop("__seq")


# 42
def cross_grid(df: DataFrame, name: str, values: Sequence, cast: str | None = None) -> DataFrame:
    """Every row of ``df`` once per parameter value (a generator, not a join)."""
    arr = F.array(*[(F.lit(v).cast(cast) if cast else F.lit(v)) for v in values])
    return df.select("*", F.explode(arr).alias(name))


# 43
def backbone_join(escape: DataFrame, refs: DataFrame, key: str = "target") -> DataFrame:
    """Attach the backbone sequence of each measurement's target; unknown targets drop."""
    return escape.join(refs, key, "inner")


# 44
def join_predictions(pred: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions back onto their rows by a 64-bit id (exact at any size)."""
    return pred.join(rows, key, "inner")


def few_keys(keys: DataFrame, most: int = 10_000) -> list | None:
    """The values of a one-column table of distinct keys, or None if there are more than ``most``."""
    fetched = [r[0] for r in keys.limit(most + 1).collect()]
    return fetched if len(fetched) <= most else None


def keys_filter(df: DataFrame, keys: DataFrame, col: str, null_safe: bool = False,
                max_literal: int = 10_000) -> DataFrame:
    """Rows of ``df`` whose ``col`` is among ``keys`` (one column, distinct values).

    The keys are fetched up to ``max_literal + 1``; when they fit they become a
    literal ``IN`` filter (a hash-set lookup in every task, no shuffle of ``df``,
    no skew from a hot key).  Otherwise ``df`` is semi-joined with the keys.
    With ``null_safe`` a NULL key matches NULL values.
    """
    fetched = few_keys(keys, max_literal)
    if fetched is not None:
        vals = [v for v in fetched if v is not None]
        cond = F.col(col).isin(vals) if vals else F.lit(False)
        if null_safe and len(vals) < len(fetched):
            cond = cond | F.col(col).isNull()
        return df.where(cond)
    if null_safe:
        k = keys.select(F.col(keys.columns[0]).alias("__k"))
        return df.join(k, df[col].eqNullSafe(k["__k"]), "left_semi")
    return skew_join(df, keys.withColumnRenamed(keys.columns[0], col), [col], "left_semi").select(*df.columns)


def heavy_keys(df: DataFrame, on: Sequence[str], share: float, tracked: int = 4096) -> list[int]:
    """Hashes (``xxhash64``) of non-null keys with about ``share`` of all rows or more, by a frequent-items
    sketch that tasks build and the aggregate merges; at most 1 / share of them."""
    h = F.when(~key_is_null(on), F.xxhash64(*on)).alias("h")
    k = min(tracked // 4, max(1, int(2 / share)))
    n, top = df.select(h).agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h, {k}, {tracked})")).first()
    return [r["item"] for r in top if r["item"] is not None and r["count"] >= share * n]


def key_is_null(on: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in on])


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int | None = None,
              share: float | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` on equal ``on`` columns (inner, left or left_semi), hot keys of ``big`` dealt over many tasks.

    Keys with at least ``share`` of the rows (default: half a partition's) are found first; their rows in ``big``
    get one of ``salts`` numbers and their rows in ``small`` one copy of each.  All other rows are joined plainly,
    and rows without a key, which match nothing, are spread by the number alone.  ``big`` is read twice, unless
    ``seen``, a written table with about the same keys, tells the hot ones.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"{how} joins are not dealt over tasks")
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or max(2, min(64, parts))
    hot = heavy_keys(big if seen is None else seen, on, share or max(1e-3, 0.5 / parts))
    h = F.xxhash64(*on)
    is_hot = h.isin(hot) if hot else F.lit(False)
    number = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    dealt = big.withColumn("__salt", F.when(is_hot | key_is_null(on), number).otherwise(0))
    if how != "left":
        dealt = dealt.where(~key_is_null(on))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = small.where(~key_is_null(on)).withColumn("__salt", F.explode(copies))
    return dealt.join(spread, [*on, "__salt"], how).drop("__salt")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = 200_000, max_bytes: int = 64 << 20,
                seen: DataFrame | None = None) -> DataFrame:
    """``big`` joined with a dictionary: broadcast when it is measured to be small enough, else by ``skew_join``."""
    if small_enough(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), list(on), how)
    return skew_join(big, small, on, how, seen=seen)


def checked_broadcast(small: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``small`` with a broadcast hint when it is ``small_enough``, else as is."""
    return F.broadcast(small) if small_enough(small, max_rows, max_bytes) else small


def small_enough(small: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether ``small`` has at most ``max_rows`` rows and ``max_bytes`` bytes (measured).

    Meant for tables already written once (the measure reads the same files as the join),
    e.g. id dictionaries.
    """
    def width(c) -> Column:
        if c.dataType.typeName() in ("string", "binary"):
            return F.coalesce(F.octet_length(c.name), F.lit(0))
        if c.dataType.typeName() in ("array", "map", "struct"):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c.name))), F.lit(0))
        return F.lit(16)

    # Only one number per row is moved, and one row more than allowed at most.
    widths = small.select(reduce(add, [width(c) for c in small.schema]).cast("long").alias("w")).limit(max_rows + 1)
    rows, size = widths.agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes
