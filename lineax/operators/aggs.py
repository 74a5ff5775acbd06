"""Aggregations (#45–63).

All of them aggregate map-side first, so a key that holds a third of the rows
is pre-combined in every task before the shuffle.  "Pick one row per key" is
``min(struct(order, payload))`` — also a partial aggregate, planned as a sort
aggregate where the payload holds strings — rather than ``row_number`` over a per-key window, which
would send the whole hot key to one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.operators.joins import checked_broadcast, keys_filter
from lineax.operators.ordinal import with_running_total


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# 45
def count_having(df: DataFrame, keys: str | Sequence[str], min_count: int, strict: bool = False,
                 name: str = "n") -> DataFrame:
    """Group sizes kept when ``> min_count`` (strict) or ``>= min_count``.  NULL is a group."""
    counts = df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias(name))
    cond = F.col(name) > min_count if strict else F.col(name) >= min_count
    return counts.where(cond)


# 46
def filter_groups_by_size(df: DataFrame, key: str, min_count: int, max_literal: int = 10_000) -> DataFrame:
    """Rows of groups with at least ``min_count`` rows; NULL-key rows drop (pandas groupby).

    The qualifying keys are computed first (a narrow aggregation).  If there
    are at most ``max_literal`` of them — checked by fetching at most one more —
    they become a literal ``IN`` filter, so the wide rows are never shuffled;
    otherwise the rows are semi-joined with the key table.
    """
    big = count_having(df.where(F.col(key).isNotNull()).select(key), key, min_count).select(key)
    return keys_filter(df, big, key, max_literal=max_literal)


# 47
def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Counts per non-NULL value, largest first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(col)))


# 48
def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


# 49
def dedupe_keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column],
                      keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) by ``order``; deterministic when ``order`` is total."""
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.struct(F.struct(*order_cols).alias("o"), F.struct(*rest).alias("r"))
    pick = F.min if keep == "first" else F.max
    out = df.groupBy(*keys).agg(pick(packed).alias("_k"))
    return out.select(*keys, *[F.col(f"_k.r.{c}").alias(c) for c in rest])


# 50
def haplotype_string(df: DataFrame, key: str, mut: str = "mut", out: str = "haplotype",
                     sep: str = ", ", na: str = "NA", order: str | None = None) -> DataFrame:
    """One canonical string per key from its distinct mutations; no mutation -> ``na``.

    Default order is sorted text (canonical); pass ``order`` to keep a source order.
    """
    m = F.col(mut)
    if order is None:
        arr = F.array_sort(F.collect_set(m))
    else:
        arr = F.transform(F.array_sort(F.collect_set(F.struct(F.col(order), m))), lambda s: s[mut])
    joined = F.array_join(arr, sep)
    return df.groupBy(key).agg(F.when(F.size(arr) == 0, F.lit(na)).otherwise(joined).alias(out))


#: Modulus and salts of set digests.
DIGEST_MODULUS = (1 << 61) - 1
DIGEST_SALTS = {"z1": 307, "z2": 401}


def set_digest(items: Column) -> list[Column]:
    """z1 and z2 of an array of distinct strings: sums of the items' hashes, so equal sets in any order have equal
    digests, and an array of a row needs neither sorting nor joining to be told from another."""
    def total(salt: int) -> Column:
        terms = F.transform(items, lambda x: F.pmod(F.xxhash64(x, F.lit(salt)), F.lit(DIGEST_MODULUS)))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, x: (acc + x) % F.lit(DIGEST_MODULUS))

    return [total(salt).alias(z) for z, salt in DIGEST_SALTS.items()]


def set_dictionary(rows: DataFrame, items: str, out: str = "haplotype", sep: str = ", ", na: str = "NA") -> DataFrame:
    """(z1, z2, out): the canonical string of each distinct set of ``rows`` (z1, z2 and the array ``items``), built once."""
    one = rows.groupBy(*DIGEST_SALTS).agg(F.first(items).alias("_i"))
    text = F.array_join(F.array_sort("_i"), sep)
    return one.select(*DIGEST_SALTS, F.when(F.size("_i") == 0, F.lit(na)).otherwise(text).alias(out))


# 51
def first_seen_quantile(df: DataFrame, key: str | Sequence[str], date: str, p: float = 0.01,
                        out: str = "date_first") -> DataFrame:
    """Discrete (inverse-CDF) ``p`` quantile of a date per group: a robust emergence date."""
    d = F.unix_date(F.col(date).cast("date"))
    q = F.expr(f"percentile_disc({p}) within group (order by __d)")
    return (df.withColumn("__d", d).groupBy(*_cols(key))
            .agg(F.date_from_unix_date(q.cast("int")).alias(out)))


# 52
def exact_quantile(df: DataFrame, col: str, p: float | Sequence[float], by: Sequence[str] = (),
                   out: str = "q") -> DataFrame:
    """Linear-interpolation quantile (numpy default) over all rows or per group.

    Equal values are counted first (combined map-side), and only the distinct
    ones are sorted, with a running total of the counts as their first rank (a
    hot group is sorted by many tasks); then only the values at the two
    neighbouring ranks of each requested quantile are picked.  ``out`` is a
    double, or an array for a list of ``p``.  NULLs are ignored.

    A quantile over many rows (``NARROW_FROM`` and more) first asks a sketch for
    values around each wanted rank: rows between these are counted as one, so
    few distinct values are shuffled and sorted.  Should a wanted rank lie
    outside, all of them are.
    """
    ps = [p] if isinstance(p, (int, float)) else list(p)
    grouped = bool(by)
    by = list(by) if grouped else ["_all"]
    x = df.select(*(by if grouped else [F.lit(0).alias("_all")]), F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    narrowed = None if grouped else _narrowed(x, ps)
    counts = (x if narrowed is None else narrowed).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    ranked = with_running_total(counts, [*by, "_x"], "_c", "_g")
    starts = ranked.groupBy(*by).agg(F.min("_g").alias("_s"), F.sum("_c").alias("_n"))
    pos = [(F.col("_s") + F.lit(q) * (F.col("_n") - 1)) for q in ps]
    targets = starts.select(*by, *[F.floor(c).alias(f"_lo{i}") for i, c in enumerate(pos)],
                            *[F.ceil(c).alias(f"_hi{i}") for i, c in enumerate(pos)],
                            *[(c - F.floor(c)).alias(f"_f{i}") for i, c in enumerate(pos)])

    def at(rank: str) -> Column:
        return F.col(rank).between(F.col("_g"), F.col("_g") + F.col("_c") - 1)

    wanted = F.lit(False)
    for i in range(len(ps)):
        wanted = wanted | at(f"_lo{i}") | at(f"_hi{i}")
    # Ungrouped: one target row, a proven bound, so it is broadcast.
    picked = ranked.join(checked_broadcast(targets) if grouped else F.broadcast(targets), by, "inner").where(wanted)
    vals = []
    for i in range(len(ps)):
        lo = F.max(F.when(at(f"_lo{i}"), F.col("_x")))
        hi = F.max(F.when(at(f"_hi{i}"), F.col("_x")))
        vals.append(lo + F.first(f"_f{i}") * (hi - lo))
    res = picked.groupBy(*by).agg(*[v.alias(f"_q{i}") for i, v in enumerate(vals)])
    q = F.col("_q0") if isinstance(p, (int, float)) else F.array(*[F.col(f"_q{i}") for i in range(len(ps))])
    return res.select(*(by if grouped else []), q.alias(out))


#: Rows from which a quantile is sought among the values near it, and the sketch's accuracy: a rank is told to 1 / SKETCHED of the rows.
NARROW_FROM = 1_000_000
SKETCHED = 10_000


def _narrowed(x: DataFrame, ps: Sequence[float]) -> DataFrame | None:
    """``x`` (_all, _x) with as many rows before each value that may be wanted, and the others made few distinct values; None if that can't be."""
    n = x.count()
    if n < NARROW_FROM:
        return None
    edges = [(max(0.0, q - 2 / SKETCHED), min(1.0, q + 2 / SKETCHED)) for q in ps]
    found = x.agg(F.percentile_approx("_x", [e for pair in edges for e in pair], SKETCHED)).first()[0]
    near: list[list[float]] = []
    for lo, hi in sorted(zip(found[::2], found[1::2])):
        if near and lo <= near[-1][1]:
            near[-1][1] = max(near[-1][1], hi)
        else:
            near.append([lo, hi])
    if any(math.isnan(v) or math.isinf(v) for pair in near for v in pair):
        return None
    v = F.col("_x")
    before = [F.count_if(v < lo) for lo, _ in near]
    upto = [F.count_if(v <= hi) for _, hi in near]
    counted = x.agg(*[c.alias(f"_{i}") for i, c in enumerate([*before, *upto])]).first()
    for q in ps:
        pos = q * (n - 1)
        if not any(counted[i] <= math.floor(pos) and math.ceil(pos) < counted[len(near) + i] for i in range(len(near))):
            return None
    # Values below the first range, between two, and above the last: each is the next range's lower end's neighbour, or infinity.
    outside = F.lit(float("inf"))
    for lo, hi in reversed(near):
        outside = F.when(v < lo, F.lit(math.nextafter(lo, -math.inf))).when(v <= hi, v).otherwise(outside)
    return x.withColumn("_x", outside)


# 53
def group_min_date(df: DataFrame, key: str, date: str, out: str = "date_first") -> DataFrame:
    return df.groupBy(key).agg(F.min(date).alias(out))


# 54
def reference_haplotype(df: DataFrame, clade_value: str, country: str = "country", hap: str = "hap_id",
                        clade: str = "clade") -> DataFrame:
    """The haplotype of ``clade_value`` present in every country that has the clade, with the
    largest minimum per-country count; ties go to the smallest id.  One row.
    """
    rows = df.where(F.col(clade) == clade_value)
    per = rows.groupBy(country, hap).agg(F.count(F.lit(1)).alias("n"))
    n_countries = rows.agg(F.countDistinct(country)).scalar()
    stats = per.groupBy(hap).agg(F.min("n").alias("count_min"), F.count(F.lit(1)).alias("n_countries"))
    everywhere = stats.where(F.col("n_countries") == n_countries)
    return everywhere.orderBy(F.desc("count_min"), F.asc(hap)).limit(1).select(hap, "count_min")


# 55
def pivot_counts(df: DataFrame, rows: str | Sequence[str], col: str, values: Sequence, value: str = "n") -> DataFrame:
    """Wide table for reports only; the pivot values are given (no extra distinct job)."""
    return df.groupBy(*_cols(rows)).pivot(col, list(values)).agg(F.sum(value)).na.fill(0)


# 56
def unpivot_counts(df: DataFrame, ids: Sequence[str], var: str = "key", value: str = "n") -> DataFrame:
    cols = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, var, value)


# 57
def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = (), out: str = "pearson") -> DataFrame:
    """Correlation over rows where both are present (labelled cells only)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(F.corr(a, b).alias(out))


def average_ranks(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """(by..., col, rank): 1-based average rank of each distinct value within ``by`` (ties share
    the mean of their positions), NULLs ignored.

    Ranks depend only on value counts: values are counted with map-side
    combining, and a distributed running total over the sorted distinct values
    gives each value's position, so no row-level sort is needed.
    """
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    run = with_running_total(counts, [*by, col], "_c", "_b")
    if by:
        starts = run.groupBy(*by).agg(F.min("_b").alias("_s"))
        run = run.join(starts, by, "inner")
    else:
        run = run.withColumn("_s", F.lit(0))
    rank = F.col("_b") - F.col("_s") + (F.col("_c") + 1) / 2.0
    return run.select(*by, col, rank.alias(out))


# 58
def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), out: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks for ties (equals pandas ``method='spearman'``).

    Each row looks up the rank of its two values (joins on value, broadcast by
    Spark when the distinct values are few), then Pearson of the ranks.
    """
    by = list(by)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    ra = checked_broadcast(average_ranks(both, a, by, "_ra"))
    rb = checked_broadcast(average_ranks(both, b, by, "_rb"))
    j = both.join(ra, [*by, a], "inner").join(rb, [*by, b], "inner")
    return j.groupBy(*by).agg(F.corr("_ra", "_rb").alias(out))


# 59
def weighted_mse(df: DataFrame, pred: str, y: str, w: str, by: Sequence[str] = (), out: str = "wmse") -> DataFrame:
    """sum(w * (p - y)^2) / number of labelled cells (not / sum of weights)."""
    lab = df.where(F.col(y).isNotNull())
    sq = F.col(w) * F.pow(F.col(pred) - F.col(y), 2)
    return lab.groupBy(*by).agg((F.sum(sq) / F.count(y)).alias(out))


# 60
def r2_score(df: DataFrame, y: str, p: str, by: Sequence[str] = (), out: str = "r2") -> DataFrame:
    """Coefficient of determination 1 - SSE/SST (not the squared correlation).

    SST is n * var_pop(y), which Spark accumulates with a stable merge in one pass.
    """
    sse = F.sum(F.pow(F.col(y) - F.col(p), 2))
    sst = F.var_pop(y) * F.count(y)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        (F.lit(1.0) - F.try_divide(sse, sst)).alias(out))


# 61
def fit_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line y = intercept + slope * x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


# 62
def perplexity(df: DataFrame, nll: str, by: Sequence[str] = (), out: str = "perplexity") -> DataFrame:
    """exp of the mean per-token negative log-likelihood."""
    return df.groupBy(*by).agg(F.exp(F.avg(nll)).alias(out))


# 63
def positions_mutated(df: DataFrame, pos: str = "pos", out: str = "count_hap") -> DataFrame:
    """Rows per position (two mutations at one position count twice)."""
    return df.groupBy(pos).agg(F.count(F.lit(1)).alias(out))
