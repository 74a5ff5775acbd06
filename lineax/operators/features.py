"""Arrays, exploding and feature encoding (#77–81)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# 77
def explode_mutation_lists(df: DataFrame, name: str = "seq_name",
                           cols: Sequence[str] = ("aa_substitutions", "aa_deletions", "aa_insertions"),
                           out: str = "mut") -> DataFrame:
    """Long (name, mut, kind, ord): each comma list in ``cols`` order, empties skipped."""
    lists = F.array(*[F.struct(F.lit(i).alias("kind"), F.split(F.coalesce(F.col(c), F.lit("")), ",").alias("items"))
                      for i, c in enumerate(cols)])
    per_kind = df.select(F.col(name), F.inline(lists))
    long = per_kind.select(name, "kind", F.posexplode("items").alias("ord", out))
    return long.where(F.col(out) != "").select(name, out, "kind", "ord")


# 78
def explode_haplotype(df: DataFrame, hap: str = "haplotype", out: str = "mut", missing: str = "nan") -> DataFrame:
    """One row per mutation token; a missing haplotype becomes the single token ``missing``."""
    tokens = F.when(F.col(hap).isNull(), F.array(F.lit(missing))).otherwise(F.split(F.col(hap), r",\s*"))
    return df.withColumn(out, F.explode(tokens))


def haplotype_tokens(df: DataFrame, hap: str = "haplotype", out: str = "tokens", missing: str = "nan") -> DataFrame:
    tokens = F.when(F.col(hap).isNull(), F.array(F.lit(missing))).otherwise(F.split(F.col(hap), r",\s*"))
    return df.withColumn(out, F.array_distinct(tokens))


# 79
def multi_hot(df: DataFrame, tokens: str = "tokens", out: str = "mut_vec", min_df: float = 1.0, max_vocab: int = 1 << 22):
    """0/1 sparse vector over the token vocabulary of ``df`` (fit on every row given).

    The vocabulary is held by the driver: more than ``max_vocab`` distinct
    tokens are an error, none is ever left out.
    """
    n = df.select(F.explode(tokens).alias("_t")).distinct().count()
    if n > max_vocab:
        raise ValueError(f"{n} distinct tokens, more than max_vocab = {max_vocab}")
    cv = CountVectorizer(inputCol=tokens, outputCol=out, binary=True, minDF=min_df, vocabSize=max(n, 1))
    model = cv.fit(df)
    return model.transform(df), model


# 80
def one_hot_country(df: DataFrame, col: str = "country", out: str = "country_vec"):
    """Full dummy coding (no level dropped), levels in alphabetical order; a missing value has all zeros."""
    idx = StringIndexer(inputCol=col, outputCol=f"{col}_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
    im = idx.fit(df)
    enc = OneHotEncoder(inputCol=f"{col}_idx", outputCol=out, dropLast=True)  # the last level is the one for missing values
    indexed = im.transform(df)
    em = enc.fit(indexed)
    return em.transform(indexed), (im, em)


# 81
def task_vectors(df: DataFrame, seq_id: str = "seq_id", task_id: str = "task_id", outcome: str = "outcome",
                 weight: str = "weight", row_id: str = "row_id", by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Sparse per-sequence label vectors: one (task, outcome, weight, row, ``carry`` columns) per task, sorted by task.

    Duplicate (seq, task) cells keep the highest row id (last write wins); both
    steps are partial aggregates.
    """
    last = (df.groupBy(seq_id, task_id, *by)
            .agg(F.max(F.struct(F.col(row_id), F.col(outcome), F.col(weight), *[F.col(c) for c in carry])).alias("_l"))
            .select(seq_id, *by, F.struct(F.col(task_id).alias("task_id"), F.col("_l").getField(outcome).alias("outcome"),
                                         F.col("_l").getField(weight).alias("weight"),
                                         F.col("_l").getField(row_id).alias("row_id"),
                                         *[F.col("_l").getField(c).alias(c) for c in carry]).alias("_cell")))
    return last.groupBy(seq_id, *by).agg(F.sort_array(F.collect_list("_cell")).alias("labels"))
