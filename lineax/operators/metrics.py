"""Prediction evaluation (#89): the grouped metrics of #57–#61 in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.operators.aggs import spearman


def evaluate_predictions(df: DataFrame, y: str = "outcome", p: str = "predicted_outcome",
                         by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, pearson, spearman, r2, slope, intercept) over rows with both values.

    slope/intercept describe the line p = intercept + slope * y (prediction vs truth).
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    keys = list(by) or ["_all"]
    if not by:  # one constant group instead of joining one-row tables
        rows = rows.withColumn("_all", F.lit(0))
    # Moment-based metrics in one aggregation pass; Spearman needs ranks (two sorts).
    sse = F.sum(F.pow(F.col(y) - F.col(p), 2))
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(y, p).alias("pearson"),
        (F.lit(1.0) - F.try_divide(sse, F.var_pop(y) * F.count(y))).alias("r2"),
        F.regr_slope(p, y).alias("slope"),
        F.regr_intercept(p, y).alias("intercept"),
    )
    out = moments.join(spearman(rows, y, p, keys), keys, "inner")
    out = out.select(*keys, "n", "pearson", "spearman", "r2", "slope", "intercept")
    return out if by else out.drop("_all")
