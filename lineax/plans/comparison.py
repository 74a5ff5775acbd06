"""Model comparison: haplotypes and countries to features, models fitted on the past, judged on test and future rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.operators import features, models
from lineax.operators.metrics import evaluate_predictions
from lineax.session import materialize

#: What each set of the report is made of.
SETS = {"test_and_future": ("test", "future"), "future": ("future",)}


def feature_frame(rows: DataFrame, hap: str = "haplotype", country: str = "country", out: str = "features") -> DataFrame:
    """``rows`` with one 0/1 feature per mutation token of the haplotype (a missing one is the token ``nan``) and per country."""
    tokens = features.haplotype_tokens(rows, hap, "__tokens")
    hot, _ = features.multi_hot(tokens, "__tokens", "__muts")
    both, _ = features.one_hot_country(hot, country, "__country")
    return VectorAssembler(inputCols=["__muts", "__country"], outputCol=out).transform(both).select(*rows.columns, out)


def compare_models(frame: DataFrame, fits: Mapping[str, Callable[[DataFrame], object]], n_features: int | None = 200, label: str = "outcome",
                   data_class: str = "data_class") -> tuple[DataFrame, DataFrame]:
    """(report, predictions) of models fitted on the train rows of ``frame`` (features, label, data_class).

    ``fits``: name → function from train rows (with a vector ``selected``) to a model with ``transform``.  The ``n_features``
    most important features of a small forest are selected first (None: all).  The report has a row per model and set:
    test and future rows together, and future rows.
    """
    train = F.col(data_class) == "train"
    if n_features is None:
        chosen = frame.withColumn("selected", F.col("features"))
    else:
        chosen = models.select_features_rf(frame.where(train), "features", label, k=n_features)[0].transform(frame)
    chosen = materialize(chosen.drop("features"), "model_rows")
    judged = None
    for name, fit in fits.items():
        found = fit(chosen.where(train)).transform(chosen.where(F.col(data_class).isin("test", "future")))
        found = found.drop("selected").withColumn("model", F.lit(name))
        judged = found if judged is None else judged.unionByName(found)
    judged = materialize(judged, "predictions")
    sets = F.filter(F.array(*[F.when(F.col(data_class).isin(*of), F.lit(s)) for s, of in SETS.items()]), lambda s: s.isNotNull())
    report = evaluate_predictions(judged.withColumn("eval_set", F.explode(sets)), label, "predicted_outcome", ["model", "eval_set"])
    return report, judged
