"""Loss weights, feature selection, regressors and batch scoring (#83–88).

Feature selection is a Spark ML forest; the three regressors are fitted by
``trees`` and ``lasso``, whose searches share passes over the rows among all
draws and folds (seeded random draws from fixed ranges, mean R² over 5 folds).
Scoring with a user model runs in Arrow batches on the executors
(``predict_batch_udf``).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineax.functions.columns import conditional_label
from lineax.operators import lasso, trees


# 83
def loss_weights(df: DataFrame, cutoff: str, thresh: str, fitness_mult: float = 2.0, recent_mult: float = 1.0,
                 group: str = "group", date: str = "date_first") -> DataFrame:
    """Balance fitness vs immune rows: w = 1/n per major group, scaled so the largest is 1.

    n(fitness) counts rows dated before ``cutoff`` (NULL dates do not count);
    then fitness weights are multiplied by ``fitness_mult`` and recent fitness
    (on/after ``thresh``) by a further ``recent_mult``.  Counts enter as scalar
    subqueries (one small aggregation job, no join).
    """
    major = F.when(F.col(group) == "fitness", F.lit("fitness")).otherwise(F.lit("immune"))
    tagged = conditional_label(df.withColumn("major_group", major), "major_group", date, thresh, "major_group2")
    d = F.col(date).cast("date")
    counts = df.agg(F.struct(
        F.count_if(major == "immune").alias("n_imm"),
        F.count_if(d < F.lit(cutoff).cast("date")).alias("n_fit"),
    )).scalar()
    n_imm, n_fit = counts["n_imm"], counts["n_fit"]
    w_imm = F.when(n_imm > 0, F.lit(1.0) / n_imm)
    w_fit = F.when(n_fit > 0, F.lit(1.0) / n_fit)
    w_max = F.greatest(w_imm, w_fit)
    g2 = F.col("major_group2")
    w = (F.when(g2 == "immune", w_imm / w_max)
         .when(g2 == "fitness", w_fit / w_max * F.lit(fitness_mult))
         .when(g2 == "fitness_recent", w_fit / w_max * F.lit(fitness_mult) * F.lit(recent_mult)))
    return tagged.withColumn("weight", w)


# 84
def select_features_rf(train: DataFrame, features: str = "features", label: str = "outcome", k: int = 200,
                       num_trees: int = 20, seed: int = 42, out: str = "selected"):
    """Keep the ``k`` most important features of a 20-tree forest fitted on ``train``.

    Importances are rounded to 10 digits and ties keep feature order.  Returns
    (slicer, indices); the importance vector (one value per feature) is the only
    thing brought to the driver.
    """
    rf = RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees, seed=seed)
    imp = rf.fit(train).featureImportances.toArray()
    order = sorted(range(len(imp)), key=lambda i: (-round(float(imp[i]), 10), i))
    idx = sorted(order[:k])
    return VectorSlicer(inputCol=features, outputCol=out, indices=idx), idx


def _draws(space: dict[str, Callable[[random.Random], object]], n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    return [{name: draw(rng) for name, draw in space.items()} for _ in range(n)]


def _log_uniform(lo: float, hi: float):
    return lambda r: math.exp(r.uniform(math.log(lo), math.log(hi)))


# The ranges of the three searches.
RF_SPACE = {
    "trees": lambda r: r.randint(500, 1000),
    "max_depth": lambda r: r.choice([10, 20, 30, None]),
    "max_features": lambda r: r.choice(["sqrt", "log2", None]),
    "min_samples_split": lambda r: r.randint(5, 20),
    "min_samples_leaf": lambda r: r.randint(1, 4),
    "bootstrap": lambda r: r.choice([True, False]),
}
LASSO_SPACE = {
    "alpha": _log_uniform(1e-5, 1e-3),
    "max_iter": lambda r: r.randint(8000, 10000),
    "tol": _log_uniform(1e-5, 1e-3),
}
BOOST_SPACE = {
    "max_depth": lambda r: r.randint(30, 50),
    "learning_rate": lambda r: r.uniform(0.1, 0.4),
    "rounds": lambda r: r.randint(800, 1000),
    "min_child_weight": lambda r: r.randint(1, 10),
    "reg_alpha": lambda r: r.uniform(1e-6, 1e-4),
    "reg_lambda": lambda r: r.uniform(0, 10),
}
#: Fixed values beside the search: most leaves of a boosted tree and least rows of a leaf.
BOOST_FIXED = {"leaves": 31, "min_child_samples": 20}
#: Patterns x cuts up to which a model is fitted in one task (32 MB of cut indicators).
MAX_CELLS = 4_000_000


def _fit_trees(train: DataFrame, features: str, label: str, draws: Callable[[int], list[dict]], folds: int, seed: int, boosted: bool, max_cells: int):
    bins = trees.find_bins(train, features)
    patterns = trees.pattern_table(train, bins, features, label, folds, seed)
    model, score = trees.search(train.sparkSession, patterns, bins, draws(len(bins.cuts)), folds, boosted, max_cells)
    return trees.TreeModel(model, bins, features), score


def forest_params(draw: dict, width: int, seed: int) -> dict:
    """A draw in the terms of ``trees``: features per node, depth without limit as a number."""
    per_node = {"sqrt": int(math.sqrt(width)), "log2": int(math.log2(max(width, 1))), None: width}[draw["max_features"]]
    return {**draw, "per_node": max(1, per_node), "max_depth": math.inf if draw["max_depth"] is None else draw["max_depth"], "seed": seed}


# 85
def regress_random_forest(train: DataFrame, features: str = "selected", label: str = "outcome", n_draws: int = 20,
                          folds: int = 5, seed: int = 42, space: dict | None = None, max_cells: int = MAX_CELLS):
    """The best of ``n_draws`` forests by mean R2 over ``folds``, fitted on all rows: (model, score).

    Bootstrap counts are Poisson draws hashed from a row's content, so trees
    don't depend on partitions; sample limits count drawn rows.
    """
    def draws(width: int) -> list[dict]:
        return [forest_params(d, width, seed) for d in _draws(space or RF_SPACE, n_draws, seed)]

    return _fit_trees(train, features, label, draws, folds, seed, False, max_cells)


# 86
def regress_lasso(train: DataFrame, features: str = "selected", label: str = "outcome", n_draws: int = 30,
                  folds: int = 5, seed: int = 42, space: dict | None = None):
    """L1 least squares (no standardisation), all fits from one pass over the rows: (model, score)."""
    return lasso.search(train, features, label, _draws(space or LASSO_SPACE, n_draws, seed), folds, seed)


# 87
def regress_boosted_trees(train: DataFrame, features: str = "selected", label: str = "outcome", n_draws: int = 30,
                          folds: int = 5, seed: int = 42, space: dict | None = None, max_cells: int = MAX_CELLS):
    """Leaf-wise boosted histogram trees on squared error, best of ``n_draws``: (model, score)."""
    def draws(width: int) -> list[dict]:
        return [BOOST_FIXED | d for d in _draws(space or BOOST_SPACE, n_draws, seed)]

    return _fit_trees(train, features, label, draws, folds, seed, True, max_cells)


# 88
def score_batch(df: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], input_col: str,
                n_tasks: int, width: int, batch_size: int = 4, out: str = "predicted") -> DataFrame:
    """Apply a user model to Arrow batches of ``input_col`` (array column) on the executors.

    ``make_scorer`` is called once per Python worker and returns ``f(batch) ->
    (len(batch), n_tasks)`` predictions for a ``(len(batch), width)`` input; the
    result is one array of ``n_tasks`` values per row.  The model counts as
    non-deterministic, so the optimiser never copies its call into a filter or
    a second projection: each row is scored once per use of the result.
    """
    udf = predict_batch_udf(make_scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[width]])
    return df.withColumn(out, udf.asNondeterministic()(F.col(input_col)))


def long_predictions(df: DataFrame, pred: str, keys: Sequence[str], task: str = "task_id",
                     out: str = "predicted_outcome") -> DataFrame:
    """One row per (row, task) from a per-row prediction array."""
    return df.select(*keys, F.posexplode(pred).alias(task, out))
