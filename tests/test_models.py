import numpy as np
from pyspark.ml.linalg import Vectors

from lineax.operators import models
from lineax.plans import registry


def _frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(r.tolist()), float(t)) for r, t in zip(x, y)], ["features", "outcome"])


def _lasso_cd(x, y, alpha, iters=5000):
    """Coordinate descent for (1/2n)||y - b0 - Xw||^2 + alpha ||w||_1 (brute-force reference)."""
    n, p = x.shape
    xm, ym = x.mean(0), y.mean()
    xc, yc = x - xm, y - ym
    w = np.zeros(p)
    for _ in range(iters):
        for j in range(p):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            z = xc[:, j] @ xc[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / z
    return w, ym - xm @ w


def test_lasso_matches_coordinate_descent(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = 1.5 * x[:, 0] - 2.0 * x[:, 2] + 0.1 * rng.normal(size=300) + 0.7
    alpha = 0.05
    space = {"alpha": lambda r: alpha, "max_iter": lambda r: 1000, "tol": lambda r: 1e-12}
    model, _ = models.regress_lasso(_frame(spark, x, y), "features", "outcome", n_draws=1, folds=2, space=space)
    w, b = _lasso_cd(x, y, alpha)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-4)
    assert abs(model.intercept - b) < 1e-4


def test_feature_selection_finds_planted_signal(spark):
    rng = np.random.default_rng(1)
    x = (rng.random(size=(400, 30)) < 0.5).astype(float)
    y = 3 * x[:, 4] + 2 * x[:, 17] + 0.05 * rng.normal(size=400)
    slicer, idx = models.select_features_rf(_frame(spark, x, y), "features", "outcome", k=2)
    assert idx == [4, 17]
    out = slicer.transform(_frame(spark, x, y)).select("selected").first()[0]
    assert out.size == 2


def test_score_batch_long_predictions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0])], "id long, x array<double>")

    def make():
        w = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
        return lambda b: np.asarray(b) @ w

    scored = models.score_batch(df, make, "x", 3, width=2, batch_size=1)
    long = {(r.id, r.task_id): r.predicted_outcome for r in models.long_predictions(scored, "predicted", ["id"]).collect()}
    assert long == {(1, 0): 1.0, (1, 1): 2.0, (1, 2): 3.0, (2, 0): 3.0, (2, 1): -1.0, (2, 2): 2.0}


def test_registered_searches_take_the_library_s_defaults(spark, monkeypatch):
    """Draws, folds and ranges that reach the fit of each registered model query."""
    got = {}

    class Same:
        def transform(self, df):
            return df.withColumn("predicted_outcome", df.outcome)

    def fit_trees(train, features, label, draws, folds, seed, boosted, max_cells):
        got[boosted] = (draws(22), folds)
        return Same(), 0.0

    def fit_lasso(train, features, label, draws, folds, seed):
        got["lasso"] = (draws, folds)
        return Same(), 0.0

    frame = spark.createDataFrame([(1, "train", 1.0), (2, "test", 2.0)], "p_partkey long, data_class string, outcome double")
    monkeypatch.setattr(registry, "_model_frame", lambda spark, d: frame)
    monkeypatch.setattr(models, "select_features_rf", lambda *a, **k: (Same(), []))
    monkeypatch.setattr(models, "_fit_trees", fit_trees)
    monkeypatch.setattr(models.lasso, "search", fit_lasso)
    for name in ("regress_random_forest", "regress_lasso", "regress_boosted_trees"):
        assert [r.p_partkey for r in registry.QUERIES[name](spark, "").collect()] == [2]
    assert [(len(x[0]), x[1]) for x in (got[False], got["lasso"], got[True])] == [(20, 5), (30, 5), (30, 5)]
    assert all(500 <= d["trees"] <= 1000 and 5 <= d["min_samples_split"] <= 20 and d["per_node"] in (4, 22) for d in got[False][0])
    assert {d["bootstrap"] for d in got[False][0]} == {True, False}
    assert all(800 <= d["rounds"] <= 1000 and 30 <= d["max_depth"] <= 50 and d["leaves"] == 31 for d in got[True][0])
    assert all(1e-5 <= d["alpha"] <= 1e-3 and 8000 <= d["max_iter"] <= 10000 for d in got["lasso"][0])
