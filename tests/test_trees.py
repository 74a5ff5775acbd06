"""Trees and lasso against brute force: exact splits, one result on one machine and on Spark, scores from sums."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lineax.operators import lasso, models, trees
from lineax.plans import registry

BOOST = {"rounds": 6, "leaves": 5, "max_depth": 9, "learning_rate": 0.5, "min_child_weight": 1, "min_child_samples": 3, "reg_alpha": 0.01, "reg_lambda": 0.5}
FOREST = {"trees": 4, "max_depth": 4, "per_node": 3, "min_samples_split": 4, "min_samples_leaf": 2, "bootstrap": True, "seed": 5}


def data(n=240, seed=0, width=5):
    r = np.random.default_rng(seed)
    x = np.stack([(r.random(n) < 0.4).astype(float), (r.random(n) < 0.1).astype(float), r.integers(0, 4, n).astype(float), np.round(r.normal(size=n), 1), np.full(n, 7.0)][:width], axis=1)
    y = 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 2] * x[:, 0] + 0.1 * r.normal(size=n)
    return x, np.round(y, 3)


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(r.tolist()), float(t)) for r, t in zip(x, y, strict=True)], ["features", "outcome"])


def brute_boost(x, y, p):
    """Leaf-wise boosting on raw values, every threshold of every feature tried."""
    def soft(s):
        return math.copysign(max(abs(s) - p["reg_alpha"], 0), s)

    def gain(s, w):
        return soft(s) ** 2 / (w + p["reg_lambda"])

    def best(rows, res):
        found = None
        for f in range(x.shape[1]):
            v = np.unique(x[rows, f])
            for t in (v[1:] + v[:-1]) / 2:
                right = x[rows, f] > t
                n = right.sum()
                if min(n, len(rows) - n) < max(p["min_child_samples"], p["min_child_weight"]):
                    continue
                a, b = res[rows][right].sum(), res[rows][~right].sum()
                g = gain(a, n) + gain(b, len(rows) - n) - gain(a + b, len(rows))
                if g > 1e-9 and (found is None or g > found[0] + 1e-12):
                    found = (g, rows[right], rows[~right])
        return found

    out = np.full(len(y), y.mean())
    for _ in range(p["rounds"]):
        res = y - out
        leaves = [(np.arange(len(y)), best(np.arange(len(y)), res))]
        while len(leaves) < p["leaves"] and any(b for _, b in leaves):
            i = max((i for i, (_, b) in enumerate(leaves) if b), key=lambda i: leaves[i][1][0])
            _, (_, right, left) = leaves.pop(i)
            leaves += [(left, best(left, res)), (right, best(right, res))]
        for rows, _ in leaves:
            out[rows] += p["learning_rate"] * soft(res[rows].sum()) / (len(rows) + p["reg_lambda"])
    return out


def fitted(spark, x, y, folds=3):
    df = frame(spark, x, y)
    bins = trees.find_bins(df, "features")
    return df, bins, trees.pattern_table(df, bins, "features", "outcome", folds, 1)


def test_bins_hold_every_value_of_small_features(spark):
    x, y = data()
    _, bins, patterns = fitted(spark, x, y)
    assert [len(c) for c in bins.cuts] == [1, 1, 3, len(np.unique(x[:, 3])) - 1, 0]
    codes = bins.codes(x)
    assert codes[:, 2].tolist() == x[:, 2].astype(int).tolist()
    total = patterns.selectExpr("sum(n)", "sum(y)", "count(*)").first()
    assert total[0] == len(y) and total[1] == pytest.approx(y.sum()) and total[2] <= len(y)


def test_boosting_is_the_brute_force_one(spark):
    x, y = data()
    df, bins, patterns = fitted(spark, x, y)
    held = trees.local_patterns(patterns, bins, 1 << 30)
    m = trees.Model(BOOST, -1, True)
    trees.run_here(m, bins, held, bins.beyond(held.codes).astype(float))
    assert np.allclose(trees.predictions(m, bins.codes(x)), brute_boost(x, y, BOOST))
    got = trees.TreeModel(m, bins, "features").transform(df).select("predicted_outcome").toPandas()["predicted_outcome"]
    assert np.allclose(sorted(got), sorted(brute_boost(x, y, BOOST)))


@pytest.mark.parametrize("boosted", [True, False])
def test_one_task_and_spark_grow_the_same_trees(spark, boosted):
    x, y = data(seed=3)
    _, bins, patterns = fitted(spark, np.concatenate([x, x[:40]]), np.concatenate([y, y[:40]]))
    held = trees.local_patterns(patterns, bins, 1 << 30)
    params = BOOST if boosted else FOREST
    here, there = ([trees.Model(params, f, boosted) for f in (-1, 0, 2)] for _ in range(2))
    for m in here:
        trees.run_here(m, bins, held, bins.beyond(held.codes).astype(float))
    trees.run_on_spark(there, bins, patterns.repartition(3), refresh=2)
    for a, b in zip(here, there, strict=True):
        assert len(a.done) == len(b.done)
        assert np.allclose(trees.predictions(a, bins.codes(x)), trees.predictions(b, bins.codes(x)))


def test_search_scores_alike_on_both_paths_and_leave_the_fold_out(spark):
    x, y = data(seed=5)
    df, bins, patterns = fitted(spark, x, y)
    draws = [BOOST, BOOST | {"rounds": 1}]
    one, score = trees.search(spark, patterns, bins, draws, 3, True, 1 << 30)
    two, same = trees.search(spark, patterns, bins, draws, 3, True, 0)
    assert score == pytest.approx(same) and score > 0.8 and one.params == two.params == BOOST
    fold = np.array([r[0] for r in df.select(trees.fold_of("features", "outcome", 3, 1)).collect()])
    parts = []
    for f in range(3):
        m = trees.Model(BOOST, f, True)
        held = trees.local_patterns(patterns, bins, 1 << 30)
        trees.run_here(m, bins, held, bins.beyond(held.codes).astype(float))
        t = fold == f
        g = trees.predictions(m, bins.codes(x[t]))
        parts.append(1 - ((y[t] - g) ** 2).sum() / ((y[t] - y[t].mean()) ** 2).sum())
    assert score == pytest.approx(np.mean(parts))


def test_bootstrap_counts_have_the_poisson_moments():
    key = trees._mixed(np.arange(20_000, dtype=np.uint64))
    for n in (1.0, 7.0, 400.0):
        c = trees.bootstrap(np.full(20_000, n), key, 3)
        assert c.mean() == pytest.approx(n, rel=0.03) and c.var() == pytest.approx(n, rel=0.06)
    assert not np.array_equal(trees.bootstrap(np.ones(100), key[:100], 1), trees.bootstrap(np.ones(100), key[:100], 2))


def test_forest_respects_its_limits(spark):
    x, y = data(seed=8)
    _, bins, patterns = fitted(spark, x, y)
    held = trees.local_patterns(patterns, bins, 1 << 30)
    m = trees.Model(FOREST | {"bootstrap": False, "per_node": 5, "max_depth": 3, "min_samples_leaf": 20}, -1, False)
    trees.run_here(m, bins, held, bins.beyond(held.codes).astype(float))
    leaf = m.done[0].leaves(bins.codes(x))
    assert np.bincount(leaf)[np.unique(leaf)].min() >= 20 and len(np.unique(leaf)) <= 8
    for n in np.unique(leaf):
        assert m.done[0].value[n] == pytest.approx(y[leaf == n].mean())
    assert len({tuple(t.feature) for t in m.done}) == 1


def test_lasso_scores_from_sums_are_those_of_rows(spark):
    x, y = data(n=150, seed=2, width=4)
    df = frame(spark, x, y)
    tables = lasso.fold_products(df.repartition(3), "features", "outcome", 4, 7)
    z = np.concatenate([np.ones((len(y), 1)), x, y[:, None]], axis=1)
    assert np.allclose(tables.sum(axis=0), z.T @ z)
    fold = np.array([r[0] for r in df.select(trees.fold_of("features", "outcome", 4, 7)).collect()])
    w, b = lasso.descend(tables.sum(axis=0) - tables[1], 0.01, 5000, 1e-10)
    t = fold == 1
    assert lasso.r2(tables[1], w, b) == pytest.approx(1 - ((y[t] - b - x[t] @ w) ** 2).sum() / ((y[t] - y[t].mean()) ** 2).sum())
    warm, _ = lasso.descend(tables.sum(axis=0) - tables[1], 0.01, 5000, 1e-10, start=np.ones(4))
    assert np.allclose(w, warm, atol=1e-6)


def test_models_of_constant_and_of_repeated_rows(spark):
    x, y = np.ones((30, 2)), np.arange(30.0)
    df = frame(spark, x, y)
    for fn, space in ((models.regress_boosted_trees, {k: (lambda r, v=v: v) for k, v in BOOST.items()}),
                      (models.regress_lasso, {"alpha": lambda r: 0.1, "max_iter": lambda r: 50, "tol": lambda r: 1e-6})):
        model, _ = fn(df, "features", "outcome", n_draws=1, folds=2, space=space)
        assert {round(r.predicted_outcome, 9) for r in model.transform(df).collect()} == {14.5}


def test_equal_rows_go_through_the_trees_once(monkeypatch):
    r = np.random.default_rng(4)
    codes = r.integers(0, 3, (60, 4)).astype(np.uint8)
    p = trees.Patterns(codes, np.zeros(60, np.int32), np.ones(60), r.normal(size=60), np.ones(60), np.arange(60, dtype=np.uint64))
    bins = trees.Bins([np.array([0.5, 1.5])] * 4)
    m = trees.Model(BOOST, -1, True)
    fitted_here = trees.run_here(m, bins, p, bins.beyond(codes).astype(float))

    def walked(tree, row):
        node = 0
        while tree.feature[node] >= 0:
            node = (tree.right if row[tree.feature[node]] > tree.cut[node] else tree.left)[node]
        return tree.value[node]

    by_hand = np.array([m.base + sum(walked(t, c) for t in m.done) for c in codes])
    assert max(len(t.feature) for t in m.done) > 3
    assert np.allclose(fitted_here, by_hand)
    seen = []
    monkeypatch.setattr(trees.Tree, "predict", lambda self, c, f=trees.Tree.predict: (seen.append(len(c)), f(self, c))[1])
    assert np.allclose(trees.predictions(m, np.tile(codes, (50, 1))), np.tile(by_hand, 50))
    assert set(seen) == {len(np.unique(codes, axis=0))}
    assert trees.predictions(m, codes[:0]).shape == (0,)


def test_model_rows_are_dealt_out_and_written_once(spark, tmp_path):
    """A small file's rows come back in several files, with their features."""
    words = ["red", "blue", "hot", "ring"]
    parts = [(i, f"{words[i % 4]} {words[i // 4 % 4]}", ["A", "B"][i % 2], 1 + i % 5, 900.0 + i % 7) for i in range(200)]
    names = "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([*parts, (200, "hot ring", None, None, None)], names).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    m = registry._model_frame(spark, str(tmp_path))
    files = m.inputFiles()
    assert len(files) > 1 and not any(str(tmp_path) in f for f in files)
    assert "UDF" not in m._jdf.queryExecution().executedPlan().toString()
    rows = {r.p_partkey: r for r in m.collect()}
    assert len(rows) == 201 and len(rows[0].features) == 6 and rows[200].features.numNonzeros() == 2
    assert [rows[i].features.numNonzeros() for i in (0, 1)] == [2, 3]
