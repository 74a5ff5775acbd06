"""The comparison plan: features of missing haplotypes, selection on train rows, both report sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineax.operators import lasso
from lineax.plans import comparison


def test_report_is_numpy_s_on_both_sets(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(240):
        muts = [m for m in ("S:A1B", "S:C2D", "S:E3F") if r.random() < 0.4]
        rows.append((i, ", ".join(muts) or None, ["X", "Y"][i % 2], 2.0 * ("S:C2D" in muts) + 0.5 * (i % 2) + 0.1 * r.normal(), ["train", "train", "test", "future"][i % 4]))
    df = spark.createDataFrame(rows, "i int, haplotype string, country string, outcome double, data_class string")
    frame = comparison.feature_frame(df)
    assert frame.columns == [*df.columns, "features"] and len(frame.first().features) == 3 + 1 + 2  # mutations, nan, countries

    def fit(train):
        assert {x[0] for x in train.select("data_class").distinct().collect()} == {"train"}
        return lasso.search(train, "selected", "outcome", [{"alpha": 1e-4, "max_iter": 1000, "tol": 1e-9}], 2, 1)[0]

    report, judged = comparison.compare_models(frame, {"lasso": fit}, n_features=3)
    got = {x.eval_set: x for x in report.collect()}
    pairs = [(x.data_class, x.outcome, x.predicted_outcome) for x in judged.collect()]
    for name, of in comparison.SETS.items():
        y, p = np.array([x[1:] for x in pairs if x[0] in of]).T
        assert got[name].n == len(y) and got[name].pearson == pytest.approx(np.corrcoef(y, p)[0, 1])
        assert got[name].r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and got[name].r2 > 0.9
    assert judged.where(F.col("data_class") == "train").isEmpty()
