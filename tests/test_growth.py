"""The growth fit against plain Newton with the whole Hessian, and with many haplotypes, sparse days and lone countries."""

import numpy as np
import pytest

from lineax.operators import growth


def counts_of(seed, days, classes, size):
    r = np.random.default_rng(seed)
    x = np.sort(r.choice(np.arange(1, 400), days, replace=False)).astype(float) / 400
    e = r.normal(size=classes) * 2 + x[:, None] * r.normal(size=classes) * 6
    p = np.exp(e - e.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return x, np.stack([r.multinomial(size, q) for q in p])


def dense_step(x, y, w):
    """The Newton step from ``w`` by the whole Hessian of the 2 (K - 1) parameters."""
    k = y.shape[1]
    z = np.stack([np.ones_like(x), x], axis=1)
    n = y.sum(axis=1)
    e = z @ w.T
    p = np.exp(e - e.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    g = ((y - n[:, None] * p).T @ z)[1:].ravel()
    h = np.zeros((k, 2, k, 2))
    for t in range(len(x)):
        h += np.einsum("ab,cd->acbd", n[t] * (np.diag(p[t]) - np.outer(p[t], p[t])), np.outer(z[t], z[t]))
    return np.linalg.solve(h[1:, :, 1:, :].reshape(2 * (k - 1), -1), g).reshape(-1, 2)


@pytest.mark.parametrize(("days", "classes", "size"), [(25, 3, 500), (60, 12, 200), (12, 4, 3000)])
def test_dense_newton_stays_at_the_fit(days, classes, size):
    x, y = counts_of(days, days, classes, size)
    y = y[:, y.sum(axis=0) > 0]
    c = growth.Country(x, y.sum(axis=1).astype(float), y.sum(axis=0).astype(float), x @ y)
    w, _, score = c.fit(100, 1e-12)
    assert score < 1e-9
    assert np.abs(dense_step(x, y, w)).max() < 1e-5
    assert np.abs(dense_step(x, y, w + 0.01 * (np.arange(len(w)) == 1)[:, None])).max() > 5e-3


def test_many_haplotypes_in_small_blocks(monkeypatch):
    x, y = counts_of(5, 80, 400, 3000)
    y = y[:, y.sum(axis=0) >= 20]
    args = x, y.sum(axis=1).astype(float), y.sum(axis=0).astype(float), x @ y
    w, steps, score = growth.Country(*args).fit(100, 1e-10)
    assert score < 1e-8 and steps < 40
    monkeypatch.setattr(growth, "CELLS", 1000)
    again, _, _ = growth.Country(*args).fit(100, 1e-10)
    assert np.allclose(w[:, 1], again[:, 1], rtol=1e-4, atol=1e-4)


def test_countries_are_fitted_in_one_job_and_apart(spark):
    rows = [(c, day, f"h{k}", 40 + 2 * day * k * (1 + (c == "Y"))) for c in ("X", "Y") for day in range(1, 16) for k in range(3)] + [("Z", 3, "h0", 50), ("Z", 9, "h0", 1)]
    counts = spark.createDataFrame(rows, "country string, day_bin int, hap_id string, n long")
    table, design, coefs = growth.growth_fit(counts.repartition(5), "h0", 15)
    got = {(r.country, r.hap_id): r for r in table.collect()}
    assert all(r.converged for r in got.values()) and got["X", "h0"].relative_re == got["Z", "h0"].relative_re == 1.0
    alone = {r.hap_id: r.slope for r in growth.growth_fit(counts.where("country = 'Y'"), "h0", 15)[0].collect()}
    assert all(got["Y", h].slope == pytest.approx(s, abs=1e-8) for h, s in alone.items())
    assert {r.max_score_per_n < 1e-7 for r in growth.growth_certificate(design, coefs, 15).collect()} == {True}


def test_haplotype_of_the_last_day_only_is_finite():
    x = np.arange(1, 11) / 10
    y = np.zeros((10, 2))
    y[:, 0] = 50
    y[9, 1] = 30
    w, _, score = growth.Country(x, y.sum(axis=1), y.sum(axis=0), x @ y).fit(100, 1e-8)
    assert np.isfinite(w).all() and score < 1e-6 and w[1, 1] > 20


def test_the_operator_takes_rows(spark):
    df = spark.createDataFrame([("X", d, f"h{k}") for d in range(1, 9) for k in range(2) for _ in range(5 + d * k)], "c string, d int, h string")
    table, _, _ = growth.lineage_growth(df, "h0", country="c", day="d", hap="h")
    got = {r.hap_id: r.relative_re for r in table.collect()}
    assert got["h0"] == 1.0 and got["h1"] > 1.1
