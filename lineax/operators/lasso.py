"""L1 least squares from per-fold sufficient statistics.

One pass over the rows adds up, for each fold, the products of all pairs among
(1, features, outcome).  A training set is the sum of the other folds' tables,
so every fit of a search (draws x folds) works on one small matrix: coordinate
descent on the centred Gram matrix, each fit warm-started from the one with the
next larger penalty.  Test scores come from the held-out fold's table too.  The
driver holds folds x (features + 2) ** 2 numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.operators.trees import fold_of


def fold_products(train: DataFrame, features: str, label: str, folds: int, seed: int) -> np.ndarray:
    """(folds, features + 2, features + 2): sums of products of (1, features, outcome) in each fold."""
    rows = train.select(fold_of(features, label, folds, seed).alias("fold"), F.concat(F.array(F.lit(1.0)), vector_to_array(features), F.array(F.col(label).cast("double"))).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            fold, z = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                total[f] = total.get(f, 0.0) + part.T @ part
        for f, m in total.items():
            off = np.arange(len(m) + 1, dtype=np.int32) * len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), f), pa.int32()), pa.array(np.arange(len(m)), pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(m.ravel()))], names=["fold", "i", "x"])

    cells = rows.mapInArrow(run, "fold int, i int, x array<double>").select("fold", "i", F.posexplode("x").alias("j", "x"))
    sums = cells.where("i <= j").groupBy("fold", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    fold, i, j, x = (c.to_numpy() for c in sums.columns)
    width = int(j.max(initial=1)) + 1
    out = np.zeros((folds, width, width))
    out[fold, i, j] = out[fold, j, i] = x
    return out


def descend(z: np.ndarray, alpha: float, max_iter: int, tol: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise half the mean squared error plus ``alpha`` times the coefficients' absolute sum.

    Sweeps end when no coefficient moved by more than ``tol`` of the largest
    and the duality gap is at most ``tol`` of the outcome's variation.
    """
    n = z[0, 0]
    mean, top = z[0, 1:-1] / n, z[0, -1] / n
    gram = z[1:-1, 1:-1] / n - np.outer(mean, mean)
    c = z[1:-1, -1] / n - mean * top
    spread = z[-1, -1] / n - top * top
    w = np.zeros(len(c)) if start is None else start.copy()
    q = gram @ w
    own = gram.diagonal().copy()
    free = np.flatnonzero(own > 1e-12)
    w[own <= 1e-12] = 0.0
    for _ in range(max_iter):
        moved = 0.0
        for j in free:
            rho = c[j] - q[j] + own[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / own[j]
            if new != w[j]:
                q += gram[j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tol * np.abs(w).max(initial=0.0):
            rest = spread - 2 * (w @ c) + w @ q
            steep = np.abs(c - q).max(initial=0.0)
            scale = min(1.0, alpha / steep) if steep > 0 else 1.0
            gap = 0.5 * rest * (1 + scale * scale) + alpha * np.abs(w).sum() - scale * (spread - w @ c)
            if gap <= tol * spread:
                break
    return w, float(top - mean @ w)


def r2(z: np.ndarray, w: np.ndarray, b: float) -> float:
    """R2 of a fit on the rows that the table ``z`` was added up from."""
    v = np.concatenate([[b], w, [-1.0]])
    spread = z[-1, -1] - z[0, -1] ** 2 / z[0, 0] if z[0, 0] else 0.0
    return float(1 - v @ z @ v / spread) if spread > 0 else 0.0


@dataclass
class LinearFit:
    coefficients: DenseVector
    intercept: float
    features: str
    out: str = "predicted_outcome"

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(x)) for x in self.coefficients])
        products = F.zip_with(vector_to_array(self.features), weights, lambda a, b: a * b)
        return df.withColumn(self.out, F.aggregate(products, F.lit(self.intercept), lambda acc, x: acc + x))


def search(train: DataFrame, features: str, label: str, draws: list[dict], folds: int, seed: int) -> tuple[LinearFit, float]:
    """(the fit of the best draw on all rows, its mean R2 over folds); draws hold alpha, max_iter and tol."""
    tables = fold_products(train, features, label, folds, seed)
    whole = tables.sum(axis=0)
    order = sorted(range(len(draws)), key=lambda d: -draws[d]["alpha"])
    scores = np.zeros((len(draws), folds))
    for f in range(folds):
        w = None
        for d in order:
            w, b = descend(whole - tables[f], start=w, **draws[d])
            scores[d, f] = r2(tables[f], w, b)
    best = int(scores.mean(axis=1).argmax())
    w, b = descend(whole, **draws[best])
    return LinearFit(Vectors.dense(w), b, features), float(scores[best].mean())
