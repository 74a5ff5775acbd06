"""Operator 13, exact k-means with ns-bounds.

Every round assigns each vector to its nearest centroid and moves centroids to
their vectors' mean.  A vector keeps, for each centroid, the distance of its
last evaluation and that evaluation's round.  All rounds' centroids are
retained (rounds x k x dim numbers), so a stored distance is loosened by the
norm of the centroid's total displacement since that evaluation, which is never
more than the sum of its rounds' drifts.  A centroid whose lower bound exceeds
the upper bound of the vector's own centroid can neither win nor tie; if any
fails that test, first the own distance, then the failures are evaluated
exactly.  Bounds are 32-bit floats with a margin beyond their rounding;
decisions are taken on exact integers only.

Components are integers floor(scale * x).  Means are floored exact quotients:
tasks add up their vectors per cluster, k rows of sums each, and these are
summed as decimals.  The driver holds centroids only, k x dim numbers a round.

A round is one pass over the written state without a shuffle of vectors; a hot
cluster is k rows of sums in every task like any other.

Defined results: rows whose vector is null, has another number of components
than ``dim`` or null or non-finite ones give no row; components saturate where a
squared distance could exceed a 64-bit integer (2 ** 27 for 64 components);
repeated rows are vectors of their own; a null id hashes as the empty string;
first centroids with equal hashes are ordered by their components; with fewer
vectors than ``k`` there are fewer centroids; an empty centroid stays; ties go
to the smaller number; sums beyond a long are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.session import materialize

#: Relative margin of a stored distance: twice the rounding of a 32-bit float.
MARGIN = 2.0**-22
ROWS = 1 << 14


def quantised(col: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer components) of the usable vectors of a list column."""
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(n == dim)
    values = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    x = values[(np.cumsum(n) - n)[at][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1)
    most = math.isqrt((1 << 62) // dim) // 2
    with np.errstate(over="ignore"):
        return at[good], np.clip(np.floor(scale * x[good]), -most, most).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` from ``c``."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass
class State:
    """Vectors with their cluster, squared distance and, for each centroid, the last evaluated distance, its round, and how many were evaluated in all."""

    x: np.ndarray
    cluster: np.ndarray
    distance: np.ndarray
    last: np.ndarray
    seen: np.ndarray
    evaluated: np.ndarray


def first_state(x: np.ndarray, c: np.ndarray) -> State:
    d = np.stack([squared(x, row) for row in c], axis=1)
    cluster = d.argmin(axis=1)  # the first of equal ones
    return State(x, cluster, d[np.arange(len(x)), cluster], np.sqrt(d).astype(np.float32), np.zeros(d.shape, np.int16), np.full(len(x), len(c)))


def next_state(s: State, history: np.ndarray) -> State:
    """The state after assignment to ``history[-1]``; ``distance`` is exact where the own centroid was evaluated (always with ``finish``)."""
    now, k = len(history) - 1, history.shape[1]
    moved = np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(axis=2)) * (1 + MARGIN)  # by round and centroid
    rows = np.arange(len(s.x))
    shift = moved[s.seen, np.arange(k)]
    last = s.last.astype(np.float64)
    low = last * (1 - MARGIN) - shift
    own = s.cluster
    high = last[rows, own] * (1 + MARGIN) + shift[rows, own]
    low[rows, own] = np.inf

    def evaluate(at: np.ndarray, j: int) -> np.ndarray:
        d = squared(s.x[at], history[-1][j])
        s.last[at, j], s.seen[at, j] = np.sqrt(d), now
        s.evaluated[at] += 1
        return d

    doubt = (low <= high[:, None]).any(axis=1)
    best, cluster = s.distance.copy(), own.copy()
    for j in range(k):  # tighten the doubtful rows' own distance
        at = np.flatnonzero(doubt & (own == j))
        if len(at):
            best[at] = evaluate(at, j)
    high[doubt] = np.sqrt(best[doubt].astype(np.float64)) * (1 + MARGIN)
    fails = (low <= high[:, None]) & doubt[:, None]
    for j in range(k):
        at = np.flatnonzero(fails[:, j])
        if len(at):
            d = evaluate(at, j)
            win = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
            best[at[win]], cluster[at[win]] = d[win], j
    return State(s.x, cluster, best, s.last, s.seen, s.evaluated)


def finish(s: State, c: np.ndarray) -> None:
    """Exact distance of every row from its centroid."""
    s.distance = squared(s.x, c[s.cluster])


_SCHEMA = "vec array<int>, cluster int, distance long, last array<float>, seen array<smallint>, evaluated int"


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(m.ravel(), kind))


def _batch(ids: pa.Array, s: State) -> pa.RecordBatch:
    cols = [ids, _lists(s.x, pa.int32()), pa.array(s.cluster, pa.int32()), pa.array(s.distance, pa.int64()), _lists(s.last, pa.float32()), _lists(s.seen, pa.int16()), pa.array(s.evaluated, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "vec", "cluster", "distance", "last", "seen", "evaluated"])


def _state(b: pa.RecordBatch, dim: int, k: int) -> State:
    def numbers(c: str) -> np.ndarray:
        return b.column(c).to_numpy(zero_copy_only=False)

    def matrix(c: str, width: int) -> np.ndarray:
        return b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    return State(matrix("vec", dim).astype(np.int64), numbers("cluster").astype(np.int64), numbers("distance").copy(), matrix("last", k).copy(), matrix("seen", k).copy(), numbers("evaluated").copy())


def seeds(rows: DataFrame, k: int, seed: int, dim: int, scale: float) -> np.ndarray:
    """The first centroids: ``k`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = quantised(b.column("v"), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(at)), _lists(x, pa.int32())], names=["h", "vec"])

    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(name.alias("h"), "v").mapInArrow(run, "h string, vec array<int>").orderBy("h", "vec").limit(k).collect()
    return np.array([r.vec for r in found], dtype=np.int64).reshape(-1, dim)


def means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The next centroids: exact floored means of the clusters' vectors, or the same where a cluster is empty."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), b.column(1).to_numpy(zero_copy_only=False)
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster).tolist():
                total[j] += x[cluster == j].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), _lists(total, pa.int64())], names=["cluster", "n", "total"])

    sums = state.select("vec", "cluster").mapInArrow(run, "cluster long, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
    out = c.copy()
    for r in sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():  # k x dim rows
        if r.n:
            out[r.cluster, r["at"]] = int(r.x) // r.n
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): id_col, cluster, squared distance and n_evaluated (distances computed in all rounds) of every usable vector; the final centroids."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_SCHEMA}"
    c = seeds(rows, k, seed, dim, scale)
    history = c[None]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                at, x = quantised(b.column("v"), dim, scale)
                if len(at):
                    yield _batch(b.column("id").take(pa.array(at)), first_state(x, c))

    state = materialize(rows.mapInArrow(begin, schema), "clusters-0")
    for r in range(1, rounds + 1):
        history = np.concatenate([history, means(state, history[-1])[None]])
        state = materialize(state.mapInArrow(_step(history, r == rounds), schema), f"clusters-{r}")
    return state.select(F.col("id").alias(id_col), "cluster", "distance", F.col("evaluated").alias("n_evaluated")), history[-1]


def _step(history: np.ndarray, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                s = next_state(_state(b, history.shape[2], history.shape[1]), history)
                if last:
                    finish(s, history[-1])
                yield _batch(b.column("id"), s)

    return run


def with_cluster_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with cluster_inertia, inertia and centroid_sha256; what is joined has one row per centroid."""
    spark = rows.sparkSession
    names = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    sums = sums.select(F.col("cluster").alias("_c"), F.expr("try_cast(own as long)").alias("cluster_inertia"), F.expr("try_cast(sum(own) OVER () as long)").alias("inertia"))
    known = sums.join(F.broadcast(spark.createDataFrame(names, "_j int, centroid_sha256 string")), F.col("_c") == F.col("_j")).drop("_j")
    return rows.join(F.broadcast(known), F.col("cluster") == F.col("_c")).drop("_c")
