"""Histogram trees on binned features: boosted leaf by leaf, or forests grown level by level.

Features are binned once to bytes, and rows that agree in all bins and in their
fold are one *pattern* with the number of rows and the sum of outcomes: trees
split on bins and squared error needs no more.  A model is a generator: it asks
for the sums of some nodes (weight and outcome, in all and beyond every cut),
is sent these sums, and goes on; a node's sibling is got by subtraction.  Who
computes the sums is not its business:

* ``Spark`` sends the requests of **all** models (draws x folds) together, one
  aggregate over the patterns a step, partial sums in every task;
* when the patterns fit a checked number of cells, each model runs in a task of
  its own on all patterns, since a step of Spark would cost more than the sums.

Both give the same trees (tested).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineax.session import materialize

MAX_CUTS = 254


# ------------------------------------------------------------------ bins and patterns
@dataclass
class Bins:
    """Cuts of each feature: a value's bin is the number of cuts below it."""

    cuts: list[np.ndarray]

    @property
    def offset(self) -> np.ndarray:
        """First column of each feature among all cuts."""
        return np.concatenate([[0], np.cumsum([len(c) for c in self.cuts])])

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cuts)), [len(c) for c in self.cuts])

    def codes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, dtype=np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, values[:, f], side="left")
        return out

    def beyond(self, codes: np.ndarray) -> np.ndarray:
        """For each row and cut of each feature, whether the row lies beyond it."""
        owner = self.owner
        return codes[:, owner] > (np.arange(len(owner)) - self.offset[owner])[None, :]


def find_bins(df: DataFrame, features: str) -> Bins:
    """Cuts half-way between neighbours among each feature's least, largest and ``MAX_CUTS`` quantile values."""
    values = df.select(F.posexplode(vector_to_array(features)).alias("f", "x"))
    shares = F.array([F.lit((i + 1) / MAX_CUTS) for i in range(MAX_CUTS - 1)])
    found = values.groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", shares, 1000).alias("q")).orderBy("f").collect()  # a row per feature
    points = [np.unique([r.lo, r.hi, *r.q]) for r in found]
    return Bins([(p[1:] + p[:-1]) / 2 for p in points])


def _matrix(col: pa.Array, kind) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1).astype(kind, copy=False) if len(col) else np.zeros((0, 0), kind)


def _row_bytes(codes: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])


def with_codes(df: DataFrame, bins: Bins, features: str, keep: Sequence[str], out: str = "codes") -> DataFrame:
    """``keep`` columns and the row's bins as bytes."""
    rows = df.select(*keep, vector_to_array(features).alias("_x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{out}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = bins.codes(_matrix(b.column(b.num_columns - 1), np.float64)) if b.num_rows else np.zeros((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _row_bytes(codes)], names=[*keep, out])

    return rows.mapInArrow(run, schema)


def fold_of(features: str, label: str, folds: int, seed: int) -> F.Column:
    """A row's fold by a hash of its content: the same however the rows are partitioned."""
    return F.pmod(F.xxhash64(vector_to_array(features), F.col(label), F.lit(seed)), F.lit(folds)).cast("int")


def pattern_table(train: DataFrame, bins: Bins, features: str, label: str, folds: int, seed: int) -> DataFrame:
    """(codes, fold, n, y, yy): rows with equal bins and fold, their number, sum of outcomes and of squares. Written once."""
    rows = train.select(F.col(features).alias("features"), F.col(label).cast("double").alias("y")).withColumn("fold", fold_of("features", "y", folds, seed))
    coded = with_codes(rows, bins, "features", ["y", "fold"])
    return materialize(coded.groupBy("codes", "fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy")), "patterns")


@dataclass
class Patterns:
    """A batch of patterns in arrays; ``key`` names each for its bootstrap draws."""

    codes: np.ndarray
    fold: np.ndarray
    n: np.ndarray
    y: np.ndarray
    yy: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch, width: int) -> Patterns:
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, width)
        fold, n, y, yy = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "n", "y", "yy"))
        weight = _mixed(np.arange(1, width + 2, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            key = _mixed((codes.astype(np.uint64) * weight[:-1]).sum(axis=1, dtype=np.uint64) + fold.astype(np.uint64) * weight[-1])
        return cls(codes, fold, n, y, yy, key)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def bootstrap(n: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """How often each pattern of ``n`` rows is drawn: Poisson(n) from a hash (normal beyond 50 rows)."""
    with np.errstate(over="ignore"):
        u = (_mixed(key + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    out = np.zeros(len(n))
    few = n <= 50
    term = np.exp(-n)
    total = term.copy()
    for k in range(1, 130):
        more = few & (u >= total)
        if not more.any():
            break
        out[more] = k
        term = term * n / k
        total = total + term
    if not few.all():
        from statistics import NormalDist
        z = np.array([NormalDist().inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in u[~few]])
        out[~few] = np.maximum(0, np.round(n[~few] + np.sqrt(n[~few]) * z))
    return out


# ------------------------------------------------------------------ trees
@dataclass
class Tree:
    """Nodes in arrays; a node without feature is a leaf, rows beyond the cut go right."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.feature), len(self.feature) + 1
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(0.0)
        return self.left[node], self.right[node]

    def step(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows one level further down."""
        feature = np.array(self.feature)[node]
        inner = np.flatnonzero(feature >= 0)
        out, at = node.copy(), node[inner]
        right = codes[inner, feature[inner]] > np.array(self.cut)[at]
        out[inner] = np.where(right, np.array(self.right)[at], np.array(self.left)[at])
        return out

    def descend(self, codes: np.ndarray, node: np.ndarray, first_new: int) -> None:
        """Move rows in place to the nodes from ``first_new`` on, whose parents held them."""
        if len(self.feature) - first_new > 2:
            node[:] = self.step(codes, node)
        elif len(self.feature) > first_new:
            parent = self.left.index(first_new)
            at = np.flatnonzero(node == parent)
            node[at] = first_new + (codes[at, self.feature[parent]] > self.cut[parent])

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Each row's leaf. A right child follows its left one and a leaf leads to itself, so a level is a few lookups."""
        feature, levels = np.array(self.feature), [0] * len(self.feature)
        inner = feature >= 0
        down = np.where(inner, self.left, np.arange(len(feature)))
        cut = np.where(inner, self.cut, MAX_CUTS + 1)  # beyond any code
        for n in np.flatnonzero(inner).tolist():
            levels[self.left[n]] = levels[self.right[n]] = levels[n] + 1
        flat, row = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        node = np.zeros(len(codes), dtype=np.int64)
        feature[~inner] = 0
        for _ in range(max(levels)):
            node = down[node] + (flat[row + feature[node]] > cut[node])
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]


@dataclass
class Model:
    """What the sums of a model are of: all patterns but those of fold ``out``; a model's state is its finished trees and the one that grows."""

    params: dict
    out: int = -1
    boosted: bool = True
    base: float = 0.0
    done: list[Tree] = field(default_factory=list)
    tree: Tree = field(default_factory=Tree)

    def weight(self, p: Patterns) -> np.ndarray:
        w = np.where(p.fold == self.out, 0.0, p.n)
        if not self.boosted and self.params["bootstrap"]:
            w = np.where(w > 0, bootstrap(p.n, p.key, self.params["seed"] * 100_003 + len(self.done)), 0.0)
        return w



Request = list[int]
Steps = Generator[Request, np.ndarray, None]


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weight, sum, weights beyond each cut, sums beyond each cut) of rows of sums."""
    columns = (x.shape[1] - 2) // 2
    return x[:, :1], x[:, 1:2], x[:, 2: 2 + columns], x[:, 2 + columns:]


def best_cuts(x: np.ndarray, gain_of: Callable, least: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(gain, column) of each node's best cut that leaves ``least`` weight on both sides; gain is -inf where none gains. Equal gains: the first column."""
    w, s, right_w, right_s = _parts(x)
    if not right_w.shape[1]:
        return np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
    left_w = w - right_w
    good = np.minimum(left_w, right_w) >= least
    if allowed is not None:
        good &= allowed
    gain = np.where(good, gain_of(right_w, right_s) + gain_of(left_w, s - right_s) - gain_of(w, s), -np.inf)
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(x)), at]
    return np.where(top > 1e-12 * np.maximum(1.0, np.abs(s[:, 0])), top, -np.inf), at


def _algorithm(m: Model) -> Callable[[Model, Bins, bool], Steps]:
    return boost if m.boosted else grow_forest


def boost(m: Model, bins: Bins, eager: bool) -> Steps:
    """Boosting of ``rounds`` trees of at most ``leaves`` leaves, the leaf of the largest gain split next.

    eager: ask for the children of all open leaves at a time, so that a tree takes about as many requests as it has levels.
    """
    p, offset, owner = m.params, bins.offset, bins.owner
    alpha, lam = p["reg_alpha"], p["reg_lambda"]
    least = max(p["min_child_samples"], p["min_child_weight"], 1e-9)

    def shrunk(s):
        return s - np.maximum(np.minimum(s, alpha), -alpha) if alpha else s

    def gain_of(w, s):
        return shrunk(s) ** 2 / np.maximum(w + lam, 1e-300)

    x = (yield [0])[0]
    m.base = float(x[1] / x[0]) if x[0] else 0.0
    for _ in range(p["rounds"]):
        m.tree = tree = Tree()
        known, depth, planned = {0: (yield [0])[0]}, {0: 0}, {}
        heap: list[tuple[float, int, int]] = []

        def offer(nodes: list[int]) -> None:
            x = np.stack([known[n] for n in nodes])  # noqa: B023
            gain, column = best_cuts(x, gain_of, least)
            value = shrunk(x[:, 1]) / np.maximum(x[:, 0] + lam, 1e-300) * p["learning_rate"]
            for i, n in enumerate(nodes):
                tree.value[n] = float(value[i])  # noqa: B023
                if gain[i] > 0 and depth[n] < p["max_depth"]:  # noqa: B023
                    heapq.heappush(heap, (-float(gain[i]), n, int(column[i])))  # noqa: B023

        offer([0])
        leaves = 1
        while heap and leaves < p["leaves"]:
            _, node, column = heapq.heappop(heap)
            if node not in planned:
                wanted = [(node, column)] + ([(n, c) for _, n, c in heap if n not in planned] if eager else [])
                smaller = []
                for n, c in wanted:
                    planned[n] = a, b = tree.split(n, int(owner[c]), int(c - offset[owner[c]]))
                    depth[a] = depth[b] = depth[n] + 1
                    smaller.append(b if 2 * known[n][2 + c] <= known[n][0] else a)
                for (n, _), have, x in zip(wanted, smaller, (yield smaller), strict=True):
                    a, b = planned[n]
                    known[have], known[b if have == a else a] = x, known[n] - x
            leaves += 1
            offer(list(planned[node]))
        left = {n for _, n, _ in heap}
        m.done.append(_pruned(tree, set(planned) - left) if left & set(planned) else tree)


def _pruned(tree: Tree, inner: set[int]) -> Tree:
    """``tree`` with only the splits of ``inner``."""
    out, todo = Tree(), [(0, 0)]
    out.value[0] = tree.value[0]
    while todo:
        old, new = todo.pop()
        if old in inner:
            for a, b in zip((tree.left[old], tree.right[old]), out.split(new, tree.feature[old], tree.cut[old]), strict=True):
                out.value[b] = tree.value[a]
                todo.append((a, b))
    return out


def grow_forest(m: Model, bins: Bins, eager: bool = True) -> Steps:
    """``trees`` trees, level by level; each node chooses among ``per_node`` random features (seeded by tree)."""
    p, offset, owner = m.params, bins.offset, bins.owner
    width = len(bins.cuts)

    def gain_of(w, s):
        return s * s / np.maximum(w, 1e-300)

    for t in range(p["trees"]):
        m.tree = tree = Tree()
        rng = np.random.default_rng([p["seed"], t])
        nodes, depth = [0], 0
        x = yield [0]
        while nodes:
            for n, v in zip(nodes, (x[:, 1] / np.maximum(x[:, 0], 1e-300)).tolist(), strict=True):
                tree.value[n] = v
            allowed = None
            if p["per_node"] < width:
                keys = rng.random((len(nodes), width))
                allowed = (keys <= np.partition(keys, p["per_node"] - 1, axis=1)[:, p["per_node"] - 1: p["per_node"]])[:, owner]
            gain, column = best_cuts(x, gain_of, p["min_samples_leaf"], allowed)
            go = np.flatnonzero((gain > 0) & (x[:, 0] >= p["min_samples_split"]) & (depth < p["max_depth"]))
            if not len(go):
                break
            c, parents = column[go], x[go]
            kids = np.array([tree.split(nodes[i], int(owner[k]), int(k - offset[owner[k]])) for i, k in zip(go, c, strict=True)])
            second = 2 * parents[np.arange(len(go)), 2 + c] <= parents[:, 0]
            found = yield np.where(second, kids[:, 1], kids[:, 0]).tolist()
            nodes = kids.ravel().tolist()
            x = np.stack([np.where(second[:, None], parents - found, found), np.where(second[:, None], found, parents - found)], axis=1).reshape(len(nodes), -1)
            depth += 1
        m.done.append(tree)


# ------------------------------------------------------------------ sums
def node_sums(node: np.ndarray, w: np.ndarray, s: np.ndarray, beyond: np.ndarray, nodes: Request) -> np.ndarray:
    """For each requested node over a batch of patterns: weight, sum, weights and sums beyond each cut."""
    columns = beyond.shape[1]
    out = np.zeros((len(nodes), 2 + 2 * columns))
    if len(nodes) == 1:
        at = np.flatnonzero((node == nodes[0]) & (w > 0))
        both = np.stack([w[at], s[at]])
        out[0, :2] = both.sum(axis=1)
        out[0, 2:] = (both @ beyond[at]).ravel()
        return out
    place = np.full(max(int(node.max(initial=0)), max(nodes)) + 1, -1)
    place[nodes] = np.arange(len(nodes))
    slot = np.where(w > 0, place[node], -1)
    at = np.flatnonzero(slot >= 0)
    at = at[np.argsort(slot[at], kind="stable")]
    slot = slot[at]
    some, first = np.unique(slot, return_index=True)
    if len(some):
        rows = beyond[at]
        for k, x in enumerate((w[at], s[at])):
            out[some, k] = np.add.reduceat(x, first)
            out[some, 2 + k * columns: 2 + (k + 1) * columns] = np.add.reduceat(rows * x[:, None], first, axis=0)
    return out


def _targets(m: Model, p: Patterns, so_far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(weight, weighted sum of what the model's next tree is to explain) of each pattern."""
    w = m.weight(p)
    y = p.y - p.n * (m.base + so_far) if m.boosted else p.y
    return w, w / np.maximum(p.n, 1e-300) * y


def run_here(m: Model, bins: Bins, p: Patterns, beyond: np.ndarray) -> np.ndarray:
    """Fit ``m`` on patterns held in memory; returns its prediction of each pattern."""
    total, applied = np.zeros(len(p.n)), 0  # every split is followed by a request, so a finished tree's rows stand in its leaves
    steps = _algorithm(m)(m, bins, False)
    request, tree, node, size, w, s = next(steps, None), None, None, 1, None, None
    while request is not None:
        if m.tree is not tree:  # another tree begins
            if len(m.done) > applied:
                total += np.array(tree.value)[node]
            tree, node, applied = m.tree, np.zeros(len(p.n), dtype=np.int64), len(m.done)
            w, s = _targets(m, p, total)
        else:
            tree.descend(p.codes, node, size)
        size = len(tree.feature)
        try:
            request = steps.send(node_sums(node, w, s, beyond, request))
        except StopIteration:
            break
    if len(m.done) > applied:
        total += np.array(tree.value)[node]
    return m.base + total if m.boosted else total / max(len(m.done), 1)


def run_on_spark(models: list[Model], bins: Bins, patterns: DataFrame, refresh: int = 25) -> None:
    """Fit all ``models`` in lockstep: a step is one aggregate over the patterns, for all of them.

    Finished trees' predictions are written beside the patterns every
    ``refresh`` trees (boosting only), so a step applies that many at most.
    """
    width = len(bins.cuts)
    rows = patterns.select("codes", "fold", "n", "y", "yy", F.array().cast("array<double>").alias("sofar"))
    steps = [_algorithm(m)(m, bins, True) for m in models]
    open_requests = {i: r for i, s in enumerate(steps) if (r := next(s, None)) is not None}
    written = [0] * len(models)
    while open_requests:
        if all(m.boosted for m in models) and max(len(m.done) - w for m, w in zip(models, written, strict=True)) >= refresh:
            rows = materialize(_with_predictions(rows, models, written, width), "boosted")
            written = [len(m.done) for m in models]
        for i, answer in _step_sums(rows, models, open_requests, written, bins).items():
            try:
                open_requests[i] = steps[i].send(answer)
            except StopIteration:
                del open_requests[i]


def _so_far(b: pa.RecordBatch, p: Patterns, models: list[Model], written: list[int], which: Sequence[int]) -> np.ndarray:
    """(models, patterns): sums of finished trees."""
    out = np.zeros((len(models), len(p.n)))
    held = _matrix(b.column("sofar"), np.float64)
    if held.size:
        out += held.T
    for i in which:
        for tree in models[i].done[written[i]:]:
            out[i] += tree.predict(p.codes)
    return out


def _with_predictions(rows: DataFrame, models: list[Model], written: list[int], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = _so_far(b, Patterns.of(b, width), models, written, range(len(models)))
            off = np.arange(b.num_rows + 1, dtype=np.int32) * len(models)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(pa.array(off), pa.array(total.T.ravel()))], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _step_sums(rows: DataFrame, models: list[Model], requests: dict[int, Request], written: list[int], bins: Bins) -> dict[int, np.ndarray]:
    """The requested sums of all models: (model, node) rows of partial sums from every task, added up by Spark."""
    width, size = len(bins.cuts), 2 + 2 * len(bins.owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((len(nodes), size)) for i, nodes in requests.items()}
        for b in batches:
            if b.num_rows:
                p = Patterns.of(b, width)
                beyond = bins.beyond(p.codes).astype(np.float64)
                so_far = _so_far(b, p, models, written, [i for i in requests if models[i].boosted])
                for i, nodes in requests.items():
                    w, s = _targets(models[i], p, so_far[i])
                    total[i] += node_sums(models[i].tree.leaves(p.codes), w, s, beyond, nodes)
        for i, x in total.items():
            off = np.arange(len(x) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i), pa.int32()), pa.array(np.arange(len(x)), pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], names=["model", "place", "x"])

    parts = rows.mapInArrow(run, "model int, place int, x array<double>").select("model", "place", F.posexplode("x").alias("at", "x"))
    cells = parts.groupBy("model", "place", "at").agg(F.sum("x").alias("x"))
    out = {i: np.zeros((len(nodes), size)) for i, nodes in requests.items()}
    for r in cells.groupBy("model", "place").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("c")).select("model", "place", "c.x").collect():
        out[r.model][r.place] = r.x
    return out


# ------------------------------------------------------------------ fitting and search
def local_patterns(patterns: DataFrame, bins: Bins, max_cells: int) -> Patterns | None:
    """All patterns in arrays when rows x cuts are at most ``max_cells`` (counted first), else None."""
    if patterns.count() * max(len(bins.owner), 1) > max_cells:
        return None
    table = patterns.orderBy("codes", "fold").toArrow().combine_chunks()
    batches = table.to_batches()
    return Patterns.of(batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema), len(bins.cuts))


def _score(y: float, yy: float, n: float, sse: float) -> float:
    spread = yy - y * y / n if n else 0.0
    return 1 - sse / spread if spread > 0 else 0.0


def search(spark: SparkSession, patterns: DataFrame, bins: Bins, draws: list[dict], folds: int, boosted: bool, max_cells: int) -> tuple[Model, float]:
    """(the model of the best draw on all patterns, its mean R2 over folds)."""
    jobs = [(d, f) for d in range(len(draws)) for f in range(folds)]
    held = local_patterns(patterns, bins, max_cells)
    if held is not None:
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            beyond = bins.beyond(p.codes).astype(np.float64)
            for b in batches:
                out = []
                for i in b.column(0).to_pylist():
                    d, f = jobs[i]
                    guess = run_here(Model(draws[d], f, boosted), bins, p, beyond)
                    t = p.fold == f
                    sse = float((p.yy[t] - 2 * guess[t] * p.y[t] + p.n[t] * guess[t] ** 2).sum())
                    out.append(_score(float(p.y[t].sum()), float(p.yy[t].sum()), float(p.n[t].sum()), sse))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["id", "r2"])

        scores = dict(spark.range(0, len(jobs), 1, max(1, len(jobs))).mapInArrow(run, "id long, r2 double").collect())
        r2 = [np.mean([scores[d * folds + f] for f in range(folds)]) for d in range(len(draws))]
    else:
        models = [Model(draws[d], f, boosted) for d, f in jobs]
        run_on_spark(models, bins, patterns)
        r2 = _scores_on_spark(models, bins, patterns, folds)
    best = max(range(len(draws)), key=lambda d: r2[d])
    final = Model(draws[best], -1, boosted)
    if held is not None:
        run_here(final, bins, held, bins.beyond(held.codes).astype(np.float64))
    else:
        run_on_spark([final], bins, patterns)
    return final, float(r2[best])


def _scores_on_spark(models: list[Model], bins: Bins, patterns: DataFrame, folds: int) -> list[float]:
    width = len(bins.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Patterns.of(b, width)
            rows = []
            for i, m in enumerate(models):
                t = np.flatnonzero(p.fold == m.out)
                g = predictions(m, p.codes[t])
                rows.append((i, *(float(x.sum()) for x in (p.n[t], p.y[t], p.yy[t], p.yy[t] - 2 * g * p.y[t] + p.n[t] * g * g))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["i", "n", "y", "yy", "sse"])

    sums = patterns.mapInArrow(run, "i long, n double, y double, yy double, sse double").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "sse")])
    by = {r.i: _score(r.y, r.yy, r.n, r.sse) for r in sums.collect()}
    return [float(np.mean([by[d * folds + f] for f in range(folds)])) for d in range(len(models) // folds)]


def predictions(m: Model, codes: np.ndarray) -> np.ndarray:
    """Of each row; rows of equal codes go through the trees once."""
    if not codes.size:
        return _summed(m, codes)
    _, first, place = np.unique(np.ascontiguousarray(codes).view(f"V{codes.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return _summed(m, codes[first])[place]


def _summed(m: Model, codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for tree in m.done:
        total += tree.predict(codes)
    return m.base + total if m.boosted else total / max(len(m.done), 1)


@dataclass
class TreeModel:
    """A fitted model with its bins, for ``transform``."""

    model: Model
    bins: Bins
    features: str
    out: str = "predicted_outcome"

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.model, self.bins))  # bounded by the search's parameters

        @F.pandas_udf("double")
        def guess(x: pd.Series) -> pd.Series:
            model, bins = shared.value
            return pd.Series(predictions(model, bins.codes(np.stack(x.tolist()))) if len(x) else [], dtype="float64")

        return df.withColumn(self.out, guess(vector_to_array(self.features)))
