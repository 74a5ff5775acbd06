"""Operator 7, embedding near-duplicates by collision-counting projections.

Each of ``lists`` lists gives a vector a cell code (signs of ``bits`` random
projections) and a position (one further projection).  Two vectors collide in
a list when their codes are equal and the other's position lies in the window
of half-width ``window`` around the one's.  Pairs that
collide in at least ``least`` lists are verified by their cosine in double
precision, so no link below the threshold is returned.

Calibration.  A pair at the threshold has angle t; it collides in a list with
probability p = (1 - t / pi) ** bits * P(|N(0, 1)| <= window / d), d = 2 sin(t / 2).
``lists`` is the smallest number that makes P(Binomial(lists, p) >= least) at
least ``recall``.  ``bits`` grows with log2 of the number of vectors, so a
list's cells keep the same mean size and collisions grow about as the input.

Nothing is sorted by position: windows are found by an equi-join on grid cells,
position / window, equal or neighbouring ones, with the pairs a sort would give.

Equal vectors (after scaling) are one class: they are never paired, a link
between classes counts as many links as the other class has vectors.

Defined results: null or zero vectors, or with null or non-finite components,
link with nothing; vectors of different length never link; rows with one id
are vectors of their own; ties go to the smallest id; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.llm import kernel as K
from lineax.llm.common import connected_components
from lineax.session import materialize

U = np.uint64


def calibrated(n: int, threshold: float, recall: float = 0.995, least: int = 2, cell: int = 8) -> tuple[int, float, int]:
    """(bits, window, lists) for ``n`` vectors."""
    t = math.acos(threshold)
    d = 2 * math.sin(t / 2)
    window = 2 * d
    bits = max(0, round(math.log2(max(n, 1) / cell)))
    p = (1 - t / math.pi) ** bits * math.erf(window / d / math.sqrt(2))
    lists = least
    while sum(math.comb(lists, j) * p**j * (1 - p) ** (lists - j) for j in range(least)) > 1 - recall:
        lists += 1
    return bits, window, lists


def _rows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) of usable vectors, by length."""
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    off = np.cumsum(n) - n
    for size in np.unique(n[n > 0]):
        at = np.flatnonzero(n == size)
        m = values[off[at][:, None] + np.arange(size)]
        with np.errstate(all="ignore"):
            scale = np.abs(m).max(axis=1)
            good = np.isfinite(scale) & (scale > 0)
        yield at[good], m[good] / scale[good][:, None]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def vector_classes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, cls, unit) of every row; cls and unit are null for unusable vectors."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, unit = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            known = np.zeros(b.num_rows, dtype=bool)
            for at, m in _rows(b.column(1)):
                u = _unit(m) + 0.0  # no negative zeros
                raw = np.ascontiguousarray(u).view(U)
                with np.errstate(over="ignore"):
                    weight = K.mix(np.arange(1, u.shape[1] + 1, dtype=U), 47) | U(1)
                    cls[at] = K.mix((K.mix(raw, 53) * weight).sum(axis=1, dtype=U), u.shape[1]).view(np.int64)
                known[at] = True
                for i, row in zip(at.tolist(), u, strict=True):
                    unit[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, mask=~known), pa.array(unit, pa.list_(pa.float64()))], names=["id", "cls", "unit"])

    return df.select(id_col, vec_col).mapInArrow(run, f"id {id_type}, cls long, unit array<double>")


def collisions(classes: DataFrame, bits: int, window: float, lists: int, seed: int) -> DataFrame:
    """(a, b) of class pairs, once for each list in which they collide."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            cls = b.column(0).to_numpy()
            for at, m in _rows(b.column(1)):
                dim = m.shape[1]
                if dim not in made:
                    made[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, lists * (bits + 1)))
                for a in range(0, len(at), 1024):
                    part = at[a: a + 1024]
                    x = (_unit(m[a: a + 1024]) @ made[dim]).reshape(len(part), lists, bits + 1)
                    code = ((x[:, :, 1:] > 0).astype(U) << np.arange(bits, dtype=U)).sum(axis=2, dtype=U)
                    with np.errstate(over="ignore"):
                        name = K.mix(code + K.mix(np.arange(lists, dtype=U) + U(dim << 20), 59)[None, :], 61)
                    cell = np.floor(x[:, :, 0] / window)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[part], lists)), K.to_long(name.ravel()), pa.array(cell.ravel().astype(np.int32)), pa.array(x[:, :, 0].ravel().astype(np.float32))], names=["cls", "bucket", "cell", "at"])

    rows = classes.select("cls", "unit").mapInArrow(run, "cls long, bucket long, cell int, at float")
    x = rows.select(F.col("cls").alias("a"), "bucket", "cell", F.col("at").alias("at_a"))
    y = rows.select(F.col("cls").alias("b"), "bucket", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), F.col("cell").alias("own"), F.col("at").alias("at_b"))
    near = x.join(y, ["bucket", "cell"]).where(((F.col("own") > F.col("cell")) | (F.col("a") < F.col("b"))) & (F.abs(F.col("at_a") - F.col("at_b")) <= window))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose cosine is at least ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                n = b.column(2).value_lengths().to_numpy()
                same = n == b.column(3).value_lengths().to_numpy()
                good = np.zeros(b.num_rows, dtype=bool)
                for size in np.unique(n[same]):
                    at = pa.array(np.flatnonzero(same & (n == size)))
                    u, v = (b.column(c).take(at).flatten().to_numpy().reshape(-1, size) for c in (2, 3))
                    good[at.to_numpy()] = np.einsum("ij,ij->i", u, v) >= threshold
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    one = classes.select(F.col("cls").alias("a"), F.col("unit").alias("u"))
    two = classes.select(F.col("cls").alias("b"), F.col("unit").alias("v"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def vector_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995, least: int = 2, seed: int = 17) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    rows = materialize(vector_classes(df, id_col, vec_col), "vectors")
    usable = rows.where("cls is not null")
    sizes = usable.groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    classes = materialize(usable.dropDuplicates(["cls"]).select("cls", "unit"), "classes")
    bits, window, lists = calibrated(classes.count(), threshold, recall, least)
    pairs = collisions(classes, bits, window, lists, seed).groupBy("a", "b").count().where(F.col("count") >= least).select("a", "b")
    links = materialize(verified(pairs, classes, threshold), "links")
    ends = links.union(links.select("b", "a"))
    others = ends.join(sizes.select(F.col("cls").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("linked"))
    labels = connected_components(links)
    named = sizes.join(labels, sizes.cls == labels.node, "left").select("cls", "size", "first", F.coalesce("component", "cls").alias("component"))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per = named.join(least_id, "component").join(others, named.cls == others.a, "left").select(F.col("cls").alias("_c"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "cls").join(materialize(per, "named"), F.col("cls") == F.col("_c"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
