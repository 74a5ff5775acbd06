"""Relative growth of haplotypes per country (#82).

Each country is an unpenalised multinomial logistic regression of haplotype on
time (``day_bin / max_bin``).  This is an exponential family: all that its
likelihood needs of the rows is, per country, the rows of each day and, per
haplotype, the number of its rows and the sum of their days.  One pass of
partial aggregates brings any number of rows down to days + 2 x haplotypes
numbers a country, and one job then fits all countries, a country a task:
Newton's method, its steps by conjugate gradients (blocks of days x haplotypes
in memory, never a matrix of all pairs of haplotypes).

The slope of haplotype k relative to the reference haplotype is converted to
a relative effective reproduction number ``exp(slope / max_bin / bin * g)``;
the reference itself is exactly 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineax.session import materialize

COEF_SCHEMA = "country string, class_idx int, intercept double, slope double, iterations int, max_score_per_n double"
#: Cells (days x haplotypes) held at a time.
CELLS = 1 << 21


def daily_counts(df: DataFrame, country: str = "country", day: str = "day_bin", hap: str = "hap_id") -> DataFrame:
    """(country, day_bin, hap_id, n): the only input the fits need."""
    return (df.groupBy(F.col(country).alias("country"), F.col(day).alias("day_bin"), F.col(hap).alias("hap_id"))
            .agg(F.count(F.lit(1)).alias("n")))


def growth_design(counts: DataFrame, ref_hap: str, min_total: int = 20) -> DataFrame:
    """Per-country classes: haplotypes with >= ``min_total`` rows, reference first (index 0).

    A country with such haplotypes but without the reference among them has no
    baseline to fit against, which is an error.
    """
    if ref_hap is None:
        raise ValueError("no reference haplotype: none of the reference clade is present in every country")
    totals = counts.groupBy("country", "hap_id").agg(F.sum("n").alias("total")).where(F.col("total") >= min_total)
    has_ref = totals.groupBy("country").agg(F.bool_or(F.col("hap_id") == ref_hap).alias("has"))
    missing = [r.country for r in has_ref.where(~F.col("has")).orderBy("country").limit(20).collect()]
    if missing:
        raise ValueError(f"the reference haplotype {ref_hap} has fewer than {min_total} rows in {missing}")
    # One row per kept (country, haplotype): bounded by the number of haplotypes per country.
    w = Window.partitionBy("country").orderBy((F.col("hap_id") != ref_hap).cast("int"), F.col("hap_id"))
    classes = totals.select("country", "hap_id", (F.row_number().over(w) - 1).alias("class_idx"))
    return counts.join(classes, ["country", "hap_id"], "inner")


class Country:
    """The likelihood of one country: days ``x`` with ``n`` rows, haplotypes with ``total`` rows and ``moment`` (sum of days).

    Parameters are (haplotypes, 2): level and slope in standardised days; the
    first haplotype's stay 0.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, total: np.ndarray, moment: np.ndarray):
        self.size = n.sum()
        self.mid = (n @ x) / self.size
        self.scale = np.sqrt(n @ (x - self.mid) ** 2 / self.size) or 1.0
        self.x, self.n = (x - self.mid) / self.scale, n
        self.seen = np.stack([total, (moment - self.mid * total) / self.scale], axis=1)
        self.step = max(1, CELLS // len(total))

    def blocks(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(days, their rows, shares, logarithm of the shares' scale) in blocks of days."""
        for lo in range(0, len(self.x), self.step):
            x, n = self.x[lo: lo + self.step], self.n[lo: lo + self.step]
            e = w[:, 0] + x[:, None] * w[:, 1]
            top = e.max(axis=1)
            p = np.exp(e - top[:, None])
            z = p.sum(axis=1)
            yield x, n, p / z[:, None], top + np.log(z)

    def value(self, w: np.ndarray) -> float:
        return float((self.seen * w).sum() - sum(n @ logs for _, n, _, logs in self.blocks(w)))

    def slope_and_curvature(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient, and each haplotype's own 2 x 2 block of the negative Hessian."""
        grad, own = self.seen.copy(), np.zeros((len(w), 3))
        for x, n, p, _ in self.blocks(w):
            grad -= np.stack([n @ p, (n * x) @ p], axis=1)
            q = p * (1 - p)
            own += np.stack([n @ q, (n * x) @ q, (n * x * x) @ q], axis=1)
        grad[0] = 0.0
        return grad, own

    def times(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The negative Hessian times ``v``."""
        out = np.zeros_like(v)
        for x, n, p, _ in self.blocks(w):
            e = v[:, 0] + x[:, None] * v[:, 1]
            e = p * (e - (p * e).sum(axis=1)[:, None])
            out += np.stack([n @ e, (n * x) @ e], axis=1)
        out[0] = 0.0
        return out

    def newton_step(self, w: np.ndarray, grad: np.ndarray, own: np.ndarray, share: float) -> np.ndarray:
        """An approximate solution of Hessian x step = gradient, to ``share`` of the gradient."""
        ridge = 1e-12 * own[:, [0, 2]].max(initial=1e-300)
        det = (own[:, 0] + ridge) * (own[:, 2] + ridge) - own[:, 1] ** 2
        det = np.maximum(det, 1e-300)

        def eased(r: np.ndarray) -> np.ndarray:
            return np.stack([((own[:, 2] + ridge) * r[:, 0] - own[:, 1] * r[:, 1]) / det, ((own[:, 0] + ridge) * r[:, 1] - own[:, 1] * r[:, 0]) / det], axis=1)

        step, r = np.zeros_like(w), grad.copy()
        z = eased(r)
        d, rz, goal = z.copy(), (r * z).sum(), share * np.sqrt((grad**2).sum())
        for _ in range(4 * len(w) + 20):
            h = self.times(w, d)
            curve = (d * h).sum()
            if curve <= 0:
                break
            a = rz / curve
            step += a * d
            r -= a * h
            if np.sqrt((r**2).sum()) <= goal:
                break
            z = eased(r)
            rz, old = (r * z).sum(), rz
            d = z + rz / old * d
        return step if step.any() else z

    def score(self, grad: np.ndarray) -> float:
        """Largest score per row in the likelihood's own days."""
        return float(np.abs(np.stack([grad[:, 0], grad[:, 1] * self.scale + grad[:, 0] * self.mid])).max() / self.size)

    def fit(self, max_iter: int, tol: float) -> tuple[np.ndarray, int, float]:
        """(levels and slopes in the likelihood's own days, Newton steps, largest score per row)."""
        w = np.zeros((len(self.seen), 2))
        w[:, 0] = np.log(self.seen[:, 0] / self.seen[0, 0])
        value, steps = self.value(w), 0
        grad, own = self.slope_and_curvature(w)
        while steps < max_iter and self.score(grad) > tol:
            steps += 1
            step = self.newton_step(w, grad, own, min(0.1, np.sqrt(self.score(grad))))
            rise, t = (grad * step).sum(), 1.0
            while (new := self.value(w + t * step)) < value + 1e-4 * t * rise and t > 1e-6:
                t /= 2
            if t <= 1e-6:  # no rise that doubles can tell
                break
            w, value = w + t * step, new
            grad, own = self.slope_and_curvature(w)
        b = w[:, 1] / self.scale
        return np.stack([w[:, 0] - b * self.mid, b], axis=1), steps, self.score(grad)


def country_sums(design: DataFrame) -> DataFrame:
    """(country, days, classes): rows of each day, rows and day sum of each class; one row per country."""
    days = design.groupBy("country", "day_bin").agg(F.sum("n").alias("n"))
    classes = design.groupBy("country", "class_idx").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("day_bin")).alias("nd"))
    days = days.groupBy("country").agg(F.sort_array(F.collect_list(F.struct("day_bin", "n"))).alias("days"))
    classes = classes.groupBy("country").agg(F.sort_array(F.collect_list(F.struct("class_idx", "n", "nd"))).alias("classes"))
    return days.join(classes.withColumnRenamed("country", "_c"), F.col("country").eqNullSafe(F.col("_c"))).drop("_c")


def fit_growth(design: DataFrame, max_bin: int, max_iter: int = 100, tol: float = 1e-10, max_score: float = 1e-7) -> DataFrame:
    """Coefficients relative to class 0 per country: (country, class_idx, intercept, slope, iterations, max_score_per_n, converged).

    ``converged`` says that the likelihood's score at the fit is at most
    ``max_score`` per row (see ``growth_certificate``), whatever made the
    optimiser stop.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                days, classes = (pa.RecordBatch.from_struct_array(b.column(c)[i].values) for c in ("days", "classes"))
                x, n = days.column("day_bin").to_numpy() / max_bin, days.column("n").to_numpy().astype(float)
                total, moment = classes.column("n").to_numpy().astype(float), classes.column("nd").to_numpy() / max_bin
                w, steps, score = Country(x, n, total, moment).fit(max_iter, tol)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("country")[i].as_py()] * len(w), pa.string()), classes.column("class_idx").cast(pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1]),
                                                  pa.array([steps] * len(w), pa.int32()), pa.array([score] * len(w), pa.float64())],
                                                 names=["country", "class_idx", "intercept", "slope", "iterations", "max_score_per_n"])

    tasks = int(design.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coefs = country_sums(design).repartition(tasks, "country").mapInArrow(run, COEF_SCHEMA)
    return materialize(coefs.withColumn("converged", F.col("max_score_per_n") <= max_score), "growth_coefficients")


def growth_fit(counts: DataFrame, ref_hap: str, max_bin: int, min_total: int = 20, bin_size: int = 1,
               gen_time: float = 2.1, max_iter: int = 100, tol: float = 1e-10):
    """(relative_re per country and haplotype, design, coefficients) from daily counts."""
    design = materialize(growth_design(counts, ref_hap, min_total), "growth_design")
    coefs = fit_growth(design, max_bin, max_iter, tol)
    classes = design.select("country", "hap_id", "class_idx").distinct()
    re = F.when(F.col("class_idx") == 0, F.lit(1.0)).otherwise(
        F.exp(F.col("slope") / F.lit(float(max_bin)) / F.lit(float(bin_size)) * F.lit(gen_time)))
    table = coefs.join(classes, ["country", "class_idx"]).select(
        "country", "hap_id", re.alias("relative_re"), "slope", "intercept", "converged")
    return table, design, coefs


def lineage_growth(
    df: DataFrame,
    ref_hap: str,
    max_bin: int | None = None,
    country: str = "country",
    day: str = "day_bin",
    hap: str = "hap_id",
    min_total: int = 20,
    bin_size: int = 1,
    gen_time: float = 2.1,
    max_iter: int = 100,
    tol: float = 1e-10,
):
    """(table, design, coefficients); the table has country, hap_id, relative_re, slope, intercept, converged of every fitted haplotype.

    ``df`` holds one row per sequence with its country, day bin and haplotype;
    ``max_bin``: the last day bin, if it is known.
    """
    counts = materialize(daily_counts(df, country, day, hap), "daily_counts")
    if max_bin is None:
        max_bin = int(counts.agg(F.max("day_bin")).first()[0] or 0)
    return growth_fit(counts, ref_hap, max_bin, min_total, bin_size, gen_time, max_iter, tol)


def expected_moments(design: DataFrame, coefs: DataFrame, max_bin: int) -> DataFrame:
    """(country, class_idx, n, nx): each class's expected rows and expected sum of x = day_bin / max_bin at the fit.

    Expected counts need every class at every day of a country: emitted once
    with a generator over the per-country coefficient array and summed map-side.
    """
    x = (F.col("day_bin") / F.lit(float(max_bin))).cast("double")
    days = design.groupBy("country", "day_bin").agg(F.sum("n").alias("nt")).withColumn("x", x)
    arr = coefs.groupBy("country").agg(F.collect_list(F.struct("class_idx", "intercept", "slope")).alias("cf"))
    j = days.join(arr, "country")
    cells = F.transform("cf", lambda c: F.struct(c["class_idx"].alias("class_idx"),
                                                 (c["intercept"] + c["slope"] * F.col("x")).alias("e")))
    j = j.withColumn("cells", cells).withColumn("m", F.array_max(F.transform("cells", lambda c: c["e"])))
    j = j.withColumn("z", F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.exp(c["e"] - F.col("m"))))
    expected = j.select("country", "x", "nt", "m", "z", F.inline("cells")).select(
        "country", "class_idx", "x", (F.col("nt") * F.exp(F.col("e") - F.col("m")) / F.col("z")).alias("r"))
    return expected.groupBy("country", "class_idx").agg(F.sum("r").alias("n"), F.sum(F.col("r") * F.col("x")).alias("nx"))


def growth_certificate(design: DataFrame, coefs: DataFrame, max_bin: int) -> DataFrame:
    """Per country the largest |score| / n of the multinomial likelihood at the fitted coefficients.

    At the optimum every class's observed and expected moments are equal.
    """
    x = (F.col("day_bin") / F.lit(float(max_bin))).cast("double")
    observed = design.groupBy("country", "class_idx").agg(F.sum("n").alias("on"), F.sum(F.col("n") * x).alias("onx"))
    score = expected_moments(design, coefs, max_bin).join(observed, ["country", "class_idx"]).select(
        "country", (F.col("on") - F.col("n")).alias("ga"), (F.col("onx") - F.col("nx")).alias("gb"))
    total = design.groupBy("country").agg(F.sum("n").alias("n_total"))
    worst = score.groupBy("country").agg(F.max(F.greatest(F.abs("ga"), F.abs("gb"))).alias("max_score"))
    return worst.join(total, "country").select("country", (F.col("max_score") / F.col("n_total")).alias("max_score_per_n"))
