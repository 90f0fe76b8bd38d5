"""Fidelity of whole tables: correlation structure, kernel and energy distances, outliers."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tabassay.operators import kernels, knn
from tabassay.operators.caster import complete, quoted
from tabassay.operators.frames import cumulative, long_numbers, stacked, value_counts
from tabassay.operators.marginal import BINS, TINY, binned, quartiles
from tabassay.operators.pairs import sampled
from tabassay.plans.storage import checkpointed

SAMPLE, HEURISTIC = 2000, 500
# Weights of the combined scores.
CORRELATION_WEIGHTS = {"frobenius": 0.4, "spectral": 0.3, "rv": 0.3}
OUTLIER_WEIGHTS = {"range": 0.3, "outliers": 0.4, "density": 0.3}


def correlation_tables(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both Pearson matrices from one aggregate; undefined entries are 0."""
    columns = sorted(columns)
    pairs = list(combinations(range(len(columns)), 2))
    rows = stacked(real, synth, columns).groupBy("is_real").agg(*[F.corr(quoted(columns[i]), quoted(columns[j])).alias(f"v{k}") for k, (i, j) in enumerate(pairs)]).collect()
    out = {True: np.eye(len(columns)), False: np.eye(len(columns))}
    for r in rows:
        for k, (i, j) in enumerate(pairs):
            v = r[f"v{k}"]
            out[r["is_real"]][i, j] = out[r["is_real"]][j, i] = 0.0 if v is None or np.isnan(v) else v
    return out[True], out[False]


def correlation_matrix(real: DataFrame, synth: DataFrame, columns: Sequence[str], method: str = "combined") -> dict[str, float]:
    if len(columns) < 2:
        raise ValueError("two numeric columns are needed")
    a, b = correlation_tables(real, synth, columns)
    unit = lambda v: float(min(max(v, 0.0), 1.0))
    bare_a, bare_b = a - np.eye(len(a)), b - np.eye(len(b))
    size = (bare_a**2).sum() * (bare_b**2).sum()
    parts = {
        "frobenius": unit(1 - np.linalg.norm(a - b) / (2 * len(a))),
        "spectral": unit(1 - np.linalg.norm(a - b, 2) / 2),
        "rv": unit((bare_a * bare_b).sum() / np.sqrt(size)) if size > 0 else 0.0,
    }
    score = sum(w * parts[k] for k, w in CORRELATION_WEIGHTS.items()) if method == "combined" else parts[method]
    return {"score": score, "raw": 1 - score, **parts}


def standardised(real: np.ndarray, synth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = real.mean(axis=0), real.std(axis=0) + 1e-10
    return (real - mean) / scale, (synth - mean) / scale


def samples(real: DataFrame, synth: DataFrame, columns: Sequence[str], most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Equally many rows of both sides, at most ``most``, bounded whatever the tables' size."""
    a, b = sampled(real, columns, most, seed), sampled(synth, columns, most, seed)
    n = min(len(a), len(b))
    return standardised(a[:n], b[:n])


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0.0)


def without_self(k: np.ndarray) -> float:
    n = len(k)
    return float((k.sum() - np.trace(k)) / (n * (n - 1)))


def median_width(x: np.ndarray, y: np.ndarray) -> float:
    """The radial kernel's factor from the median of the squared distances of HEURISTIC rows a side."""
    some = np.vstack([x[:HEURISTIC], y[:HEURISTIC]])
    apart = squared_distances(some, some)[np.triu_indices(len(some), 1)]
    apart = apart[apart > 0]
    return float(1 / (2 * np.median(apart))) if len(apart) else 1.0


def mmd_value(x: np.ndarray, y: np.ndarray, kernel: str = "rbf", gamma: float | None = None) -> float:
    """Root of the unbiased squared discrepancy, not below 0; the width is the median distance if none is given."""
    if min(len(x), len(y)) < 2:
        return 0.0
    if kernel == "rbf" and gamma is None:
        gamma = median_width(x, y)
    made = lambda a, b: KERNELS[kernel](a, b, gamma)
    return float(np.sqrt(max(0.0, without_self(made(x, x)) + without_self(made(y, y)) - 2 * made(x, y).mean())))


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {
    "rbf": lambda a, b, gamma: np.exp(-gamma * squared_distances(a, b)),
    "linear": lambda a, b, gamma: a @ b.T,
    "polynomial": lambda a, b, gamma: (a @ b.T + 1) ** 3,
}


#: Kernels that are polynomials: their degree, and whether one is added to the product.
POLYNOMIALS = {"linear": (1, False), "polynomial": (3, True)}


def every_pair(real: DataFrame, synth: DataFrame, columns: Sequence[str], kernel: str | kernels.Radial | kernels.Power) -> tuple[float, float, float] | None:
    """Means of a kernel over all pairs within either side, rows with themselves left out, and over pairs of both sides; None if a side has one row.

    ``kernel`` is the name of a polynomial, or a kernel of distances.
    """
    columns = sorted(columns)
    x, y = knn.numbered(complete(real.select(*map(quoted, columns))), columns), knn.numbered(complete(synth.select(*map(quoted, columns))), columns)
    n, m = x.count(), y.count()
    if min(n, m) < 2:
        return None
    mean, deviation = knn.scale_of(x, columns)
    scale = mean, np.where(deviation > 0, deviation, 0.0) + 1e-10
    if isinstance(kernel, str):
        degree, one = POLYNOMIALS[kernel]
        a, b = (kernels.moment_sums(t, columns, scale, degree, one) for t in (x, y))
        own = [knn.row_sums(t, columns, scale, lambda r: ((r * r).sum(axis=1) + one) ** degree) for t in (x, y)]
        sums = np.array([[a @ a, a @ b], [a @ b, b @ b]])
    else:
        sums, self_ = kernels.pair_sums(x, y, columns, scale, kernel), float(kernel.of(np.zeros(1))[0])
        own = [n * self_, m * self_]
    return float(sums[0, 0] - own[0]) / (n * (n - 1)), float(sums[1, 1] - own[1]) / (m * (m - 1)), float(sums[0, 1]) / (n * m)


def mmd(real: DataFrame, synth: DataFrame, columns: Sequence[str], kernel: str = "rbf", gamma: float | None = None, most: int | None = SAMPLE, seed: int = 42) -> dict[str, float]:
    """On ``most`` rows a side, or with None on all of them; the width still follows from HEURISTIC rows a side."""
    if most is not None:
        raw = mmd_value(*samples(real, synth, columns, most, seed), kernel, gamma)
    else:
        if kernel == "rbf" and gamma is None:
            gamma = median_width(*samples(real, synth, columns, HEURISTIC, seed))
        means = every_pair(real, synth, columns, kernels.Radial(gamma) if kernel == "rbf" else kernel)
        raw = 0.0 if means is None else math.sqrt(max(0.0, means[0] + means[1] - 2 * means[2]))
    return {"score": 1 - min(raw, 1.0), "raw": raw}


def energy_value(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> float:
    if min(len(x), len(y)) < 2:
        return 0.0
    power = lambda a, b: squared_distances(a, b) ** (alpha / 2)
    return float(max(0.0, 2 * power(x, y).mean() - without_self(power(x, x)) - without_self(power(y, y))))


def energy_distance(real: DataFrame, synth: DataFrame, columns: Sequence[str], alpha: float = 1.0, most: int | None = SAMPLE, seed: int = 42) -> dict[str, float]:
    """On ``most`` rows a side, or with None on all of them."""
    if most is not None:
        raw = energy_value(*samples(real, synth, columns, most, seed), alpha)
    else:
        means = every_pair(real, synth, columns, kernels.Power(alpha))
        raw = 0.0 if means is None else max(0.0, 2 * means[2] - means[0] - means[1])
    return {"score": 1 - min(raw / 4, 1.0), "raw": raw}


def outlier_parts(real: DataFrame, synth: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = 1.5, z: float = 3.0) -> DataFrame:
    """``column, range_coverage, outlier_overlap, density_coverage`` from counts of values, written down once; nothing but counts is shuffled."""
    counts = checkpointed(value_counts(long_numbers(real, synth, columns)))
    if method == "iqr":
        q = quartiles(cumulative(counts))
        fences = q.select("column", *[x for s in "rs" for x in ((F.col(f"{s}q1") - factor * (F.col(f"{s}q3") - F.col(f"{s}q1"))).alias(f"lo_{s}"), (F.col(f"{s}q3") + factor * (F.col(f"{s}q3") - F.col(f"{s}q1"))).alias(f"hi_{s}"))])
    else:
        mean = lambda k: F.sum(F.col(k) * F.col("value")) / F.sum(k)
        sd = lambda k: F.sqrt(F.greatest(F.sum(F.col(k) * F.col("value") ** 2) / F.sum(k) - mean(k) ** 2, F.lit(0.0)))
        fences = counts.groupBy("column").agg(*[x for s in "rs" for x in ((mean(f"n{s}") - z * sd(f"n{s}")).alias(f"lo_{s}"), (mean(f"n{s}") + z * sd(f"n{s}")).alias(f"hi_{s}"))])
    out = lambda s: (F.col("value") < F.col(f"lo_{s}")) | (F.col("value") > F.col(f"hi_{s}"))
    x = counts.join(F.broadcast(fences), "column")
    seen = lambda s: F.col(f"n{s}") > 0
    ends = x.groupBy("column").agg(
        *[a for s in "rs" for a in (F.min(F.when(seen(s), F.col("value"))).alias(f"min_{s}"), F.max(F.when(seen(s), F.col("value"))).alias(f"max_{s}"), F.sum(F.when(out(s), F.col(f"n{s}")).otherwise(0)).alias(f"out_{s}"))],
        F.min(F.when(seen("r") & out("r"), F.col("value"))).alias("from"),
        F.max(F.when(seen("r") & out("r"), F.col("value"))).alias("to"),
    )
    inside = x.join(F.broadcast(ends.select("column", "from", "to")), "column").groupBy("column").agg(F.sum(F.when(out("s") & F.col("value").between(F.col("from"), F.col("to")), F.col("ns")).otherwise(0)).alias("inside"))
    share = lambda s: F.col(f"n{s}") / F.col(f"t{s}")
    density = binned(counts).groupBy("column").agg(F.sum(F.least(share("r"), share("s"))).alias("density_coverage"))
    width = F.col("max_r") - F.col("min_r")
    overlap: Column = F.greatest(F.least("max_r", "max_s") - F.greatest("min_r", "min_s"), F.lit(0.0))
    return ends.join(F.broadcast(inside), "column").join(F.broadcast(density), "column").select(
        "column",
        F.when(width < TINY, 1.0).otherwise(F.least(overlap / width, F.lit(1.0))).alias("range_coverage"),
        F.when((F.col("out_r") == 0) & (F.col("out_s") == 0), 1.0).when((F.col("out_r") == 0) | (F.col("out_s") == 0), 0.5).otherwise(F.col("inside") / F.col("out_s")).alias("outlier_overlap"),
        "density_coverage",
    )


def outliers_coverage(real: DataFrame, synth: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """One row: the three parts' means over columns and their weighted sum."""
    parts = outlier_parts(real, synth, columns, **options)
    w = OUTLIER_WEIGHTS
    score = w["range"] * F.avg("range_coverage") + w["outliers"] * F.avg("outlier_overlap") + w["density"] * F.avg("density_coverage")
    return parts.agg(F.avg("range_coverage").alias("range_coverage"), F.avg("outlier_overlap").alias("outlier_overlap"), F.avg("density_coverage").alias("density_coverage"), score.alias("score"))


__all__ = ["BINS", "correlation_matrix", "energy_distance", "mmd", "outlier_parts", "outliers_coverage"]
