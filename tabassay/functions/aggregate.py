"""Aggregators of scores, for lists and as aggregate expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from tabassay.errors import RegistryError

AVERSION = 5.0


def finite(values: Iterable[float]) -> np.ndarray:
    v = np.array([math.nan if x is None else x for x in values], np.float64)
    return v[np.isfinite(v)]


def mean_dominance(v: np.ndarray) -> float:
    """First-order score: the mean, clipped to [0, 1]."""
    return float(np.clip(v.mean(), 0.0, 1.0))


def certainty_equivalent(v: np.ndarray, aversion: float = AVERSION) -> float:
    """Second-order score: -ln(mean(exp(-a v))) / a, between the least value and the mean."""
    if len(v) == 1 or np.allclose(v, v[0]):
        return float(np.clip(v[0], 0.0, 1.0))
    least = v.min()
    value = least - math.log(np.exp(-aversion * (v - least)).mean()) / aversion
    return float(np.clip(min(max(value, least), v.mean()), 0.0, 1.0))


def trimmed(v: np.ndarray, share: float) -> float:
    cut = int(share * len(v))
    return float(np.sort(v)[cut : len(v) - cut].mean())


AGGREGATORS: dict[str, Callable[[np.ndarray], float]] = {
    "mean": lambda v: float(v.mean()),
    "median": lambda v: float(np.median(v)),
    "min": lambda v: float(v.min()),
    "max": lambda v: float(v.max()),
    "percentile_25": lambda v: float(np.percentile(v, 25)),
    "percentile_75": lambda v: float(np.percentile(v, 75)),
    "trimmed_mean_10": lambda v: trimmed(v, 0.1),
    "trimmed_mean_20": lambda v: trimmed(v, 0.2),
    "geometric_mean": lambda v: float(np.exp(np.log(v).mean())) if (v > 0).all() else 0.0,
    "harmonic_mean": lambda v: float(len(v) / (1 / v).sum()) if (v > 0).all() else 0.0,
    "fsd": mean_dominance,
    "ssd": certainty_equivalent,
}


def aggregate(name: str, values: Iterable[float]) -> float:
    """NaN if nothing finite is left."""
    if name not in AGGREGATORS:
        raise RegistryError(f"unknown aggregator {name!r}; known: {', '.join(AGGREGATORS)}")
    v = finite(values)
    return AGGREGATORS[name](v) if len(v) else math.nan


def aggregate_column(name: str, c: Column) -> Column:
    """The same over a column of scores; trimmed means sort the (few) scores of a group into an array."""
    v = F.when(c.isNotNull() & ~F.isnan(c), c)
    every = F.array_sort(F.collect_list(v))

    def cut(share: float) -> Column:
        n = F.size(every)
        k = F.floor(n * share).cast("int")
        kept = F.slice(every, k + 1, n - 2 * k)
        return F.aggregate(kept, F.lit(0.0), lambda a, b: a + b) / F.size(kept)

    least = F.min(v)
    exponential = -F.log(F.avg(F.exp(-AVERSION * v))) / AVERSION
    made = {
        "mean": F.avg(v),
        "median": F.median(v),
        "min": least,
        "max": F.max(v),
        "percentile_25": F.percentile(v, 0.25),
        "percentile_75": F.percentile(v, 0.75),
        "trimmed_mean_10": cut(0.1),
        "trimmed_mean_20": cut(0.2),
        "geometric_mean": F.when(least > 0, F.exp(F.avg(F.log(v)))).when(F.count(v) > 0, F.lit(0.0)),
        "harmonic_mean": F.when(least > 0, F.count(v) / F.sum(1 / v)).when(F.count(v) > 0, F.lit(0.0)),
        "fsd": F.greatest(F.least(F.avg(v), F.lit(1.0)), F.lit(0.0)),
        "ssd": F.greatest(F.least(F.least(F.greatest(exponential, least), F.avg(v)), F.lit(1.0)), F.lit(0.0)),
    }
    return made[name]


def matrix_score(rows: np.ndarray, aversion: float = AVERSION) -> tuple[np.ndarray, float]:
    """First-order scores of the rows, and the second-order score over them."""
    means = np.array([mean_dominance(r) for r in np.asarray(rows, np.float64)])
    return means, certainty_equivalent(means, aversion)


def weighted_score(values: Sequence[float], weights: Sequence[float], aversion: float = AVERSION) -> float:
    """Second-order score with weights, which must be as many, not negative and not all 0."""
    v, w = np.asarray(values, np.float64), np.asarray(weights, np.float64)
    if len(v) != len(w) or (w < 0).any() or not w.sum() > 0:
        raise ValueError("weights must match the values, be 0 or more, and sum to more than 0")
    w = w / w.sum()
    least = v.min()
    value = least - math.log((w * np.exp(-aversion * (v - least))).sum()) / aversion
    return float(np.clip(min(max(value, least), (w * v).sum()), 0.0, 1.0))


def hypervolume(values: Iterable[float]) -> float:
    v = np.clip(finite(values), 1e-10, 1.0)
    return float(np.exp(np.log(v).mean())) if len(v) else math.nan


def run_statistics(values: Iterable[float]) -> dict[str, float | None]:
    """Median, mean, deviation (n - 1), extremes, quartiles, and the mode if a value repeats."""
    v = finite(values)
    if not len(v):
        return dict.fromkeys(("median", "mean", "std", "min", "max", "q1", "q3", "mode"))
    found, times = np.unique(np.round(v, 10), return_counts=True)
    return {
        "median": float(np.median(v)),
        "mean": float(v.mean()),
        "std": float(v.std(ddof=1)) if len(v) > 1 else 0.0,
        "min": float(v.min()),
        "max": float(v.max()),
        "q1": float(np.percentile(v, 25)),
        "q3": float(np.percentile(v, 75)),
        "mode": float(found[times.argmax()]) if times.max() > 1 else None,
    }
