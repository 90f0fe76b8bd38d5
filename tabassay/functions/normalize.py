"""Raw metric values to scores in [0, 1], 1 best: plain functions and the same as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

BOUNDED, UNBOUNDED, SIMILARITY, DELTA, INFORMATION, CLOSEST, LOSS = "bounded_distance", "unbounded_distance", "similarity", "delta", "mutual_information", "dcr", "ml_loss"

# How each metric is normalised, and the scales of those that have one.
RULES: dict[str, str] = {
    **dict.fromkeys(("fidelity.correlation_matrix", "fidelity.outliers_coverage"), SIMILARITY),
    **dict.fromkeys(("fidelity.mmd", "fidelity.energy_distance", "fidelity.wasserstein", "fidelity.anderson_darling", "fidelity.kde_ise", "fidelity.kl", "fidelity.psi", "fidelity.mi", "fidelity.chi2_stat"), UNBOUNDED),
    **dict.fromkeys(("fidelity.ks", "fidelity.hellinger", "fidelity.tvd", "fidelity.js"), BOUNDED),
    **dict.fromkeys(("fidelity.delta_exceedance", "fidelity.delta_mean", "fidelity.delta_median", "fidelity.delta_iqr", "fidelity.delta_mad", "fidelity.cohens_d", "fidelity.entropy_delta", "fidelity.gini_delta"), DELTA),
    **dict.fromkeys(("fidelity.pearson", "fidelity.spearman", "fidelity.dcor", "fidelity.eta_squared", "fidelity.point_biserial", "fidelity.kruskal_epsilon", "fidelity.cramers_v", "fidelity.theils_u"), BOUNDED),
    "privacy.dcr": CLOSEST,
    **dict.fromkeys(("privacy.nnaa", "privacy.mia", "privacy.inference_attack", "privacy.k_anonymity", "privacy.l_diversity", "privacy.t_closeness", "privacy.record_linkage", "privacy.differential_privacy"), SIMILARITY),
    **dict.fromkeys(("utility.classification", "utility.regression", "utility.auto", "utility.ml_efficiency", "utility.classification_efficiency", "utility.regression_efficiency"), SIMILARITY),
}
SCALES: dict[str, float] = {"fidelity.wasserstein": 0.5, "fidelity.mmd": 0.1, "fidelity.energy_distance": 1.0, "fidelity.anderson_darling": 5.0, "fidelity.kde_ise": 0.1, "fidelity.kl": 1.0, "fidelity.psi": 0.25, "fidelity.chi2_stat": 100.0, "privacy.dcr": 10.0}


def clamp(x: float) -> float:
    """To [0, 1]; what is not finite scores nothing."""
    return sorted((0.0, x, 1.0))[1] if math.isfinite(x) else 0.0


def apply_rule(rule: str, value: float, scale: float = 1.0) -> float:
    if math.isnan(value):
        return 0.0
    made = {
        BOUNDED: lambda v: 1 - v,
        UNBOUNDED: lambda v: math.exp(-v / scale) if v >= 0 else 1.0,
        SIMILARITY: lambda v: v,
        DELTA: lambda v: 1 / (1 + abs(v)),
        INFORMATION: lambda v: v / (v + scale) if v > 0 else 0.0,
        CLOSEST: lambda v: 1 - math.exp(-max(v, 0.0) / scale),
        LOSS: lambda v: 1 / (1 + max(v, 0.0)),
    }
    return clamp(made[rule](value))


#: Rules by full ids and by their last parts; a full id stands before a last part of the same spelling.
BY_NAME = {full.partition(".")[2]: rule for full, rule in RULES.items()} | RULES


def rule_of(metric: str) -> str:
    """Of the id, else of its last part, else a similarity."""
    return BY_NAME.get(metric, BY_NAME.get(metric.split(".")[-1], SIMILARITY))


def normalize(metric: str, value: float, scale: float | None = None) -> float:
    return apply_rule(rule_of(metric), value, SCALES.get(metric, 1.0) if scale is None else scale)


def normalize_all(values: Mapping[str, float]) -> dict[str, float]:
    """NaN stays NaN."""
    return {m: v if math.isnan(v) else normalize(m, v) for m, v in values.items()}


def unit(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def as_column(rule: str, value: Column, scale: float = 1.0) -> Column:
    """The rule as an expression; null and NaN score 0."""
    made = {
        BOUNDED: 1 - value,
        UNBOUNDED: F.exp(-F.greatest(value, F.lit(0.0)) / scale),
        SIMILARITY: value,
        DELTA: 1 / (1 + F.abs(value)),
        INFORMATION: F.when(value > 0, value / (value + scale)).otherwise(0.0),
        CLOSEST: 1 - F.exp(-F.greatest(value, F.lit(0.0)) / scale),
        LOSS: 1 / (1 + F.greatest(value, F.lit(0.0))),
    }
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(unit(made[rule]))


def column_scores(rows: DataFrame) -> DataFrame:
    """``metric, column, raw`` -> also ``score``.

    Unbounded distances are scaled per metric between the 5th and 95th percentile over columns, which makes them
    relative to one another: equal ones score 1 if they are near 0 and 0.5 otherwise.
    """
    rules = [(m, r) for m, r in RULES.items() if m.startswith("fidelity.")]
    span = rows.groupBy("metric").agg(F.percentile("raw", 0.05).alias("low"), F.percentile("raw", 0.95).alias("high"))
    x = rows.join(F.broadcast(span), "metric")
    robust = F.when(F.col("high") - F.col("low") < 1e-10, F.when(F.col("high") < 1e-6, 1.0).otherwise(0.5)).otherwise(1 - unit((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))))
    by_rule = {r: [m for m, own in rules if own == r] for r in (BOUNDED, DELTA, SIMILARITY)}
    score = F.when(F.col("metric").isin(*[m for m, r in rules if r == UNBOUNDED]), robust)
    for rule, metrics in by_rule.items():
        score = score.when(F.col("metric").isin(*metrics), as_column(rule, F.col("raw")))
    return x.withColumn("score", F.when(F.col("raw").isNotNull(), score)).drop("low", "high")


def percentile_scores(rows: DataFrame, lower_is_better: Mapping[str, bool], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``metric, item, value`` -> ``score``: clipped between percentiles, turned where lower is better; constant metrics keep their clipped value."""
    span = rows.groupBy("metric").agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"), F.avg("value").alias("mean"))
    width = F.col("high") - F.col("low")
    up = F.when(width < 1e-10, unit(F.col("mean"))).otherwise(unit((F.col("value") - F.col("low")) / width))
    turned = F.col("metric").isin(*[m for m, t in lower_is_better.items() if t]) if any(lower_is_better.values()) else F.lit(False)
    return rows.join(F.broadcast(span), "metric").withColumn("score", F.when(turned, 1 - up).otherwise(up)).drop("low", "high", "mean")
