"""Generators against each other: runs over seeds, score tables, ranks and tests."""

from __future__ import annotations

import csv
import io
import logging
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

import tabassay.generators.models  # noqa: F401  registers
from tabassay.functions.aggregate import run_statistics
from tabassay.functions.ranktests import TestResult, friedman, mean_ranks, wilcoxon
from tabassay.generators.base import Generator
from tabassay.operators.caster import CastTable
from tabassay.plans.calibrate import Bounds
from tabassay.plans.evaluate import EvalPlan, evaluate_cast, roll_up
from tabassay.plans.registry import GENERATORS
from tabassay.plans.storage import checkpointed

LOG = logging.getLogger("tabassay")
SCORE_SCHEMA = "generator string, seed int, name string, value double"


def made(name: str, seed: int, options: Mapping) -> Generator:
    return GENERATORS[name](seed=seed, **options.get(name, {}))


def run_benchmark(real: CastTable, plan: EvalPlan, generators: Sequence[str], seeds: Sequence[int] = (0, 1, 2), bounds: Bounds | None = None, options: Mapping[str, Mapping] | None = None) -> list[tuple]:
    """(generator, seed, score name, value); a run that fails is passed over, the others go on."""
    out = []
    for name in generators:
        for seed in seeds:
            try:
                g = made(name, seed, options or {}).fit(real)
                synth = g.generate()
                synth = CastTable(checkpointed(synth.frame), synth.categorical, synth.numeric)
                scores = roll_up(evaluate_cast(getattr(g, "reference", real), synth, plan), plan.layers, plan.aversion)
            except Exception as error:
                LOG.warning("%s with seed %d failed: %s", name, seed, error)
                continue
            values = scores["families"] | {"composite": scores["composite"]}
            if bounds is not None:
                values |= {f"calibrated.{k}": v for k, v in bounds.calibrated(scores["families"]).items()}
            out += [(name, seed, k, float(v)) for k, v in values.items() if math.isfinite(v)]
    return out


def score_table(rows: DataFrame) -> DataFrame:
    """Mean, deviation, median and quartiles per generator and score."""
    return rows.groupBy("generator", "name").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75")).withColumn("iqr", F.col("q75") - F.col("q25"))


def compare(spark: SparkSession, rows: list[tuple], score: str = "composite", alpha: float = 0.05) -> tuple[DataFrame, DataFrame, TestResult]:
    """Score table, mean ranks, and a test: Wilcoxon for two generators, Friedman with Nemenyi for more, over seeds that all have."""
    table = spark.createDataFrame(rows, SCORE_SCHEMA)
    own: dict[str, dict[int, float]] = {}
    for g, seed, name, v in rows:
        if name == score:
            own.setdefault(g, {})[seed] = v
    seeds = sorted(set.intersection(*[set(d) for d in own.values()])) if own else []
    columns = {g: [d[s] for s in seeds] for g, d in own.items()}
    test = wilcoxon(*columns.values(), alpha=alpha) if len(columns) == 2 else friedman(columns, alpha)
    ranks = mean_ranks(table.filter(F.col("name") == score).select("generator", "seed", F.col("value").alias("score")))
    return score_table(table), ranks, test


def as_markdown(rows: list[tuple], test: TestResult | None = None) -> str:
    names = sorted({r[2] for r in rows})
    lines = ["| generator | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    for g in dict.fromkeys(r[0] for r in rows):
        cells = [run_statistics(v for x, _, n, v in rows if x == g and n == name) for name in names]
        lines.append(f"| {g} | " + " | ".join("-" if c["mean"] is None else f"{c['mean']:.4f} ± {c['std']:.4f}" for c in cells) + " |")
    if test is not None:
        lines += ["", f"{test.name}: statistic {test.statistic:.4f}, p {test.p_value:.4g}" + (f", critical difference {test.critical_difference:.4f}" if test.critical_difference else "")]
    return "\n".join(lines) + "\n"


def as_csv(rows: list[tuple]) -> str:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(("generator", "seed", "name", "value"))
    w.writerows(rows)
    return out.getvalue()
