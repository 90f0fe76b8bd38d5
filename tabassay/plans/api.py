"""Entry points: evaluate two tables, run a configuration, calibrate, benchmark."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tabassay.errors import ConfigError
from tabassay.functions.aggregate import run_statistics
from tabassay.operators.caster import prepare, validate
from tabassay.plans.benchmark import run_benchmark
from tabassay.plans.calibrate import Bounds, BoundsCache, calibrate, calibrated_scores
from tabassay.plans.evaluate import EvalPlan, RunSummary, evaluate_cast, layers_of, roll_up
from tabassay.schema import TableSchema
from tabassay.sources.config import check, load_config, metrics_of
from tabassay.sources.loaders import load, load_pair
from tabassay.sources.reports import write_reports


def plan_of(config: Mapping) -> EvalPlan:
    """Aggregators (``aggregation.method`` or ``aggregation.layers``) may have any shape that ``layers_of`` takes."""
    evaluation, aggregation, data = config.get("evaluation", {}), config.get("aggregation", {}), config["data"]
    layers = layers_of(aggregation.get("method", aggregation.get("layers")))
    target = data.get("target")
    return EvalPlan(
        metrics_of(config),
        target=target[0] if isinstance(target, list) and target else target or None,
        task=data.get("task_type"),
        seed=int(evaluation.get("seed", config.get("seed", 42))),
        quasi=data.get("quasi_identifiers"),
        epsilon=float(evaluation.get("epsilon", 1.0)),
        aversion=float(aggregation.get("risk_aversion", 5.0)),
        layers=layers,
        max_rows=evaluation.get("max_rows"),
        trials=int(evaluation.get("trials", 1)),
    )


class Evaluator:
    """``Evaluator(config).evaluate(real, synth)``: scores of two tables in memory of the cluster."""

    def __init__(self, config: Mapping):
        self.config = check(config)
        self.schema, self.plan = TableSchema.of(config["data"].get("schema")), plan_of(config)

    def evaluate(self, real: DataFrame, synth: DataFrame) -> RunSummary:
        r, s = prepare(real, synth, self.schema)
        counts = validate(r, s, self.plan.target, self.plan.metrics)
        settings = self.config.get("calibration", {})
        bounds = None
        if settings.get("bounds_file"):
            bounds = Bounds.load(settings["bounds_file"])
        elif settings.get("enabled"):
            options = {"iterations": int(settings.get("iterations", 5)), "sample": float(settings.get("sample_percentage", 100)) / 100}
            bounds = BoundsCache(settings["cache_dir"]).get_or_calibrate(r, self.plan, **options) if settings.get("cache_dir") else calibrate(r, self.plan, **options)
        runs = []
        for k in range(int(self.config.get("evaluation", {}).get("n_runs", 1))):
            plan = replace(self.plan, seed=self.plan.seed + k)
            results = evaluate_cast(r, s, plan)
            scores = calibrated_scores(results, bounds, plan) if bounds else roll_up(results, plan.layers, plan.aversion)
            runs.append(RunSummary(plan, results, scores, {"rows": counts}))
        if len(runs) > 1:
            names = runs[0].scores["families"].keys() | {"composite"}
            over = {n: run_statistics(x.scores["families"].get(n, x.scores["composite"] if n == "composite" else float("nan")) for x in runs) for n in sorted(names)}
            runs[0].artifacts["runs"] = {"n": len(runs), "statistics": over}
        return runs[0]


def evaluate_from_config(spark: SparkSession, path: str | Path) -> RunSummary:
    config = load_config(path)
    summary = Evaluator(config).evaluate(*load_pair(spark, config["data"]))
    report = config.get("report")
    if report:
        summary.artifacts["files"] = [str(p) for p in write_reports(summary, report["output_dir"], report["formats"])]
    return summary


def calibrate_from_config(spark: SparkSession, path: str | Path, output: str | Path | None = None) -> Bounds:
    config = load_config(path)
    real = load(spark, config["data"]["real"], **({"sep": config["data"]["sep"]} if config["data"].get("sep") else {}))
    schema, settings = TableSchema.of(config["data"].get("schema")), config.get("calibration", {})
    r, _ = prepare(real, real, schema)
    bounds = calibrate(r, plan_of(config), int(settings.get("iterations", 5)), float(settings.get("sample_percentage", 100)) / 100)
    if output:
        bounds.save(output)
    return bounds


def benchmark_from_config(spark: SparkSession, path: str | Path) -> list[tuple]:
    config = load_config(path)
    settings = config.get("benchmark")
    if not settings:
        raise ConfigError("a benchmark section is required")
    real = load(spark, config["data"]["real"], **({"sep": config["data"]["sep"]} if config["data"].get("sep") else {}))
    r, _ = prepare(real, real, TableSchema.of(config["data"].get("schema")))
    names = [g if isinstance(g, str) else g["name"] for g in settings["generators"]]
    options = {g["name"]: g.get("params", {}) for g in settings["generators"] if not isinstance(g, str)}
    return run_benchmark(r, plan_of(config), names, range(int(settings.get("n_runs", 3))), options=options)
