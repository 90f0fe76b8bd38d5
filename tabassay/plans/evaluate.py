"""From a list of metrics to scores: what is asked for is grouped so metrics share frames, and rolled up a tree.

A group that fails gives NaN for its metrics and says why; the others go on.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabassay.errors import ConfigError
from tabassay.functions.aggregate import AVERSION, aggregate, aggregate_column, certainty_equivalent, finite, hypervolume
from tabassay.functions.normalize import apply_rule, column_scores, rule_of
from tabassay.operators import learning, marginal, pairs, privacy, whole
from tabassay.operators.caster import CastTable, prepare, validate
from tabassay.operators.frames import stacked
from tabassay.plans.registry import METRICS
from tabassay.plans.taxonomy import PLACES, by_place, expand
from tabassay.schema import TableSchema

LOG = logging.getLogger("tabassay")
RESULT_SCHEMA = "id string, family string, value double, details string"


@dataclass(frozen=True)
class MetricResult:
    id: str
    value: float
    family: str
    details: dict = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return math.isfinite(self.value)


class Layers(NamedTuple):
    """Aggregators: of subcategories and categories, of families (some may have their own), and of the composite if another."""

    low: str = "median"
    high: str = "ssd"
    families: Mapping[str, str] = {}  # noqa: RUF012  read only
    composite: str | None = None


def layers_of(given: str | Mapping | Sequence[str] | None) -> Layers:
    """From a name for all above the metrics, a pair, or a mapping in one of four shapes.

    ``layers_1_2`` and ``layers_3_4``; families with ``level_2`` (the fidelity one counts below families) and a
    ``composite`` that also serves families; a name per family and a ``composite``; a ``composite`` alone.
    """
    if not isinstance(given, Mapping):
        return Layers() if not given else Layers(high=given) if isinstance(given, str) else Layers(*given)
    of_family = {f: given[f] for f in ("fidelity", "privacy", "utility") if f in given}
    if isinstance(of_family.get("fidelity"), Mapping):
        return Layers(of_family["fidelity"].get("level_2", "mean"), given.get("composite", "ssd"))
    if given.keys() & {"layers_1_2", "layers_3_4"}:
        return Layers(given.get("layers_1_2", Layers().low), given.get("layers_3_4", Layers().high))
    if of_family and all(isinstance(n, str) for n in of_family.values()):
        return Layers(families=of_family, composite=given.get("composite", "ssd"))
    return Layers(composite=given.get("composite"))


@dataclass
class EvalPlan:
    """What to compute. ``layers``: what ``layers_of`` takes."""

    metrics: list[str]
    target: str | None = None
    task: str | None = None
    seed: int = 42
    quasi: list[str] | None = None
    epsilon: float = 1.0
    aversion: float = AVERSION
    layers: Layers | tuple[str, str] = Layers()
    max_rows: int | None = None
    trials: int = 1

    def __post_init__(self):
        self.metrics = expand(self.metrics)
        self.layers = self.layers if isinstance(self.layers, Layers) else layers_of(self.layers)
        if self.aversion <= 0:
            raise ConfigError("risk_aversion must be above 0")


@dataclass
class RunSummary:
    plan: EvalPlan
    results: list[MetricResult]
    scores: dict
    artifacts: dict = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.id, r.family, float(r.value), json.dumps(r.details, default=str)) for r in self.results], RESULT_SCHEMA)


def failed(ids: Sequence[str], error: Exception | str) -> list[MetricResult]:
    return [MetricResult(i, math.nan, i.split(".")[0], {"error": str(error)[:500]}) for i in ids]


def marginal_results(real: CastTable, synth: CastTable, ids: Sequence[str], plan: EvalPlan) -> list[MetricResult]:
    """Means of column scores; 0 where no column is valid."""
    names = [i.split(".")[1] for i in ids]
    numeric = [n for n in names if n in marginal.ALL_NUMERIC]
    shares = [n for n in names if n in marginal.COVERAGE]
    rows = None
    if numeric and real.numeric:
        rows = marginal.numeric_metrics(real.frame, synth.frame, real.numeric, numeric)
    if shares and real.columns:
        more = marginal.universal_metrics(real.frame, synth.frame, real.numeric, real.categorical, shares)
        rows = more if rows is None else rows.unionByName(more)
    found: dict[str, dict] = {i: {} for i in ids}
    for r in column_scores(rows).collect() if rows is not None else []:
        found[r["metric"]][r["column"]] = {"raw_value": r["raw"], "normalized_value": r["score"], "is_valid": r["score"] is not None}
    out = []
    for i in ids:
        scores = [c["normalized_value"] for c in found[i].values() if c["is_valid"]]
        out.append(MetricResult(i, sum(scores) / len(scores) if scores else 0.0, "fidelity", {"columns": found[i]}))
    return out


def pair_results(real: CastTable, synth: CastTable, ids: Sequence[str], plan: EvalPlan) -> list[MetricResult]:
    out = []
    for i in ids:
        rows = pairs.pair_metric(i.split(".")[1], real.frame, synth.frame, real.numeric, real.categorical, plan.seed)
        found, scores = {}, []
        for r in rows.collect() if rows is not None else []:
            score = None if r["delta"] is None else apply_rule(rule_of(i), r["delta"])
            scores += [score] if score is not None else []
            found[f"{r['c1']}|{r['c2']}"] = {"real_value": r["real_value"], "synth_value": r["synth_value"], "delta": r["delta"], "normalized_value": score}
        out.append(MetricResult(i, sum(scores) / len(scores) if scores else math.nan, "fidelity", {"pairs": found, "_summary": {"total": len(found), "valid": len(scores)}}))
    return out


def global_results(real: CastTable, synth: CastTable, ids: Sequence[str], plan: EvalPlan) -> list[MetricResult]:
    r, s, c = real.frame, synth.frame, real.numeric
    made: dict[str, Callable[[], dict]] = {
        "fidelity.correlation_matrix": lambda: whole.correlation_matrix(r, s, c),
        "fidelity.mmd": lambda: whole.mmd(r, s, c, seed=plan.seed),
        "fidelity.energy_distance": lambda: whole.energy_distance(r, s, c, seed=plan.seed),
        "fidelity.outliers_coverage": lambda: whole.outliers_coverage(r, s, c).first().asDict(),
    }
    return each(ids, made, "fidelity")


def each(ids: Sequence[str], made: Mapping[str, Callable[[], dict]], family: str) -> list[MetricResult]:
    out = []
    for i in ids:
        try:
            d = made[i]()
            out.append(MetricResult(i, float(d["score"]), family, d))
        except Exception as error:
            LOG.warning("%s failed: %s", i, error)
            out += failed([i], error)
    return out


def quasi_of(real: CastTable, plan: EvalPlan, most: int | None = None) -> list[str]:
    chosen = plan.quasi or real.categorical[:most]
    if not chosen:
        raise ValueError("no quasi-identifiers")
    return chosen


def privacy_results(real: CastTable, synth: CastTable, ids: Sequence[str], plan: EvalPlan) -> list[MetricResult]:
    """Both sides are cut to the smaller one's size first."""
    r, s = privacy.balanced(real.frame, synth.frame, plan.seed)
    br, bs = CastTable(r, real.categorical, real.numeric), CastTable(s, synth.categorical, synth.numeric)
    mean = lambda rows: (lambda x: {"score": sum(v["score"] for v in x) / len(x), "columns": x})([v.asDict() for v in rows.collect()])
    made: dict[str, Callable[[], dict]] = {
        "privacy.dcr": lambda: privacy.dcr(r, s, real.numeric, plan.max_rows).first().asDict(),
        "privacy.nnaa": lambda: privacy.nnaa(r, s, real.numeric, plan.max_rows).first().asDict(),
        "privacy.record_linkage": lambda: privacy.record_linkage(r, s, real.numeric, None, plan.max_rows).first().asDict(),
        "privacy.k_anonymity": lambda: privacy.k_anonymity(s, quasi_of(real, plan)).first().asDict(),
        "privacy.l_diversity": lambda: mean(privacy.l_diversity(s, q := quasi_of(real, plan, privacy.QUASI), [c for c in real.columns if c not in q])),
        "privacy.t_closeness": lambda: mean(privacy.t_closeness(s, quasi_of(real, plan, privacy.QUASI), real.numeric, real.categorical)),
        "privacy.mia": lambda: learning.membership_attack(br, bs, seed=plan.seed),
        "privacy.inference_attack": lambda: learning.inference_attack(br, bs, seed=plan.seed),
        "privacy.differential_privacy": lambda: {"score": privacy.differential_privacy(plan.epsilon), "epsilon": plan.epsilon},
    }
    return each(ids, made, "privacy")


def utility_results(real: CastTable, synth: CastTable, ids: Sequence[str], plan: EvalPlan) -> list[MetricResult]:
    """One fit per strategy serves every utility metric asked for."""
    if not plan.target:
        return failed(ids, "utility metrics need a target")
    every = {"utility.ml_efficiency", "utility.classification_efficiency", "utility.regression_efficiency"}
    names = learning.STRATEGIES if every & set(ids) else [i.split(".")[1] for i in ids]
    out = []
    task = {"utility.classification_efficiency": "classification", "utility.regression_efficiency": "regression"}
    runs: dict[str | None, dict] = {}
    for i in ids:
        try:
            wanted = task.get(i, plan.task)
            if wanted not in runs:
                runs[wanted] = learning.efficiency(real, synth, plan.target, names, wanted, plan.trials, plan.seed)
            e = runs[wanted]
            value = e["score"] if i in every else e["strategies"][i.split(".")[1]]
            out.append(MetricResult(i, float(value), "utility", e))
        except Exception as error:
            out += failed([i], error)
    return out


def group_of(metric: str) -> str:
    if metric in METRICS:
        return "custom"
    family, category, _ = PLACES.get(metric, (metric.split(".")[0], "", ""))
    return category if family == "fidelity" else family


def custom_results(real: CastTable, synth: CastTable, ids: Sequence[str], plan: EvalPlan) -> list[MetricResult]:
    return [r for i in ids for r in each([i], {i: lambda i=i: METRICS[i](real, synth, plan)}, i.split(".")[0])]


GROUPS = {"marginal": marginal_results, "conditional": pair_results, "global": global_results, "privacy": privacy_results, "utility": utility_results, "custom": custom_results}


def evaluate_cast(real: CastTable, synth: CastTable, plan: EvalPlan) -> list[MetricResult]:
    """Results in the order asked for; both tables are kept in memory while their metrics run."""
    grouped: dict[str, list[str]] = {}
    for i in plan.metrics:
        grouped.setdefault(group_of(i), []).append(i)
    real.frame.persist()
    synth.frame.persist()
    try:
        found = {}
        for group, ids in grouped.items():
            try:
                rows = GROUPS[group](real, synth, ids, plan)
            except Exception as error:
                LOG.warning("%s metrics failed: %s", group, error)
                rows = failed(ids, error)
            found.update({r.id: r for r in rows})
    finally:
        real.frame.unpersist()
        synth.frame.unpersist()
    return [found[i] for i in plan.metrics]


def roll_up(results: Sequence[MetricResult], layers: Layers | tuple[str, str] = Layers(), aversion: float = AVERSION) -> dict:  # noqa: B008  read only
    """Families, composite, hierarchy and counts.

    Subcategories and categories take the low aggregator over their metrics, families their own or the high one over theirs, the
    composite its own or the high one over families.
    """
    layers = Layers(*layers)
    own = lambda name, v: certainty_equivalent(finite(v), aversion) if name == "ssd" and len(finite(v)) else aggregate(name, v)
    valid = {r.id: r.value for r in results if r.valid}
    tree: dict = {}
    for family, categories in by_place(valid).items():
        cats, leaves = {}, []
        for category, subs in categories.items():
            values = [valid[m] for ms in subs.values() for m in ms]
            leaves += values
            cats[category] = {"score": own(layers.low, values), "count": len(values), "subcategories": {s: {"score": own(layers.low, [valid[m] for m in ms]), "count": len(ms), "metrics": ms} for s, ms in subs.items()}}
        tree[family] = {"score": own(layers.families.get(family, layers.high), leaves), "count": len(leaves), "categories": cats}
    families = {f: t["score"] for f, t in tree.items()}
    return {
        "families": families,
        "composite": own(layers.composite or layers.high, families.values()) if families else math.nan,
        "hypervolume": hypervolume(families.values()),
        "hierarchy": tree,
        "counts": {"total": len(results), "valid": len(valid), "failed": [r.id for r in results if not r.valid]},
    }


def evaluate(real: DataFrame, synth: DataFrame, schema: TableSchema | Mapping, plan: EvalPlan, bounds=None) -> RunSummary:
    """Cast, validate, compute, roll up; with calibrated bounds family scores are placed between them."""
    schema = schema if isinstance(schema, TableSchema) else TableSchema.of(schema)
    r, s = prepare(real, synth, schema)
    counts = validate(r, s, plan.target, plan.metrics)
    results = evaluate_cast(r, s, plan)
    scores = roll_up(results, plan.layers, plan.aversion)
    if bounds is not None:
        scores["calibrated"] = bounds.calibrated(scores["families"])
    return RunSummary(plan, results, scores, {"rows": counts})


def marginal_report(real: CastTable, synth: CastTable) -> DataFrame:
    """``family, category, subcategory, metric, score`` of all column metrics, with subtotals, as one plan."""
    numeric = marginal.numeric_metrics(real.frame, synth.frame, real.numeric, marginal.ALL_NUMERIC)
    shares = marginal.universal_metrics(real.frame, synth.frame, real.numeric, real.categorical, marginal.COVERAGE)
    scored = column_scores(numeric.unionByName(shares)).groupBy("metric").agg(F.avg("score").alias("score"))
    placed = F.create_map(*[F.lit(x) for m, (_, _, s) in PLACES.items() if m.startswith("fidelity.") for x in (m, s)])
    leaves = scored.select(F.lit("fidelity").alias("family"), F.lit("marginal").alias("category"), placed[F.col("metric")].alias("subcategory"), "metric", "score")
    return leaves.rollup("family", "category", "subcategory", "metric").agg(F.median("score").alias("score")).filter(F.col("family").isNotNull())


def univariate(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``is_real, column`` and moments of numeric columns, skewness and kurtosis corrected for bias as data frames in memory do."""
    both = stacked(real, synth, columns)
    long = both.select("is_real", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("p")).select("is_real", "p.column", "p.v")
    n = F.count("v").cast("double")
    skew = F.when(n > 2, F.skewness("v") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.kurtosis("v") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return long.groupBy("is_real", "column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.25).alias("q25"), F.percentile("v", 0.75).alias("q75"), skew.alias("skew"), kurt.alias("kurtosis"))


def redacted_counts(table: DataFrame, column: str, least: int = 5, top: int = 50) -> DataFrame:
    """``value, n``: frequent values; rarer than ``least`` become __redacted__, beyond the ``top`` __other__."""
    counts = table.groupBy(F.col(f"`{column}`").cast("string").alias("value")).count()
    kept = counts.filter(F.col("count") >= least).orderBy(F.desc("count"), "value").limit(top).select(F.col("value").alias("kept"))
    named = counts.join(kept, F.col("value") == F.col("kept"), "left")
    label = F.when(F.col("count") < least, "__redacted__").when(F.col("kept").isNull(), "__other__").otherwise(F.col("value"))
    return named.groupBy(label.alias("value")).agg(F.sum("count").alias("n"))


def hierarchy_frame(results: DataFrame, layers: tuple[str, str] = ("median", "ssd")) -> DataFrame:
    """``family, category, subcategory, score, count`` of a frame of results (``RunSummary.frame``), by one rollup.

    Families take the second aggregator, all below the first; values that are not finite are left out.
    """
    at = [F.create_map(*[F.lit(x) for m, p in PLACES.items() for x in (m, p[k])]) for k in range(3)]
    value = F.when(F.abs("value") < float("inf"), F.col("value"))
    placed = results.select(*[F.coalesce(a[F.col("id")], F.lit("other")).alias(n) for a, n in zip(at, ("family", "category", "subcategory"), strict=True)], value.alias("value")).filter("value is not null")
    first, second = (aggregate_column(name, F.col("value")) for name in layers[:2])
    rolled = placed.rollup("family", "category", "subcategory").agg(first.alias("__first"), second.alias("__second"), F.count("*").alias("count"), F.grouping("category").alias("__whole"))
    score = F.when(F.col("__whole") == 1, F.col("__second")).otherwise(F.col("__first"))
    return rolled.filter("family is not null").select("family", "category", "subcategory", score.alias("score"), "count")


def worst_columns(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` lowest scores of each metric, ties by name; ``scored``: metric, column, score."""
    w = Window.partitionBy("metric").orderBy("score", "column")
    return scored.filter("score is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
