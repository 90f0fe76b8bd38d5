"""Metrics that train models: attacks on privacy and usefulness for prediction, with ``pyspark.ml``.

Forests and boosted trees are Spark's own, so scores agree with other libraries in kind, not digit by digit.
Splits go by a hash of the row, so every run sees the same ones.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabassay.operators.caster import CastTable, quoted
from tabassay.operators.frames import row_sample

TREES, DEPTH, MIA_ROWS, FEW = 100, 10, 1000, 20
TEST_SHARE, ATTACK_SHARE = 0.2, 0.3
MAX_BINS = 256
ATTACKS = 5
STRATEGIES = ("tts", "tstr", "trts", "ttrs")


def hashed(frame: DataFrame, seed: int) -> DataFrame:
    """With ``__u`` in [0, 1) from a hash of the whole row."""
    return frame.withColumn("__u", F.pmod(F.xxhash64(*map(quoted, frame.columns), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def split(frame: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test); equal rows stay together."""
    x = hashed(frame, seed)
    return x.filter(F.col("__u") >= share).drop("__u"), x.filter(F.col("__u") < share).drop("__u")


def subsample(frame: DataFrame, most: int, seed: int = 42) -> DataFrame:
    return row_sample(frame, most, seed)


def balance(a: DataFrame, b: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    n, m = a.count(), b.count()
    return (subsample(a, m, seed) if n > m else a), (subsample(b, n, seed) if m > n else b)


def safe(frame: DataFrame) -> DataFrame:
    """Columns named c0, c1, ... for the ML feature stages, which take dots in names for structs."""
    return frame.toDF(*[f"c{k}" for k in range(len(frame.columns))])


@dataclass
class Features:
    """Stages that turn cast columns into one vector: categories by frequency rank, unseen ones in a rank of their own."""

    numeric: list[str]
    categorical: list[str]

    def stages(self) -> list:
        index = [StringIndexer(inputCols=self.categorical, outputCols=[f"{c}__i" for c in self.categorical], handleInvalid="keep")] if self.categorical else []
        return [*index, VectorAssembler(inputCols=[*self.numeric, *[f"{c}__i" for c in self.categorical]], outputCol="features", handleInvalid="keep")]




def cap(train: DataFrame, others: Sequence[DataFrame], categorical: Sequence[str]) -> list[DataFrame]:
    """Keep each category column's most frequent MAX_BINS - 2 values, the rest become one."""
    out = [train, *others]
    for c in categorical:
        top = [r[c] for r in train.groupBy(c).count().orderBy(F.desc("count"), c).limit(MAX_BINS - 2).collect()]
        out = [t.withColumn(c, F.when(F.col(c).isin(top), F.col(c)).otherwise("__other__")) for t in out]
    return out


def fitted(train: DataFrame, features: Features, learner) -> PipelineModel:
    return Pipeline(stages=[*features.stages(), learner]).fit(train)


def membership_attack(real: CastTable, synth: CastTable, rows: int = MIA_ROWS, seed: int = 42) -> dict[str, float]:
    """A forest tells real from synthetic rows; score 2 * accuracy - 1, clipped: higher where they are easier to tell apart."""
    numeric, categorical = real.numeric, real.categorical
    names = [*numeric, *categorical]
    mark = lambda t, y: safe(subsample(t.frame.select(*map(quoted, names)), rows, seed)).withColumn("label", F.lit(y))
    both = mark(real, 1.0).unionByName(mark(synth, 0.0))
    feats = Features([f"c{k}" for k in range(len(numeric))], [f"c{k}" for k in range(len(numeric), len(names))])
    train, test = split(both, ATTACK_SHARE, seed)
    train, test = cap(train, [test], feats.categorical)
    model = fitted(train, feats, RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=MAX_BINS, seed=seed))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))
    return {"score": min(max(2 * accuracy - 1, 0.0), 1.0), "accuracy": accuracy}


def attribute_attack(real: CastTable, synth: CastTable, target: str, trees: int = TREES, seed: int = 42) -> dict[str, float | str]:
    """How much better than chance a forest trained on synthetic rows recovers a real column from the others."""
    numeric, categorical = [c for c in real.numeric if c != target], [c for c in real.categorical if c != target]
    names = [*numeric, *categorical, target]
    r, s = (safe(t.frame.select(*map(quoted, names))) for t in (real, synth))
    y, feats = f"c{len(names) - 1}", Features([f"c{k}" for k in range(len(numeric))], [f"c{k}" for k in range(len(numeric), len(names) - 1)])
    s, r = cap(s, [r], feats.categorical)
    distinct = s.select(F.approx_count_distinct(y, 0.01)).first()[0]
    if target in real.categorical or distinct <= FEW:
        s, r = s.withColumn(y, F.col(y).cast("string")), r.withColumn(y, F.col(y).cast("string"))
        s, r = cap(s, [r], [y])
        index = StringIndexer(inputCol=y, outputCol="label", handleInvalid="keep").fit(s.select(y).union(r.select(y)))
        classes = max(len(index.labels), 2)
        model = fitted(index.transform(s), feats, RandomForestClassifier(numTrees=trees, maxDepth=DEPTH, maxBins=MAX_BINS, seed=seed))
        accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(index.transform(r)))
        gain = max(0.0, (accuracy - 1 / classes) / (1 - 1 / classes))
    else:
        model = fitted(s.withColumn("label", F.col(y).cast("double")), feats, RandomForestRegressor(numTrees=trees, maxDepth=DEPTH, maxBins=MAX_BINS, seed=seed))
        gain = max(0.0, RegressionEvaluator(metricName="r2").evaluate(model.transform(r.withColumn("label", F.col(y).cast("double")))))
    return {"column": target, "score": min(max(1 - gain, 0.0), 1.0)}


def inference_attack(real: CastTable, synth: CastTable, trees: int = TREES, seed: int = 42) -> dict:
    # A forest's steps leave cores idle on tables of few partitions, so columns are attacked side by side; each forest keeps its seed.
    with ThreadPoolExecutor(ATTACKS) as pool:
        rows = list(pool.map(inheritable_thread_target(real.frame.sparkSession)(lambda c: attribute_attack(real, synth, c, trees, seed)), real.columns))
    return {"score": sum(r["score"] for r in rows) / len(rows), "columns": rows}


def task_of(table: CastTable, target: str, declared: str | None = None) -> str:
    """Declared, else classification for strings, at most ten values, or whole numbers of few values; regression otherwise."""
    if declared:
        return declared
    if target in table.categorical:
        return "classification"
    c = quoted(target)
    row = table.frame.agg(F.approx_count_distinct(c, 0.01).alias("k"), F.count("*").alias("n"), F.max(F.abs(c - F.round(c))).alias("off")).first()
    return "classification" if row["k"] <= 10 or row["off"] == 0 and row["k"] <= min(50, row["n"] / 10) else "regression"


@dataclass(frozen=True)
class Setting:
    """Of a learner: depth of trees, size of a step of boosting, share of rows a tree sees."""

    depth: int = 6
    rate: float = 0.1
    share: float = 1.0


def settings(trials: int, seed: int) -> list[Setting]:
    """The default, then settings drawn by the seed: depths evenly from 3 to 10, rates log-evenly from 1e-5 to 1, shares evenly from a half to 1."""
    draw = random.Random(seed)
    return [Setting(), *[Setting(draw.randint(3, 10), 10 ** draw.uniform(-5, 0), draw.uniform(0.5, 1.0)) for _ in range(trials - 1)]]


def prediction_score(train: DataFrame, test: DataFrame, real: CastTable, target: str, task: str, trials: int = 1, seed: int = 42, runs: int = 1) -> float:
    """Weighted F1 of a forest, or mean absolute error of boosted trees: the mean of ``runs`` seeds under the best of ``trials`` settings."""
    numeric, categorical = [c for c in real.numeric if c != target], [c for c in real.categorical if c != target]
    names = [*numeric, *categorical, target]
    a, b = (safe(t.select(*map(quoted, names))) for t in (train, test))
    y, feats = f"c{len(names) - 1}", Features([f"c{k}" for k in range(len(numeric))], [f"c{k}" for k in range(len(numeric), len(names) - 1)])
    a, b = cap(a, [b], feats.categorical)
    if task == "classification":
        text = lambda t: t.withColumn(y, F.col(y).cast("string"))
        index = StringIndexer(inputCol=y, outputCol="label", handleInvalid="keep").fit(text(a).select(y).union(text(b).select(y)))
        a, b = index.transform(text(a)), index.transform(text(b))
    else:
        a, b = (t.withColumn("label", F.col(y).cast("double")) for t in (a, b))

    def value(s: Setting, seed: int) -> float:
        if task == "classification":
            model = fitted(a, feats, RandomForestClassifier(numTrees=50, maxDepth=s.depth, subsamplingRate=s.share, maxBins=MAX_BINS, seed=seed))
            return MulticlassClassificationEvaluator(metricName="weightedFMeasure").evaluate(model.transform(b))
        model = fitted(a, feats, GBTRegressor(maxIter=20, maxDepth=min(s.depth, 6), stepSize=s.rate, subsamplingRate=s.share, maxBins=MAX_BINS, seed=seed))
        return RegressionEvaluator(metricName="mae").evaluate(model.transform(b))

    tried = [(value(s, seed), s) for s in settings(max(trials, 1), seed)]
    best, setting = (max if task == "classification" else min)(tried, key=lambda t: t[0])
    more = [value(setting, seed + k) for k in range(1, runs)]
    return (best + sum(more)) / (1 + len(more))


def strategy_frames(name: str, real: DataFrame, synth: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a strategy: which side is trained and tested on."""
    if name == "ttr":
        return split(real, TEST_SHARE, seed)
    if name == "tts":
        return split(synth, TEST_SHARE, seed)
    if name == "tstr":
        return split(synth, TEST_SHARE, seed)[0], split(real, TEST_SHARE, seed)[1]
    r, s = balance(real, synth, seed)
    if name == "trts":
        return split(r, TEST_SHARE, seed)[0], split(s, TEST_SHARE, seed)[1]
    if name == "ttrs":
        train, test = split(r, TEST_SHARE, seed)
        return train.unionByName(split(s, TEST_SHARE, seed)[0]), test
    raise ValueError(f"unknown strategy {name!r}")


def efficiency(real: CastTable, synth: CastTable, target: str, strategies: Sequence[str] = STRATEGIES, task: str | None = None, trials: int = 1, seed: int = 42, runs: int = 1) -> dict:
    """Each strategy's closeness to training and testing on real rows, and one minus the mean gap."""
    task = task_of(real, target, task)
    of = lambda name: prediction_score(*strategy_frames(name, real.frame, synth.frame, seed), real, target, task, trials, seed, runs)
    base, out, gaps = of("ttr"), {}, []
    for name in strategies:
        value = of(name)
        gap = abs(value - base) if task == "classification" else abs(value - base) / base if base > 0 else abs(value)
        gaps.append(min(gap, 1.0))
        out[name] = min(max(1 - gap, 0.0), 1.0)
    return {"task": task, "ttr": base, "strategies": out, "score": min(max(1 - sum(gaps) / len(gaps), 0.0), 1.0)}
