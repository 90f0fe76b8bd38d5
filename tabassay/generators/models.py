"""Generators that learn dependence: Gaussian copula, tree network, per-column trees, oversampling.

Copula, network and per-column trees learn from aggregates over all rows. Oversampling interpolates between rows, for
which it keeps a bounded, hash-ordered sample, whose size is a parameter. All draw rows in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window, functions as F

from tabassay.errors import PreparationError
from tabassay.generators.base import Generator
from tabassay.generators.simple import Bootstrap
from tabassay.operators.caster import CastTable, quoted
from tabassay.operators.frames import cuts_below, row_sample
from tabassay.plans.registry import GENERATORS
from tabassay.plans.storage import checkpointed

#: Donors that oversampling keeps.
SAMPLE = 5000
#: Steps of the quantile function that the copula keeps of a numeric column, and how exactly they are found.
STEPS, ACCURACY = 1000, 100_000
BINS = 5
NEIGHBOURS = 5
NORMAL = NormalDist()
_erf = np.vectorize(math.erf, otypes=[float])


class Drawn(Generator):
    """Rows are drawn by seeded tasks from what was learned."""

    def rows(self, n: int, rng: np.random.Generator) -> pd.DataFrame:
        raise NotImplementedError

    def draw(self, n: int) -> DataFrame:
        seed, make, columns = self.seed, self.rows, self.real.columns
        self.real, real = None, self.real  # a task needs what was learned, not the table

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    yield make(len(part), np.random.default_rng((seed, int(part["id"].iloc[0]))))[columns]

        schema = ", ".join(f"`{c}` {'string' if c in real.categorical else 'double'}" for c in columns)
        out = real.frame.sparkSession.range(n).mapInPandas(batches, schema)
        out.schema  # noqa: B018  the function is packed here, before the table returns
        self.real = real
        return out


def level_counts(real: CastTable) -> dict[str, dict[str, int]]:
    """How often each string of each text column comes, over all rows, strings in order."""
    if not real.categorical:
        return {}
    long = real.frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in real.categorical])).alias("p"))
    out: dict[str, dict[str, int]] = {c: {} for c in real.categorical}
    for r in sorted(long.groupBy("p.column", "p.value").count().collect(), key=lambda r: r["value"]):
        out[r["column"]][r["value"]] = r["count"]
    return out


def quantiles_of(real: CastTable, shares: Sequence[float]) -> dict[str, np.ndarray]:
    """Quantiles of every numeric column over all rows, from one aggregate."""
    if not real.numeric:
        return {}
    row = real.frame.agg(*[F.percentile_approx(quoted(c), list(shares), ACCURACY).alias(f"q{k}") for k, c in enumerate(real.numeric)]).first()
    return {c: np.array(row[f"q{k}"], float) for k, c in enumerate(real.numeric)}


def rows_of(real: CastTable) -> int:
    n = real.frame.count()
    if not n:
        raise PreparationError("there is no row to learn from")
    return n


@GENERATORS.register("gaussian_copula")
class GaussianCopula(Drawn):
    """Normal scores of ranks, their correlation, and back through the empirical quantiles.

    A number's rank is its place among STEPS quantiles, between them by its value and in the middle of equal ones; a string's the middle of its share.
    Scores are column expressions, and their covariances one aggregate over all rows.
    """

    def fit(self, real: CastTable) -> Generator:
        super().fit(real)
        n = rows_of(real)
        score = lambda u: NORMAL.inv_cdf(min(max(u, 1e-6, 0.5 / n), 1 - max(1e-6, 0.5 / n)))
        grid = np.linspace(0, 1, STEPS + 1)
        quantiles, levels = quantiles_of(real, grid.tolist()), level_counts(real)
        scores = F.array(*[F.lit(score(u)) for u in grid])
        frame, self.marks = real.frame, {}
        for k, c in enumerate(real.columns):
            if c in levels:
                shares = np.array(list(levels[c].values())) / n
                ends = np.cumsum(shares)
                self.marks[c] = (list(levels[c]), ends)
                middle = [(v, score(e - p / 2)) for v, e, p in zip(levels[c], ends.tolist(), shares.tolist(), strict=True)]
                places = frame.sparkSession.createDataFrame(middle, f"__v string, __z{k} double")
                frame = frame.join(places, quoted(c) == F.col("__v")).drop("__v")
                continue
            self.marks[c] = (None, quantiles[c])
            cuts, value = F.array(*[F.lit(float(q)) for q in quantiles[c]]), quoted(c)
            frame = frame.withColumn("__low", cuts_below(cuts, value)).withColumn("__high", cuts_below(cuts, value, True))
            left = F.get(cuts, F.col("__low") - 1)
            between = F.when(F.col("__low") > 0, F.col("__low") - 1 + (value - left) / (F.get(cuts, F.col("__low")) - left)).otherwise(F.lit(0.0))
            place = F.when(F.col("__high") > F.col("__low"), (F.col("__low") + F.col("__high") - 1) / 2).when(F.col("__low") > STEPS, F.lit(float(STEPS))).otherwise(between)
            frame = frame.withColumn("__place", place).withColumn("__at", F.least(F.floor("__place"), F.lit(STEPS - 1)).cast("int"))
            lower, upper = F.get(scores, F.col("__at")), F.get(scores, F.col("__at") + 1)
            frame = frame.withColumn(f"__z{k}", lower + (upper - lower) * (F.col("__place") - F.col("__at"))).drop("__low", "__high", "__place", "__at")
        size = len(real.columns)
        row = frame.agg(*[F.covar_pop(f"__z{i}", f"__z{j}").alias(f"c{i}_{j}") for i in range(size) for j in range(i, size)]).first()
        cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        self.root = np.linalg.cholesky(cov / np.outer(scale, scale) * (1 - 1e-6) + 2e-6 * np.eye(size))
        return self

    def rows(self, n: int, rng: np.random.Generator) -> pd.DataFrame:
        u = (1 + _erf(rng.standard_normal((n, len(self.root))) @ self.root.T / math.sqrt(2))) / 2
        out = {}
        for k, (c, (values, marks)) in enumerate(self.marks.items()):
            if values is None:
                out[c] = np.interp(u[:, k], np.linspace(0, 1, len(marks)), marks)
            else:
                out[c] = [values[i] for i in np.minimum(np.searchsorted(marks, u[:, k]), len(values) - 1)]
        return pd.DataFrame(out)


@GENERATORS.register("bayesian_network")
class TreeNetwork(Drawn):
    """A tree of the strongest pairwise dependences (mutual information) over quantile bins, drawn from the root down.

    Bins and the tables of every two columns are counted over all rows; only tables reach the driver.
    """

    def fit(self, real: CastTable) -> Generator:
        super().fit(real)
        rows, names, codes = rows_of(real), real.columns, []
        edges, levels = {c: np.unique(q) for c, q in quantiles_of(real, np.linspace(0, 1, BINS + 1).tolist()).items()}, level_counts(real)
        self.values, place = {}, {}
        for k, c in enumerate(names):
            if c in levels:
                self.values[c], place[c] = list(levels[c]), {v: n for n, v in enumerate(levels[c])}
                codes.append(quoted(c).alias(f"k{k}"))
                continue
            own = edges[c] if len(edges[c]) > 1 else np.repeat(edges[c], 2)
            self.values[c], place[c] = own, {str(n): n for n in range(len(own) - 1)}
            codes.append(sum((F.when(quoted(c) >= float(e), 1).otherwise(0) for e in own[1:-1]), F.lit(0)).cast("string").alias(f"k{k}"))
        numbers = list(combinations(range(len(names)), 2)) + [(k, k) for k in range(len(names))]
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"k{i}").alias("a"), F.col(f"k{j}").alias("b")) for i, j in numbers])).alias("p")
        tables = {(names[i], names[j]): np.zeros((len(place[names[i]]), len(place[names[j]]))) for i, j in numbers}
        for r in real.frame.select(*codes).select(pairs).groupBy("p.i", "p.j", "p.a", "p.b").count().collect():
            a, b = names[r["i"]], names[r["j"]]
            tables[a, b][place[a][r["a"]], place[b][r["b"]]] += r["count"]
        joint = lambda a, b: tables[a, b] if (a, b) in tables else tables[b, a].T

        def information(a: str, b: str) -> float:
            p = joint(a, b) / rows
            q = np.outer(p.sum(axis=1), p.sum(axis=0))
            return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())

        self.order, left = [(names[0], None)], set(names[1:])
        while left:
            _, parent, child = max((information(p, c), p, c) for p, _ in self.order for c in left)
            self.order.append((child, parent))
            left.discard(child)
        self.tables = {}
        for c, parent in self.order:
            t = joint(parent, c) if parent else np.diag(joint(c, c))[None].astype(float)
            self.tables[c] = np.cumsum((t + 1e-9) / (t + 1e-9).sum(axis=1, keepdims=True), axis=1)
        return self

    def rows(self, n: int, rng: np.random.Generator) -> pd.DataFrame:
        codes, out = {}, {}
        for c, parent in self.order:
            table = self.tables[c][codes[parent]] if parent else np.repeat(self.tables[c], n, axis=0)
            codes[c] = np.minimum((rng.random(n)[:, None] > table).sum(axis=1), table.shape[1] - 1)
            v = self.values[c]
            out[c] = [v[i] for i in codes[c]] if isinstance(v, list) else v[codes[c]] + rng.random(n) * (v[np.minimum(codes[c] + 1, len(v) - 1)] - v[codes[c]])
        return pd.DataFrame(out)


GENERATORS.register("bn")(TreeNetwork)


@GENERATORS.register("smotenc")
class Oversampling(Drawn):
    """Between a row and one of its nearest of the same class: numbers are interpolated, strings are what most neighbours have.

    A numeric target is cut into quantile bins that serve as classes. At most ``sample`` rows, in the order of a hash, are donors.
    """

    def __init__(self, seed: int = 42, sample: int = SAMPLE, target: str | None = None):
        super().__init__(seed)
        self.sample, self.target = sample, target

    def fit(self, real: CastTable) -> Generator:
        super().fit(real)
        rows = row_sample(real.frame.select(*map(quoted, real.columns)), self.sample, self.seed).toPandas()
        if rows.empty:
            raise PreparationError("there is no row to learn from")
        self.learn(rows)
        return self

    def learn(self, rows: pd.DataFrame) -> None:
        self.table, self.numeric, self.categorical = rows.reset_index(drop=True), self.real.numeric, self.real.categorical
        y = rows[self.target].reset_index(drop=True) if self.target else pd.Series(np.zeros(len(rows)))
        classes = pd.qcut(y, BINS, labels=False, duplicates="drop") if self.target in self.numeric else pd.factorize(y)[0]
        self.members = [np.flatnonzero(np.asarray(classes) == k) for k in np.unique(np.asarray(classes))]
        x = self.table[self.numeric].to_numpy(float)
        scale = x.std(axis=0)
        self.x = x / np.where(scale > 0, scale, 1)

    def rows(self, n: int, rng: np.random.Generator) -> pd.DataFrame:
        sizes = np.array([len(m) for m in self.members], float)
        chosen = rng.choice(len(self.members), n, p=sizes / sizes.sum())
        out = pd.DataFrame(index=range(n), columns=self.table.columns, dtype=object)
        for k, members in enumerate(self.members):
            at = np.flatnonzero(chosen == k)
            for part in np.array_split(at, max(len(at) // 256, 1)):
                if not len(part):
                    continue
                base = members[rng.integers(0, len(members), len(part))]
                apart = ((self.x[members] ** 2).sum(axis=1)[None] - 2 * self.x[base] @ self.x[members].T) if self.x.shape[1] else np.zeros((len(part), len(members)))
                near = members[np.argsort(apart, axis=1)[:, 1 : NEIGHBOURS + 1]] if len(members) > 1 else base[:, None]
                other = near[np.arange(len(part)), rng.integers(0, near.shape[1], len(part))]
                share = rng.random(len(part))[:, None]
                a, b = (self.table[self.numeric].to_numpy(float)[i] for i in (base, other))
                out.loc[part, self.numeric] = a + share * (b - a)
                for c in self.categorical:
                    v = self.table[c].to_numpy()[near]
                    out.loc[part, c] = [max(set(r), key=lambda s, r=r: (list(r).count(s), s)) for r in v]
        return out.astype(dict.fromkeys(self.numeric, float))


@GENERATORS.register("cart")
class Trees(Generator):
    """One decision tree per column given the others, on all real rows; a bootstrap then passes the columns several times.

    A new value comes from a random real row of the same leaf: donors are numbered per leaf and joined by a random number.
    """

    def __init__(self, seed: int = 42, sweeps: int = 3, depth: int = 6):
        super().__init__(seed)
        self.sweeps, self.depth = sweeps, depth

    def draw(self, n: int) -> DataFrame:
        real, names = self.real, self.real.columns
        plain = {c: f"c{k}" for k, c in enumerate(names)}
        rows = checkpointed(real.frame.select(*[quoted(c).alias(plain[c]) for c in names]))
        now = checkpointed(Bootstrap(self.seed).fit(real).generate(n).frame.select(*[quoted(c).alias(plain[c]) for c in names]))
        categorical = [plain[c] for c in real.categorical]
        models = {}
        for c in names:
            y = plain[c]
            others = [x for x in plain.values() if x != y]
            cats = [x for x in others if x in categorical]
            stages = [StringIndexer(inputCols=cats, outputCols=[f"{x}__i" for x in cats], handleInvalid="keep")] if cats else []
            stages.append(VectorAssembler(inputCols=[f"{x}__i" if x in cats else x for x in others], outputCol="features", handleInvalid="keep"))
            bins = max([64, *[rows.select(x).distinct().count() + 2 for x in cats]])
            tree = {"maxDepth": self.depth, "maxBins": bins, "seed": self.seed, "leafCol": "leaf", "labelCol": "label"}
            if y in categorical:
                stages += [StringIndexer(inputCol=y, outputCol="label", handleInvalid="keep"), DecisionTreeClassifier(**tree)]
                train = rows
            else:
                stages.append(DecisionTreeRegressor(**tree))
                train = rows.withColumn("label", F.col(y))
            model = Pipeline(stages=stages).fit(train)
            leaves = model.transform(train).select(F.col("leaf").cast("int").alias("leaf"), F.col(y).alias("donor"))
            by_leaf = Window.partitionBy("leaf").orderBy(F.xxhash64("donor", F.lit(self.seed)))
            models[y] = model, checkpointed(leaves.withColumn("k", F.row_number().over(by_leaf) - 1)), y in categorical
        for sweep in range(self.sweeps):
            for j, (y, (model, donors, is_text)) in enumerate(models.items()):
                size = donors.groupBy("leaf").agg(F.count("*").alias("size"))
                given = now if is_text else now.withColumn("label", F.col(y))
                placed = model.transform(given).select(*plain.values(), F.col("leaf").cast("int").alias("leaf")).join(F.broadcast(size), "leaf")
                picked = placed.withColumn("k", F.floor(F.rand(self.seed + 97 * sweep + j) * F.col("size")).cast("int"))
                now = checkpointed(picked.join(donors, ["leaf", "k"]).select(*[F.col("donor").alias(x) if x == y else F.col(x) for x in plain.values()]))
        return now.select(*[F.col(p).alias(c) for c, p in plain.items()])


class External(Generator):
    """Rows made elsewhere (deep generative models): give them as ``rows``, cast like the real table."""

    def __init__(self, seed: int = 42, rows: CastTable | None = None):
        super().__init__(seed)
        self.external = rows

    def draw(self, n: int) -> DataFrame:
        if self.external is None:
            raise PreparationError("this generator takes a table made outside; pass it as rows")
        return self.external.frame.limit(n)


for _name in ("ctgan", "tvae", "adsgan", "dpctgan"):
    GENERATORS.register(_name)(type(_name.upper(), (External,), {"__doc__": External.__doc__}))
