"""Anchors and resampling: halves, uniform noise, bootstrap, masked cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabassay.generators.base import Generator
from tabassay.operators.caster import CastTable, quoted
from tabassay.plans.registry import GENERATORS
from tabassay.plans.storage import checkpointed

MISSING = "MISSING"


def unit_of_row(table: DataFrame, seed: int):
    return F.pmod(F.xxhash64(*map(quoted, table.columns), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def halves(real: CastTable, seed: int, share: float = 1.0) -> tuple[CastTable, CastTable]:
    """Two random halves, each of ``share`` of its rows; equal rows are told apart by chance, so the split is written down."""
    mixed = checkpointed(real.frame.withColumn("__u", F.rand(seed)))
    of = lambda low, high: CastTable(mixed.filter((F.col("__u") >= low) & (F.col("__u") < high)).drop("__u"), real.categorical, real.numeric)
    return of(0.0, 0.5 * share), of(0.5, 0.5 + 0.5 * share)


def uniform_noise(real: CastTable, seed: int, n: int | None = None) -> CastTable:
    """Numbers between a column's ends (whole where all are), strings evenly from those seen; null columns are MISSING.

    Distinct strings are numbered in a small table and joined by a random number, so none has to fit a task.
    """
    numeric, categorical = real.numeric, real.categorical
    row = real.frame.agg(F.count("*").alias("n"), *[f for k, c in enumerate(numeric) for f in (F.min(quoted(c)).alias(f"a{k}"), F.max(quoted(c)).alias(f"b{k}"), F.max(F.abs(quoted(c) - F.round(quoted(c)))).alias(f"w{k}"))]).first()
    out = real.frame.sparkSession.range(row["n"] if n is None else n)
    for k, c in enumerate(numeric):
        a, b, u = row[f"a{k}"], row[f"b{k}"], F.rand(seed * 1009 + k)
        value = F.lit(None).cast("double") if a is None else F.floor(F.lit(a) + u * (b - a + 1)) if row[f"w{k}"] == 0 else F.lit(a) + u * (b - a)
        out = out.withColumn(c, F.least(value.cast("double"), F.lit(b)) if a is not None else value)
    for k, c in enumerate(categorical):
        seen = real.frame.select(quoted(c).alias(c)).na.drop().distinct()
        seen = checkpointed(seen.withColumn("__k", F.row_number().over(Window.orderBy(c)) - 1))
        size = seen.count()
        if not size:
            out = out.withColumn(c, F.lit(MISSING))
            continue
        out = out.withColumn("__k", F.floor(F.rand(seed * 2003 + k) * size).cast("int")).join(seen, "__k").drop("__k")
    return CastTable(out.select(*map(quoted, real.columns)), categorical, numeric)


@GENERATORS.register("real_data")
class RealData(Generator):
    """A random half of the real rows; ``reference`` is the other."""

    def fit(self, real: CastTable) -> Generator:
        super().fit(real)
        self.half, self.reference = halves(real, self.seed)
        return self

    def draw(self, n: int) -> DataFrame:
        return self.half.frame.limit(n)


@GENERATORS.register("uniform_noise")
class UniformNoise(Generator):
    def draw(self, n: int) -> DataFrame:
        return uniform_noise(self.real, self.seed, n).frame


@GENERATORS.register("bootstrap")
class Bootstrap(Generator):
    """Rows with replacement: every row independently as often as a Poisson number says, which needs no shuffle; n is met on average."""

    def draw(self, n: int) -> DataFrame:
        rows = max(self.real.frame.count(), 1)
        return self.real.frame.sample(withReplacement=True, fraction=n / rows, seed=self.seed)


class Masked(Bootstrap):
    """Bootstrap rows whose cells are lost with a probability and filled again by one rule."""

    filler = "zero"

    def __init__(self, seed: int = 42, share: float = 0.3):
        super().__init__(seed)
        self.share = share

    def fills(self) -> dict[str, object]:
        real = self.real
        modes = {c: F.mode(quoted(c)) for c in real.categorical}
        numbers = {"zero": lambda c: F.lit(0.0), "mean": lambda c: F.avg(quoted(c)), "median": lambda c: F.percentile(quoted(c), 0.5), "mode": lambda c: F.mode(quoted(c))}[self.filler]
        names = [*real.categorical, *real.numeric]
        row = real.frame.agg(*[(modes[c] if c in modes else F.max(numbers(c)) if self.filler == "zero" else numbers(c)).alias(f"v{k}") for k, c in enumerate(names)]).first()
        return {c: row[f"v{k}"] for k, c in enumerate(names)}

    def draw(self, n: int) -> DataFrame:
        fills = self.fills()
        return super().draw(n).select(*[F.when(F.rand(self.seed * 31 + k) < self.share, F.lit(fills[c])).otherwise(quoted(c)).alias(c) for k, c in enumerate(self.real.columns)])


for _name in ("zero", "mean", "median", "mode"):
    GENERATORS.register(f"delete_{_name}")(type(f"Delete{_name.title()}", (Masked,), {"filler": _name, "__doc__": f"Lost cells become the {_name} (strings: the mode)."}))
