"""What every generator does: learn from a cast real table, then give rows of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabassay.errors import PreparationError
from tabassay.operators.caster import CastTable


class Generator:
    def __init__(self, seed: int = 42):
        self.seed = seed
        self.real: CastTable | None = None

    def fit(self, real: CastTable) -> Generator:
        self.real = real
        return self

    def generate(self, n: int | None = None) -> CastTable:
        """About ``n`` rows (by default as many as the real table has)."""
        if self.real is None:
            raise PreparationError("fit a generator before it generates")
        return self.like(self.draw(self.real.frame.count() if n is None else n))

    def draw(self, n: int) -> DataFrame:
        raise NotImplementedError

    def like(self, frame: DataFrame) -> CastTable:
        return CastTable(frame, self.real.categorical, self.real.numeric)

    def fit_generate(self, real: CastTable, n: int | None = None) -> CastTable:
        return self.fit(real).generate(n)
