"""Small results kept by key, the least used dropped first; hashed folds."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabassay.operators.caster import quoted

MOST = 1000


class StatsStore:
    """``get(key, make)`` computes once; keys read like ``univariate:real:age``."""

    def __init__(self, most: int = MOST):
        self.most, self.kept, self.hits, self.misses = most, OrderedDict(), 0, 0

    def get(self, key: str, make: Callable[[], Any]) -> Any:
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
        else:
            self.misses += 1
            self.kept[key] = make()
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[key]

    def statistics(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.kept), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}

    def clear(self) -> None:
        self.kept.clear()
        self.hits = self.misses = 0


def key_of(kind: str, side: str, *columns: str) -> str:
    return ":".join((kind, side, *columns))


def folds(frame: DataFrame, k: int, seed: int = 42) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) of k folds by a hash of the row: the same on every run, no shuffle; equal rows share a fold."""
    if k < 2:
        raise ValueError("two folds are needed")
    mark = F.pmod(F.xxhash64(*map(quoted, frame.columns), F.lit(seed)), F.lit(k))
    for i in range(k):
        yield frame.filter(mark != i), frame.filter(mark == i)


def safe_divide(a, b, otherwise: float = 0.0):
    """Column division with a value where the divisor is 0 or missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))
