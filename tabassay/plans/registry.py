"""Names that a user can add to: metrics, generators, reporters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tabassay.errors import RegistryError


class Registry(dict):
    """name -> object, each name once."""

    def __init__(self, what: str):
        super().__init__()
        self.what = what

    def register(self, name: str) -> Callable[[Any], Any]:
        def add(item: Any) -> Any:
            if name in self:
                raise RegistryError(f"{self.what} {name!r} is registered already")
            self[name] = item
            return item

        return add

    def __missing__(self, name: str):
        raise RegistryError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self)) or 'none'}")


#: id -> function (real: CastTable, synth: CastTable, plan: EvalPlan) -> {"score": ..., ...}
METRICS = Registry("metric")
GENERATORS = Registry("generator")
REPORTERS = Registry("reporter")
