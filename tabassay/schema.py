"""Declared semantic types of columns; nothing is inferred on the way to a score."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from tabassay.errors import ConfigError, SchemaError

# The semantic types.
CONTINUOUS, DISCRETE, CATEGORICAL, ORDINAL, BOOLEAN = "continuous", "discrete", "categorical", "ordinal", "boolean"
DATETIME, GEOSPATIAL, TEXT, CODE_NUMERIC, ID = "datetime", "geospatial", "text", "code_numeric", "id"
KINDS = (CONTINUOUS, DISCRETE, CATEGORICAL, ORDINAL, BOOLEAN, DATETIME, GEOSPATIAL, TEXT, CODE_NUMERIC, ID)


@dataclass(frozen=True)
class ColumnType:
    """A kind and what it needs: levels of an ordinal, inclusive (low, high) ranges of a discrete column."""

    kind: str
    levels: tuple[str, ...] = ()
    ranges: tuple[tuple[float, float], ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise SchemaError(f"unknown column type {self.kind!r}; known: {', '.join(KINDS)}")
        if self.kind == ORDINAL and not self.levels:
            raise SchemaError("an ordinal column declares its levels")
        if self.kind == DISCRETE and not self.ranges:
            raise SchemaError("a discrete column declares its ranges")

    @classmethod
    def of(cls, spec: str | Mapping) -> ColumnType:
        if isinstance(spec, str):
            return cls(spec)
        if "type" not in spec:
            raise SchemaError(f"a column specification names its type: {dict(spec)}")
        ranges = tuple((float(low), float(high)) for low, high in spec.get("ranges", ()))
        return cls(spec["type"], tuple(str(v).strip().lower() for v in spec.get("levels", ())), ranges)


@dataclass(frozen=True)
class TableSchema:
    columns: dict[str, ColumnType] = field(default_factory=dict)

    @classmethod
    def of(cls, spec: Mapping[str, str | Mapping] | None) -> TableSchema:
        if not spec:
            raise ConfigError("data.schema is required: a type for every column")
        return cls({name: ColumnType.of(kind) for name, kind in spec.items()})

    def of_kind(self, *kinds: str) -> list[str]:
        return [name for name, column in self.columns.items() if column.kind in kinds]

    def without_ids(self) -> TableSchema:
        return TableSchema({n: c for n, c in self.columns.items() if c.kind != ID})

    def only(self, names) -> TableSchema:
        kept = set(names)
        return TableSchema({n: c for n, c in self.columns.items() if n in kept})

    def require(self, columns: list[str], side: str) -> None:
        missing = [n for n in self.columns if n not in columns]
        if missing:
            raise SchemaError(f"the {side} table lacks {', '.join(missing)}")
