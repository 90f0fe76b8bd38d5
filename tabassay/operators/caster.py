"""Casts to the two kinds of column that metrics know, double and string, as one projection.

What has to be learned (frequent texts) is learned from the real table alone. Rows with a null in any
declared column go before the cast, rows whose cast gives none go after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabassay import schema as S
from tabassay.errors import PreparationError, SchemaError

TEXT_DISTINCT = 100_000
OTHER_TEXT = "OTHER"
# Spellings of booleans.
YES, NO = ("1", "true", "yes", "sí", "si"), ("0", "false", "no")


@dataclass(frozen=True)
class CastTable:
    """A cast table: its frame and the names of its categorical and numeric columns, sorted."""

    frame: DataFrame
    categorical: list[str]
    numeric: list[str]

    @property
    def columns(self) -> list[str]:
        return [*self.categorical, *self.numeric]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def complete(table: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column, whatever the columns' names."""
    for n, t in table.dtypes:
        table = table.filter(quoted(n).isNotNull() & ~F.isnan(quoted(n)) if t in ("double", "float") else quoted(n).isNotNull())
    return table


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def as_double(c: Column, type_name: str = "string") -> Column:
    """Numbers as they are; strings with a decimal comma or point, null if they are no number."""
    if type_name.startswith(NUMBERS):
        return c.cast("double")
    return F.regexp_replace(c.cast("string"), ",", ".").try_cast("double")


def ordinal_rank(c: Column, levels: tuple[str, ...]) -> Column:
    place = F.array_position(F.array(*map(F.lit, levels)), norm_text(c))
    return F.when(place > 0, (place - 1) / F.lit(float(max(len(levels) - 1, 1))))


def discrete_step(c: Column, ranges: tuple[tuple[float, float], ...], type_name: str = "string") -> Column:
    value, out, steps = as_double(c, type_name), None, max(len(ranges) - 1, 1)
    for k, (low, high) in enumerate(ranges):
        hit = value.between(low, high)
        out = F.when(hit, F.lit(k / steps)) if out is None else out.when(hit, F.lit(k / steps))
    return out


def yes_no(c: Column) -> Column:
    text = norm_text(c)
    return F.when(text.isin(*YES), "yes").when(text.isin(*NO), "no")


def seconds(c: Column, type_name: str = "string") -> Column:
    moment = c.cast("timestamp") if type_name in ("timestamp", "date", "timestamp_ntz") else F.try_to_timestamp(c.cast("string"))
    return F.unix_micros(moment) / F.lit(1e6)


def projection(schema: S.TableSchema, frequent: dict[str, DataFrame | None], types: dict[str, str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """(categorical, numeric): output name -> expression."""
    cat: dict[str, Column] = {}
    num: dict[str, Column] = {}
    located = {"lat", "lon"} <= set(schema.columns)
    for name, column in schema.columns.items():
        c = quoted(name)
        if column.kind == S.CONTINUOUS or column.kind == S.GEOSPATIAL and located and name in ("lat", "lon"):
            num[name] = as_double(c, types[name])
        elif column.kind == S.DISCRETE:
            num[name] = discrete_step(c, column.ranges, types[name])
        elif column.kind == S.ORDINAL:
            cat[name], num[f"{name}__ord"] = norm_text(c), ordinal_rank(c, column.levels)
        elif column.kind == S.DATETIME:
            num[f"{name}__ts"] = seconds(c, types[name])
        elif column.kind == S.BOOLEAN:
            cat[name] = yes_no(c)
        elif column.kind == S.CODE_NUMERIC:
            cat[name] = c.cast("string")
        elif column.kind == S.TEXT and frequent.get(name) is not None:
            cat[name] = F.when(quoted(f"__kept_{name}").isNotNull(), norm_text(c)).otherwise(F.lit(OTHER_TEXT))
        else:
            cat[name] = norm_text(c)
    return cat, num


class Caster:
    """Fitted on the real table, applied to both."""

    def __init__(self, schema: S.TableSchema, top_texts: int = TEXT_DISTINCT):
        self.schema, self.top_texts = schema.without_ids(), top_texts
        self.frequent: dict[str, DataFrame | None] = {}

    def fit(self, real: DataFrame) -> Caster:
        self.schema.require(real.columns, "real")
        texts = self.schema.of_kind(S.TEXT)
        if texts:
            counts = real.agg(*[F.approx_count_distinct(norm_text(quoted(n)), 0.01).alias(n) for n in texts]).first()
            for name in texts:
                self.frequent[name] = None
                if counts[name] > 0.97 * self.top_texts:
                    shown = real.select(norm_text(quoted(name)).alias("v")).na.drop().groupBy("v").count()
                    self.frequent[name] = shown.orderBy(F.desc("count"), "v").limit(self.top_texts).select(F.col("v").alias(f"__kept_{name}"))
        return self

    def transform(self, table: DataFrame, side: str = "synthetic") -> CastTable:
        self.schema.require(table.columns, side)
        rows = complete(table.select(*map(quoted, self.schema.columns)))
        for name, kept in self.frequent.items():
            if kept is not None:
                rows = rows.join(kept, norm_text(rows[name]) == kept[f"__kept_{name}"], "left")
        cat, num = projection(self.schema, self.frequent, dict(table.dtypes))
        frame = complete(rows.select(*[e.alias(n) for n, e in {**cat, **num}.items()]))
        return CastTable(frame, sorted(cat), sorted(num))


def prepare(real: DataFrame, synth: DataFrame, schema: S.TableSchema, top_texts: int = TEXT_DISTINCT) -> tuple[CastTable, CastTable]:
    caster = Caster(schema, top_texts).fit(real)
    return caster.transform(real, "real"), caster.transform(synth, "synthetic")


def unseen_levels(table: DataFrame, schema: S.TableSchema) -> dict[str, list[str]]:
    """Declared ordinal levels that no row has."""
    names = schema.of_kind(S.ORDINAL)
    if not names:
        return {}
    seen = table.agg(*[F.collect_set(F.when(norm_text(quoted(n)).isin(*schema.columns[n].levels), norm_text(quoted(n)))).alias(n) for n in names]).first()
    return {n: left for n in names if (left := [v for v in schema.columns[n].levels if v not in seen[n]])}


MIN_ROWS = 10


def validate(real: CastTable, synth: CastTable, target: str | list[str] | None = None, metrics: list[str] = ()) -> dict[str, int]:
    """Row counts of both sides, or an error that names what is wrong; one aggregate a side."""
    if real.columns != synth.columns:
        raise SchemaError("both tables must have the same columns")
    targets = [target] if isinstance(target, str) else list(target or [])
    if any(m.startswith("utility.") for m in metrics) and not targets:
        raise SchemaError("utility metrics need a target")
    unknown = [m for m in metrics if m.split(".")[0] not in ("fidelity", "privacy", "utility")]
    if unknown:
        raise SchemaError(f"unknown metrics: {', '.join(unknown)}")
    for name in targets:
        if name not in real.columns:
            raise SchemaError(f"target {name} is not among the columns")
    counts = {}
    for side, table in (("real", real), ("synthetic", synth)):
        row = table.frame.agg(F.count("*").alias("n"), *[F.count(quoted(c)).alias(f"n{k}") for k, c in enumerate(table.columns)]).first()
        if row["n"] < MIN_ROWS:
            raise PreparationError(f"the {side} table has {row['n']} rows left; {MIN_ROWS} are needed")
        short = [c for k, c in enumerate(table.columns) if row[f"n{k}"] < row["n"]]
        if short:
            raise PreparationError(f"nulls are left in {', '.join(short)} of the {side} table")
        counts[side] = row["n"]
    return counts


def infer_kinds(table: DataFrame) -> dict[str, str]:
    """A proposal for a schema: few distinct numbers are categories, mostly distinct strings are text."""
    numeric = {n for n, t in table.dtypes if t.startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint"))}
    moments = {n for n, t in table.dtypes if t in ("timestamp", "date", "timestamp_ntz")}
    row = table.agg(F.count("*").alias("__n"), *[F.approx_count_distinct(quoted(n)).alias(n) for n in table.columns]).first()
    out = {}
    for n in table.columns:
        if n in numeric:
            out[n] = "categorical_numeric" if row[n] <= min(10, 0.05 * row["__n"]) else S.CONTINUOUS
        elif n in moments:
            out[n] = S.DATETIME
        else:
            out[n] = S.TEXT if row[n] > 0.5 * row["__n"] else S.CATEGORICAL
    return out


FILLERS = {
    "pandas": lambda t, numeric: t,
    "zero": lambda t, numeric: t.na.fill(0, numeric),
    "mode": lambda t, numeric: t.na.fill({n: v for n, v in t.agg(*[F.mode(quoted(n)).alias(n) for n in t.columns]).first().asDict().items() if v is not None}),
}


def fill_missing(table: DataFrame, strategy: str = "pandas") -> DataFrame:
    """Pluggable treatment of nulls: leave them, zero numbers, or the mode of each column."""
    if strategy not in FILLERS:
        raise SchemaError(f"unknown strategy {strategy!r}")
    return FILLERS[strategy](table, [n for n, t in table.dtypes if t not in ("string", "boolean", "timestamp", "date")])


def compare_schemas(real: DataFrame, synth: DataFrame) -> dict:
    """Missing and extra columns, differing types, and numeric ranges of each side."""
    ours, theirs = dict(real.dtypes), dict(synth.dtypes)
    shared = [n for n in ours if n in theirs]
    numbers = [n for n in shared if ours[n] in ("int", "bigint", "double", "float")]
    ranges = {}
    for side, table in (("real", real), ("synthetic", synth)):
        row = table.agg(F.count("*").alias("__n"), *[f(quoted(n)).alias(f"{p}{n}") for n in numbers for p, f in (("a", F.min), ("b", F.max))]).first()
        ranges[side] = {n: (row[f"a{n}"], row[f"b{n}"]) for n in numbers}
    return {"missing": [n for n in ours if n not in theirs], "extra": [n for n in theirs if n not in ours], "types": {n: (ours[n], theirs[n]) for n in shared if ours[n] != theirs[n]}, "ranges": ranges}
