"""Bounds for scores: real against real above, real against noise below."""

from __future__ import annotations

import hashlib
import json
import logging
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tabassay.errors import ConfigError
from tabassay.functions.aggregate import aggregate
from tabassay.generators.simple import halves, uniform_noise
from tabassay.operators.caster import CastTable, quoted
from tabassay.plans.evaluate import EvalPlan, evaluate_cast, roll_up

LOG = logging.getLogger("tabassay")
# Aggregators that tuning chooses among, and families in which real scores below noise by nature.
CANDIDATES = ("mean", "median", "trimmed_mean_10", "fsd", "ssd")
TURNED = {"privacy"}
GOOD_ENOUGH = 1e-6


def place(value: float, low: float, high: float, inverted: bool = False) -> float:
    """Where a value lies between bounds, in [0, 1]; bounds that meet are a threshold."""
    if not math.isfinite(value):
        return math.nan
    x = min(max((value - low) / (high - low), 0.0), 1.0) if abs(high - low) > 1e-10 else float(value >= high)
    return 1 - x if inverted else x


@dataclass
class FamilyBounds:
    low: float
    high: float
    inverted: bool = False
    low_runs: list[float] = field(default_factory=list)
    high_runs: list[float] = field(default_factory=list)


@dataclass
class Bounds:
    """Bounds per family and of the composite, the aggregators tuned to them, and what they were made from."""

    families: dict[str, FamilyBounds] = field(default_factory=dict)
    aggregators: dict[str, str] = field(default_factory=dict)
    composite: str = "ssd"
    fingerprint: dict = field(default_factory=dict)

    def calibrated(self, scores: Mapping[str, float]) -> dict[str, float]:
        out = {f: place(v, b.low, b.high, b.inverted) for f, v in scores.items() if (b := self.families.get(f))}
        rest = [v for v in out.values() if math.isfinite(v)]
        return out | {"composite": aggregate(self.composite, rest) if rest else math.nan}

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str | Path) -> Bounds:
        try:
            d = json.loads(Path(path).read_text())
            return cls({f: FamilyBounds(**b) for f, b in d["families"].items()}, d["aggregators"], d["composite"], d["fingerprint"])
        except (KeyError, TypeError, ValueError) as error:
            raise ConfigError(f"{path} holds no bounds: {error}") from error

    def matches(self, fingerprint: Mapping) -> bool:
        return dict(self.fingerprint) == dict(fingerprint)

    def summary(self) -> dict:
        return {f: {"low": b.low, "high": b.high, "inverted": b.inverted, "width": b.high - b.low} for f, b in self.families.items()}


def bounds_of(upper: list[float], lower: list[float], family: str) -> FamilyBounds:
    """The least upper and the greatest lower run; swapped where the medians stand the other way round."""
    up, low = [v for v in upper if math.isfinite(v)], [v for v in lower if math.isfinite(v)]
    if not up or not low:
        raise ConfigError(f"no finite runs for {family}")
    if np.median(up) < np.median(low):
        return FamilyBounds(max(up), min(low), family not in TURNED, up, low)
    return FamilyBounds(max(low), min(up), False, low, up)


def tuned(upper: list[list[float]], lower: list[list[float]]) -> tuple[str, float]:
    """The aggregator whose mean scores come nearest to 1 and 0, whichever way round."""
    best, error = "median", math.inf
    for name in CANDIDATES:
        u, w = float(np.mean([aggregate(name, v) for v in upper])), float(np.mean([aggregate(name, v) for v in lower]))
        e = min((u - 1) ** 2 + w**2, u**2 + (w - 1) ** 2)
        if e < error:
            best, error = name, e
        if error < GOOD_ENOUGH:
            break
    return best, error


def fingerprint(table: DataFrame, config: Mapping | None = None) -> dict:
    """Columns, rows, and sums of row hashes that do not depend on the order; with the configuration's digest."""
    h = F.xxhash64(*map(quoted, table.columns))
    row = table.agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")) if "h" in table.columns else table.select(h.alias("h")).agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s"))
    r = row.first()
    return {"columns": table.columns, "rows": r["n"], "xor": r["x"], "sum": r["s"], "config": hashlib.sha256(json.dumps(config or {}, sort_keys=True, default=str).encode()).hexdigest()}


def calibrate(real: CastTable, plan: EvalPlan, iterations: int = 5, sample: float = 1.0, tune: bool = True) -> Bounds:
    """Runs of halves of the real table against each other and of the real table against noise; failed runs are passed over."""
    runs: dict[str, list] = {"upper": [], "lower": []}
    for k in range(iterations):
        seed = plan.seed + k
        a, b = halves(real, seed, sample)
        for side, (x, y) in {"upper": (a, b), "lower": (real, uniform_noise(real, seed))}.items():
            try:
                runs[side].append(evaluate_cast(x, y, plan))
            except Exception as error:
                LOG.warning("calibration run %d (%s) failed: %s", k, side, error)
    out = Bounds(fingerprint=fingerprint(real.frame, {"metrics": plan.metrics, "iterations": iterations, "sample": sample, "seed": plan.seed}))
    by_family = {side: [{} for _ in results] for side, results in runs.items()}
    for side, results in runs.items():
        for k, rs in enumerate(results):
            for r in rs:
                if r.valid:
                    by_family[side][k].setdefault(r.family, []).append(r.value)
    for family in sorted({f for rows in by_family.values() for d in rows for f in d}):
        upper, lower = ([d[family] for d in by_family[side] if family in d] for side in ("upper", "lower"))
        if not upper or not lower:
            continue
        out.aggregators[family] = tuned(upper, lower)[0] if tune else plan.layers.high
        name = out.aggregators[family]
        out.families[family] = bounds_of([aggregate(name, v) for v in upper], [aggregate(name, v) for v in lower], family)
    if tune and out.families:
        high = [[place(b.high, b.low, b.high, b.inverted) for b in out.families.values()]]
        low = [[place(b.low, b.low, b.high, b.inverted) for b in out.families.values()]]
        out.composite = tuned(high, low)[0]
    return out


class BoundsCache:
    """Bounds by fingerprint, one JSON file each."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def path(self, key: Mapping) -> Path:
        return self.folder / f"bounds_{hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]}.json"

    def get_or_calibrate(self, real: CastTable, plan: EvalPlan, **options) -> Bounds:
        settings = {"metrics": plan.metrics, "iterations": options.get("iterations", 5), "sample": options.get("sample", 1.0), "seed": plan.seed}
        key = fingerprint(real.frame, settings)
        path = self.path(key)
        if path.exists():
            found = Bounds.load(path)
            if found.matches(key):
                return found
        made = calibrate(real, plan, **options)
        self.folder.mkdir(parents=True, exist_ok=True)
        made.save(path)
        return made

    def clear(self) -> int:
        files = list(self.folder.glob("bounds_*.json"))
        for f in files:
            f.unlink()
        return len(files)


def calibrated_scores(results, bounds: Bounds, plan: EvalPlan) -> dict:
    """Family scores by the tuned aggregators, placed between the bounds."""
    values: dict[str, list[float]] = {}
    for r in results:
        if r.valid:
            values.setdefault(r.family, []).append(r.value)
    families = {f: aggregate(bounds.aggregators.get(f, plan.layers.high), v) for f, v in values.items()}
    return roll_up(results, plan.layers, plan.aversion) | {"calibrated": bounds.calibrated(families)}
