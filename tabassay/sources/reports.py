"""Reports of a run: JSON and Markdown, and any other that is registered."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from pathlib import Path

from tabassay.errors import ConfigError
from tabassay.plans.evaluate import RunSummary
from tabassay.plans.registry import REPORTERS


def inside(folder: str | Path, *parts: str) -> Path:
    """A path below ``folder``; one that leads out of it is an error."""
    base = Path(folder).resolve()
    path = base.joinpath(*parts).resolve()
    if path != base and base not in path.parents:
        raise ConfigError(f"{path} lies outside {base}")
    return path


def plain(value):
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, str | int | float | bool | None) else str(value)


@REPORTERS.register("json")
def write_json(summary: RunSummary, folder: str | Path) -> list[Path]:
    """summary.json (scores and hierarchy) and all_metrics.json (every value with its details)."""
    out = []
    for name, body in {
        "summary.json": {"seed": summary.plan.seed, "metrics": summary.plan.metrics, "scores": summary.scores, "artifacts": summary.artifacts},
        "all_metrics.json": {r.id: {"value": r.value, "family": r.family, "details": r.details} for r in summary.results},
    }.items():
        path = inside(folder, name)
        path.write_text(json.dumps(plain(body), indent=1, ensure_ascii=False))
        out.append(path)
    return out


@REPORTERS.register("md")
def write_markdown(summary: RunSummary, folder: str | Path) -> list[Path]:
    show = lambda v: "-" if v is None or not math.isfinite(v) else f"{v:.4f}"
    lines = ["# Evaluation", "", f"Composite: **{show(summary.scores['composite'])}**", "", "| family | score |", "|---|---|"]
    lines += [f"| {f} | {show(v)} |" for f, v in summary.scores["families"].items()]
    for family, tree in summary.scores["hierarchy"].items():
        lines += ["", f"## {family}", "", "| category | subcategory | score | metrics |", "|---|---|---|---|"]
        for category, c in tree["categories"].items():
            lines += [f"| {category} | {s.replace('_direct', '')} | {show(x['score'])} | {x['count']} |" for s, x in c["subcategories"].items()]
    lines += ["", "## Metrics", "", "| metric | value |", "|---|---|", *[f"| {r.id} | {show(r.value)} |" for r in summary.results]]
    failures = [r for r in summary.results if not r.valid]
    if failures:
        lines += ["", "## Without a value", "", *[f"- {r.id}: {r.details.get('error', 'no valid input')}" for r in failures]]
    path = inside(folder, "summary.md")
    path.write_text("\n".join(lines) + "\n")
    return [path]


def write_reports(summary: RunSummary, folder: str | Path, formats: Iterable[str] = ("json", "md")) -> list[Path]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    return [p for f in formats for p in REPORTERS[f](summary, folder)]
