"""YAML configurations: read, checked, merged, written."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from tabassay.errors import ConfigError


def merge(base: Mapping, over: Mapping) -> dict:
    """Recursively; what is over wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def metrics_of(config: Mapping) -> list[str]:
    if isinstance(config.get("metrics"), list):
        return config["metrics"]
    evaluation = config.get("evaluation")
    return list(evaluation.get("metric_ids", [])) if isinstance(evaluation, Mapping) else []


def check(config: Mapping, where: str = "configuration") -> dict:
    if not isinstance(config.get("data"), Mapping):
        raise ConfigError(f"{where}: a data section is required")
    for key in ("real", "synthetic"):
        if key not in config["data"]:
            raise ConfigError(f"{where}: data.{key} is required")
    if not metrics_of(config):
        raise ConfigError(f"{where}: a list of metrics is required")
    for section in ("evaluation", "report", "aggregation", "calibration"):
        if section in config and not isinstance(config[section], Mapping):
            raise ConfigError(f"{where}: {section} must be a mapping")
    for key in ("formats", "output_dir"):
        if "report" in config and key not in config["report"]:
            raise ConfigError(f"{where}: report.{key} is required")
    aversion = config.get("aggregation", {}).get("risk_aversion", 5.0)
    if not isinstance(aversion, int | float) or aversion <= 0:
        raise ConfigError(f"{where}: risk_aversion must be a number above 0")
    return dict(config)


def load_config(path: str | Path) -> dict:
    import yaml

    try:
        config = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as error:
        raise ConfigError(f"{path} can't be read: {error}") from error
    if not isinstance(config, Mapping):
        raise ConfigError(f"{path} holds no mapping")
    return check(config, str(path))


def save_config(config: Mapping, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(dict(config), sort_keys=False, allow_unicode=True))
