"""python -m tabassay.plans.cli evaluate|calibrate|benchmark|version"""

from __future__ import annotations

import argparse
import json

from tabassay.plans.api import benchmark_from_config, calibrate_from_config, evaluate_from_config

VERSION = "0.1.0"


def main(args: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="tabassay")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("evaluate", "calibrate", "benchmark"):
        sub = commands.add_parser(name)
        sub.add_argument("--config", "-c", required=True)
        if name == "calibrate":
            sub.add_argument("--output", "-o")
    commands.add_parser("version")
    given = parser.parse_args(args)
    if given.command == "version":
        print(VERSION)
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tabassay").getOrCreate()
    if given.command == "evaluate":
        s = evaluate_from_config(spark, given.config)
        print(json.dumps({"composite": s.scores["composite"], "families": s.scores["families"], "failed": s.scores["counts"]["failed"]}))
        return int(s.scores["counts"]["valid"] == 0)
    if given.command == "calibrate":
        print(json.dumps(calibrate_from_config(spark, given.config, given.output).summary()))
        return 0
    print(json.dumps(benchmark_from_config(spark, given.config)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
