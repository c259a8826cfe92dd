"""The command line of a job: a config file's options, overridden by flags; it alone creates and stops a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

from sievework.sources.jsonl import read_config


def main(job: Callable[..., dict], name: str, options: dict[str, type], argv: list[str] | None = None) -> dict:
    """Runs `job` with the options of the config file and the flags; prints and returns what it did."""
    parser = argparse.ArgumentParser(prog=name, description=job.__doc__)
    parser.add_argument("--config", help="a JSON object of the options below")
    for option, kind in options.items():
        parser.add_argument(f"--{option.replace('_', '-')}", type=kind)
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = read_config(spark, given.pop("config")) if given["config"] else given.pop("config") or {}
        if unknown := set(config) - set(options):
            raise ValueError(f"the config file has unknown options: {sorted(unknown)}")
        done = job(spark, **(config | {k: v for k, v in given.items() if v is not None}))
    finally:
        spark.stop()
    print(json.dumps(done))
    return done
