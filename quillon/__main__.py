"""Command line: python -m quillon COMMAND ..., one command for each report."""

from __future__ import annotations

import argparse
import sys
from typing import Any

from pyspark.sql import SparkSession

from .operators import audit, temporal
from .plans import decisions, evaluations
from .plans.reports import write_report
from .sources.artifacts import read_manifest
from .sources.tables import EVENT_FILE, Dataset, file_profiles, read_csv, read_dataset, require_files


def depths(least: int):
    """A parser of comma-separated whole numbers, each once, in order."""

    def parse(text: str) -> tuple[int, ...]:
        try:
            found = tuple(sorted({int(x) for x in text.split(",") if x.strip()}))
        except ValueError as wrong:
            raise argparse.ArgumentTypeError("depths are whole numbers with commas between") from wrong
        if not found or found[0] < least:
            raise argparse.ArgumentTypeError(f"depths must be at least {least}")
        return found

    return parse


def cap(text: str) -> int | None:
    return int(text) or None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *inputs: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for i in inputs:
            one.add_argument(i)
        one.add_argument("--output-dir", required=True)
        return one

    command("audit", "dataset")
    command("observation", "events")
    one = command("manifest", "events")
    one.add_argument("--train-fraction", type=float, default=0.70)
    one.add_argument("--validation-fraction", type=float, default=0.15)
    one.add_argument("--session-gap-minutes", type=int, default=30)
    one.add_argument("--keep-exact-duplicates", dest="deduplicate_exact_rows", action="store_false")
    numbers: dict[str, dict[str, Any]] = {
        "baselines": {"k": 20, "half_life_days": 7.0, "neighbor_top_n": 50},
        "hybrid": {"k": 20, "source_depth": 100, "rrf_offset": 60.0, "half_life_days": 7.0},
        "learned": {"k": 20, "source_depth": 100, "rrf_offset": 60.0, "half_life_days": 7.0, "internal_fit_fraction": 0.8, "max_nonrelevant_per_query": 50},
        "retrieval": {"k": 20, "base_depth": 100, "expanded_depth": 300, "half_life_days": 7.0},
        "efficiency": {"retention_threshold": 0.95, "half_life_days": 7.0},
        "rerank": {"k": 20, "category_depth": 300, "behavioral_depth": 100, "parent_depth": 0, "rrf_offset": 60.0, "half_life_days": 7.0, "internal_fit_fraction": 0.8, "max_nonrelevant_per_query": 50},
        "stage": {"k": 20, "category_depth": 300, "behavioral_depth": 100, "parent_depth": 0, "rrf_offset": 60.0, "half_life_days": 7.0, "internal_fit_fraction": 0.8, "max_nonrelevant_per_query": 50},
    }
    for name, options in numbers.items():
        one = command(name, "dataset", "manifest")
        for option, default in ({**options, "seed": 365}).items():
            one.add_argument(f"--{option.replace('_', '-')}", type=type(default), default=default)
        one.add_argument("--max-sessions-per-split", type=cap, default=50_000)
        if name in ("learned", "rerank", "stage"):
            one.add_argument("--max-internal-ranker-sessions", type=cap, default=20_000)
        if name == "efficiency":
            one.add_argument("--category-depths", type=depths(1), default=(100, 200, 300))
            one.add_argument("--behavioral-depths", type=depths(1), default=(100, 300))
            one.add_argument("--parent-depths", type=depths(0), default=(0, 100, 300))
    command("final", "artifacts")
    return top


EVALUATIONS = {
    "baselines": evaluations.evaluate_baselines,
    "hybrid": evaluations.evaluate_hybrid,
    "learned": evaluations.evaluate_learned,
    "retrieval": evaluations.evaluate_retrieval,
    "efficiency": evaluations.evaluate_efficiency,
    "rerank": evaluations.evaluate_reranker,
    "stage": evaluations.evaluate_stages,
}


def report(spark: SparkSession, command: str, options: dict[str, Any]) -> dict[str, Any]:
    """What a command reports."""
    if command == "audit":
        require_files(spark, options["dataset"])
        data = read_dataset(spark, options["dataset"])
        return audit.dataset_audit(data.events, data.properties, data.tree, options["dataset"], file_profiles(spark, options["dataset"]))
    if command in ("observation", "manifest"):
        source = options.pop("events")
        from .functions.guards import EVENTS

        events = read_csv(spark, source, EVENTS, EVENT_FILE)
        return audit.observation_audit(events, source) if command == "observation" else temporal.build_manifest(events, source, **options)
    if command == "final":
        return decisions.final_selection(spark, options["artifacts"])
    folder, path = options.pop("dataset"), options.pop("manifest")
    data: Dataset = read_dataset(spark, folder)
    return EVALUATIONS[command](data, read_manifest(spark, path), f"{folder}/{EVENT_FILE}", **options) | {"manifest": path}


def main(arguments: list[str] | None = None) -> int:
    options = vars(parser().parse_args(arguments))
    command, folder = options.pop("command"), options.pop("output_dir")
    spark = SparkSession.builder.appName(f"quillon {command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for path in write_report(spark, folder, command, report(spark, command, options)):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
