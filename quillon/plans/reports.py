"""Report sinks: a long table of all values of all reports, and JSON and Markdown rendered from it.

The table is Parquet, partitioned by report and split; what a report writes replaces its own parts alone. Values of no split are under ``all``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.artifacts import write_json, write_text

#: What a reader of each report should know.
NOTES = {
    "baselines": ["Lists are fitted on training events alone; validation and test only ask.", "A ranking that is short is filled up with the most viewed items, so recall at k is of k items always.", "Cohorts of items count a query once for each cohort among its positives."],
    "hybrid": ["Each component is fused to the same depth.", "The decision rests on validation; test numbers take no part in it.", "A component's delta is the whole's NDCG less that without it: above zero it helps."],
    "learned": ["Coefficients come from the later part of the training period, with lists of its earlier part.", "They belong to standardised features and can be compared with each other within a task.", "The decision rests on validation against category order."],
    "retrieval": ["Candidate recall bounds the recall that any ranking of the candidates can reach.", "The number of candidates stands for what serving would cost; no latency was measured.", "The decision rests on validation."],
    "efficiency": ["All budgets are read off one look-up at the greatest depths.", "Retention is the share of the widest budget's recall, by task.", "The choice is made on validation; retention on test is told and not used."],
    "rerank": ["All rankings compared order the same candidates.", "The comparator is the better of category order and fusion on validation.", "Coefficients come from the later part of the training period, with lists of its earlier part."],
    "stage": ["A query is asked at the first view and after the first add-to-cart that events follow.", "A query of the cart stage is judged on transactions alone.", "Pooled rankers are those by task, fitted on queries of both stages."],
}

# File names of the reports, without their endings.
NAMES = {
    "audit": "audit",
    "observation": "observation_semantics",
    "manifest": "temporal_split_manifest",
    "baselines": "behavioral_baselines",
    "hybrid": "hybrid_ablation",
    "learned": "learned_ranker",
    "retrieval": "candidate_retrieval",
    "efficiency": "retrieval_efficiency",
    "rerank": "efficient_reranker",
    "stage": "stage_aware_ranking",
    "final": "final_system_selection",
}


def _text(value: Any) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value).replace("|", "\\|")


def _is_table(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(isinstance(v, dict) and v and not any(isinstance(x, dict | list) for x in v.values()) for v in value.values())


def markdown(report: dict[str, Any], title: str, level: int = 1) -> str:
    """Headings for nested parts, tables where the innermost parts have like fields, lists for the rest."""
    lines = [f"{'#' * level} {title}", ""]
    plain = {k: v for k, v in report.items() if not isinstance(v, dict | list)}
    lines += [f"- {k}: {_text(v)}" for k, v in plain.items()] + [""] * bool(plain)
    for key, value in report.items():
        if _is_table(value):
            columns = list(dict.fromkeys(c for row in value.values() for c in row))
            lines += [f"{'#' * min(level + 1, 6)} {key}", "", "| | " + " | ".join(columns) + " |", "|---" * (len(columns) + 1) + "|"]
            lines += [f"| {name} | " + " | ".join(_text(row.get(c, "")) for c in columns) + " |" for name, row in value.items()] + [""]
        elif isinstance(value, dict):
            lines.append(markdown(value, key, min(level + 1, 6)))
        elif isinstance(value, list):
            lines += [f"{'#' * min(level + 1, 6)} {key}", ""]
            lines += [f"- {', '.join(f'{k}: {_text(v)}' for k, v in x.items()) if isinstance(x, dict) else _text(x)}" for x in value] + [""]
    return "\n".join(lines)


#: path: names of nested parts, places in lists as #0, #1 and so on; place: order in the report; kind: a JSON type, with value as text.
VALUES = "report string, split string, place int, path array<string>, kind string, value string"
SPLITS = ("train", "validation", "test")


def flattened(report: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
    """path, kind and value of every leaf; a part without any is a leaf itself."""
    if isinstance(report, dict | list):
        parts = report.items() if isinstance(report, dict) else ((f"#{i}", x) for i, x in enumerate(report))
        if not report:
            yield path, type(report).__name__, None
        for name, part in parts:
            yield from flattened(part, (*path, str(name)))
    else:
        yield path, "null" if report is None else type(report).__name__, None if report is None else repr(report) if isinstance(report, float) else str(report)


_READ: dict[str, Callable[[str], Any]] = {"int": int, "float": float, "bool": lambda x: x == "True", "str": str, "null": lambda _: None, "dict": lambda _: {}, "list": lambda _: []}


def nested_report(leaves: Iterable[tuple[Sequence[str], str, str | None]]) -> Any:
    """The report that has these leaves, in their order."""
    top: dict[str, Any] = {}
    for path, kind, value in leaves:
        at = top
        for name in path[:-1]:
            at = at.setdefault(name, {})
        at[path[-1]] = _READ[kind](value)

    def listed(part: Any) -> Any:
        if not isinstance(part, dict):
            return part
        inner = {k: listed(v) for k, v in part.items()}
        return list(inner.values()) if inner and all(k.startswith("#") for k in inner) else inner

    return listed(top)


def write_values(spark: SparkSession, table: str, kind: str, report: dict[str, Any]) -> None:
    """The report's values, in place of those that an earlier run wrote for the same report and splits."""
    rows = [(NAMES[kind], next((p for p in path if p in SPLITS), "all"), place, list(path), leaf, value) for place, (path, leaf, value) in enumerate(flattened(report))]
    frame = spark.createDataFrame(rows, VALUES).repartition("report", "split")
    frame.write.partitionBy("report", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)


def read_values(spark: SparkSession, table: str, kind: str) -> dict[str, Any]:
    """The report as the table has it."""
    rows = spark.read.schema(VALUES).parquet(table).where(F.col("report") == NAMES[kind]).orderBy("place").collect()  # one report
    return nested_report((r["path"], r["kind"], r["value"]) for r in rows)


def write_report(spark: SparkSession, folder: str, kind: str, report: dict[str, Any]) -> tuple[str, str]:
    """Paths of the JSON and the Markdown file, which are rendered from the table of values in the folder."""
    write_values(spark, f"{folder.rstrip('/')}/values", kind, report)
    report = read_values(spark, f"{folder.rstrip('/')}/values", kind)
    base = f"{folder.rstrip('/')}/{NAMES[kind]}"
    write_json(spark, f"{base}.json", report)
    write_text(spark, f"{base}.md", markdown(report, NAMES[kind].replace("_", " ").capitalize()) + "\n")
    return f"{base}.json", f"{base}.md"
