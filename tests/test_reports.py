import json
import math

import pytest

from quillon.plans import reports


def same(a, b):
    if isinstance(a, dict):
        return isinstance(b, dict) and list(a) == list(b) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and (a == b or isinstance(a, float) and math.isnan(a) and math.isnan(b))


REPORT = {
    "source": "x|y", "k": 20, "share": 0.1, "whole": 1.0, "kept": True, "none": None, "empty": {}, "notes": [], "depths": [1, 2.5, "a", [3], {"b": None}],
    "metrics": {"validation": {"view": {"recall_at_k": 1 / 3, "queries": 7}}, "test": {"view": {"recall_at_k": math.nan, "queries": 0}}},
    "files": [{"name": "a", "columns": ["b", "c"], "null_counts": {"b": 0}}],
}


def test_flat_and_back():
    assert same(reports.nested_report(reports.flattened(REPORT)), REPORT)


def test_round_trip_and_rerun(spark, tmp_path):
    """A report comes back as it was; a rerun replaces its own parts and nothing else."""
    table = f"{tmp_path}/values"
    reports.write_values(spark, table, "baselines", REPORT)
    reports.write_values(spark, table, "hybrid", REPORT | {"k": 3})
    assert same(reports.read_values(spark, table, "baselines"), REPORT)
    later = REPORT | {"k": 21, "metrics": {"validation": {"view": {"recall_at_k": 0.5, "queries": 8}}, "test": REPORT["metrics"]["test"]}}
    reports.write_values(spark, table, "baselines", later)
    assert same(reports.read_values(spark, table, "baselines"), later)
    assert same(reports.read_values(spark, table, "hybrid"), REPORT | {"k": 3})
    parts = {(r["report"], r["split"]): r["count"] for r in spark.read.parquet(table).groupBy("report", "split").count().collect()}
    assert {split for _, split in parts} == {"all", "validation", "test"} and parts["behavioral_baselines", "validation"] == 2


def test_files_are_rendered_from_the_table(spark, tmp_path):
    made, text = reports.write_report(spark, str(tmp_path), "rerank", REPORT)
    with open(made) as f:
        assert same(json.load(f), REPORT)
    with open(text) as f:
        assert "| view | " in f.read()


@pytest.mark.parametrize("kind", ["baselines", "hybrid", "learned", "retrieval", "efficiency", "rerank", "stage"])
def test_notes(kind):
    assert all(note.endswith(".") for note in reports.NOTES[kind]) and len(reports.NOTES[kind]) >= 2
