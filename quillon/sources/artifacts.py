"""JSON sources and sinks of reports and of the split manifest, through the file system that the path names."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

#: What a manifest must say for evaluations to accept it.
SESSION_POLICY = "split_boundary_breaks_session"
HORIZON = "remainder_of_current_split_bounded_session"
MANIFEST_KEYS = ("train_end_ms", "validation_end_ms", "session_gap_minutes", "session_boundary_policy", "prediction_horizon")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    from .tables import exists

    if not exists(spark, path):
        raise FileNotFoundError(path)
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, report: dict[str, Any]) -> None:
    """NaN is written as it is."""
    write_text(spark, path, json.dumps(report, indent=2, allow_nan=True) + "\n")


def read_manifest(spark: SparkSession, source: str | dict[str, Any]) -> dict[str, Any]:
    """A manifest, from a path or as it stands, whose keys, session policy and horizon are what evaluations rest on."""
    manifest = json.loads(read_text(spark, source)) if isinstance(source, str) else dict(source)
    missing = [k for k in MANIFEST_KEYS if k not in manifest]
    if missing:
        raise ValueError(f"manifest: missing keys: {', '.join(missing)}")
    if manifest["session_boundary_policy"] != SESSION_POLICY:
        raise ValueError(f"manifest: sessions must follow {SESSION_POLICY}")
    if manifest["prediction_horizon"] != HORIZON:
        raise ValueError(f"manifest: the horizon must be {HORIZON}")
    return manifest
