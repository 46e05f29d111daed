"""Time: splits, sessions, point-in-time joins, catalog eligibility and the split manifest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import require_columns, require_fractions, require_positive
from ..functions.ranks import SEGMENT_ROWS, cut, first_n, hot_segments, nearest_rank, numbered, values_at
from ..sources.artifacts import HORIZON, SESSION_POLICY
from ..sources.tables import deduplicated

MINUTE_MS, DAY_MS = 60_000, 86_400_000
# Fixed value: what the manifest says of candidates.
CANDIDATE_RULE = "candidate_item_must_have_observed_catalog_evidence_at_or_before_prediction_time"


def temporal_cutoffs(events: DataFrame, train_fraction: float = 0.70, validation_fraction: float = 0.15, column: str = "timestamp") -> tuple[int, int]:
    """Last timestamps of train and validation, by nearest rank."""
    require_fractions(train_fraction, validation_fraction)
    n = events.where(F.col(column).isNotNull()).count()
    if not n:
        raise ValueError("no timestamps")
    train, validation = values_at(events, column, [nearest_rank(n, train_fraction), nearest_rank(n, train_fraction + validation_fraction)])
    return train, validation


def split_label(train_end_ms: int, validation_end_ms: int, column: str = "timestamp") -> Column:
    """train, validation or test; an end belongs to the split it ends."""
    if validation_end_ms < train_end_ms:
        raise ValueError("validation_end_ms must be >= train_end_ms")
    return F.when(F.col(column) <= train_end_ms, "train").when(F.col(column) <= validation_end_ms, "validation").otherwise("test")


def with_split(events: DataFrame, train_end_ms: int, validation_end_ms: int) -> DataFrame:
    return events.withColumn("split", split_label(train_end_ms, validation_end_ms))


def _carried(ends: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """A value for each segment from a row for each segment before it, under names that clash with nothing: _c0, ..., _cs, _carried."""
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_segment").alias("_cs"), value.over(before).alias("_carried"))


def _beside(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of segments with what is carried to theirs."""
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)])
    return rows.join(carried, same & (F.col("_segment") == F.col("_cs"))).drop(*[f"_c{i}" for i in range(len(keys))], "_cs")


def sessionize(events: DataFrame, gap_minutes: float = 30, split_col: str | None = None, segment_rows: int = SEGMENT_ROWS, by: Sequence[str] = ("visitorid",)) -> DataFrame:
    """Events with session_index (from 0 for each visitor), session_id, split_boundary_break and split_boundary_forced_break.

    A session ends where more than the gap passes before the visitor's next event, or where the split changes; that a
    change alone ended it makes a forced break. Order is timestamp, then row_id where there is one. ``by`` may name more than the visitor: each
    combination then has sessions of its own, from 0.

    Visitors of over ``segment_rows`` events are dealt out over segments of time: a break needs only the event before, the last one of an earlier segment for a
    segment's first, and an index is the breaks in a segment up to the event and those in the segments before.
    """
    require_positive(gap_minutes=gap_minutes)
    require_columns(events.columns, ["visitorid", "timestamp", *([split_col] if split_col else [])], "events")
    keys = list(by)
    dealt = hot_segments(events, keys, "timestamp", segment_rows)
    if dealt is None:
        return _sessions(events, keys, gap_minutes, split_col)
    hot, rest = dealt
    order = ["timestamp", *(["row_id"] if "row_id" in events.columns else [])]
    ends = hot.groupBy(*keys, "_segment").agg(F.max(F.struct(*order, *([split_col] if split_col else []))).alias("_end"))
    placed = _beside(hot, _carried(ends, keys, F.last("_end", ignorenulls=True)), keys)
    local = _sessions(placed, [*keys, "_segment"], gap_minutes, split_col, F.col("_carried")).drop("_carried")
    # breaks of a segment: the index of its last event
    breaks = local.groupBy(*keys, "_segment").agg(F.max("session_index").alias("_breaks"))
    whole = _beside(local, _carried(breaks, keys, F.sum("_breaks")), keys)
    index = F.col("session_index") + F.coalesce("_carried", F.lit(0))
    return named(whole.withColumn("session_index", index)).drop("_segment", "_carried").unionByName(_sessions(rest, keys, gap_minutes, split_col))


def named(sessions: DataFrame) -> DataFrame:
    """Sessions with session_id."""
    return sessions.withColumn("session_id", F.concat_ws(":", F.col("visitorid").cast("string"), F.col("session_index").cast("string")))


def _sessions(events: DataFrame, keys: Sequence[str], gap_minutes: float, split_col: str | None, carried: Column | None = None) -> DataFrame:
    """Sessions where all rows of ``keys`` come together. ``carried`` is what stood before the first of them: timestamp, row_id where there is one, and split."""
    by = Window.partitionBy(*keys).orderBy("timestamp", *(["row_id"] if "row_id" in events.columns else []))

    def before(column: str) -> Column:
        last = F.lag(column).over(by)
        return last if carried is None else F.when(F.row_number().over(by) == 1, carried[column]).otherwise(last)

    gap = F.coalesce(F.col("timestamp") - before("timestamp") > gap_minutes * MINUTE_MS, F.lit(False))
    change = F.coalesce(before(split_col) != F.col(split_col), F.lit(False)) if split_col else F.lit(False)
    flagged = events.withColumns({"_gap": gap, "split_boundary_break": change})
    index = F.sum((F.col("_gap") | F.col("split_boundary_break")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return named(flagged.withColumns({"session_index": index, "split_boundary_forced_break": F.col("split_boundary_break") & ~F.col("_gap")}).drop("_gap"))


def point_in_time_join(events: DataFrame, properties: DataFrame, by: str | Sequence[str] = "itemid", event_time: str = "timestamp", property_time: str = "timestamp", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Each event with the latest property row of its key at or before its time; nulls if there is none.

    The property's time and other columns whose names clash get the suffix _property. Of property rows with equal key and
    time the last one counts, by row_id where there is one. Both sides are laid out once by key and time; nothing is
    compared pair by pair. To join the state of one property, filter to it first.

    Keys of over ``segment_rows`` rows are dealt out over segments of time, each of which is given the last state of the segments before it.
    """
    keys = [by] if isinstance(by, str) else list(by)
    require_columns(events.columns, [*keys, event_time], "events")
    require_columns(properties.columns, [*keys, property_time], "properties")
    tie = F.col("row_id") if "row_id" in properties.columns else F.lit(0)
    # the key's place among names; a property's time keeps its name unless the events have it
    given = [c for c in properties.columns if c not in keys and c != "row_id"]
    names = {c: f"{c}_property" if c in events.columns else c for c in given}
    state = F.struct(*[F.col(c).alias(names[c]) for c in given])
    right = properties.select(*keys, F.col(property_time).alias("_at"), F.lit(0).alias("_side"), tie.cast("long").alias("_tie"), state.alias("_state"), F.lit(None).cast(events.schema).alias("_event"))
    left = events.select(*keys, F.col(event_time).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(right.schema["_state"].dataType).alias("_state"), F.struct(*events.columns).alias("_event"))
    both = left.unionByName(right)

    def latest(*within: str) -> Column:
        return F.last("_state", ignorenulls=True).over(Window.partitionBy(*within).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0))

    dealt = hot_segments(both, keys, "_at", segment_rows)
    hot, rest = dealt or (None, both)
    told = rest.withColumn("_state", latest(*keys))
    if hot is not None:
        ends = hot.groupBy(*keys, "_segment").agg(F.max_by("_state", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
        placed = _beside(hot, _carried(ends, keys, F.last("_end", ignorenulls=True)), keys)
        told = placed.withColumn("_state", F.coalesce(latest(*keys, "_segment"), "_carried")).drop("_carried", "_segment").unionByName(told)
    return told.where("_side = 1").select("_event.*", "_state.*")


def first_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("itemid").agg(F.min("timestamp").alias("first_seen"))


def time_valid_items(seen: DataFrame, prediction_time_ms: int) -> DataFrame:
    """Items that have been observed at or before the time."""
    return seen.where(F.col("first_seen") <= prediction_time_ms).select("itemid").distinct()


def draw(total: int, size: int, seed: int) -> list[int]:
    """Sorted places of a sample without replacement."""
    return np.sort(np.random.default_rng(seed).choice(total, size=size, replace=False)).tolist()


def sampled_candidates(catalog: DataFrame, positives: Sequence[int], n_negatives: int, seed: int) -> list[int]:
    """The positives and up to ``n_negatives`` drawn items of the catalog that are none of them, in order."""
    if n_negatives < 0:
        raise ValueError("n_negatives must be non-negative")
    spark = catalog.sparkSession
    known = spark.createDataFrame([(int(p),) for p in positives], "itemid long")
    placed = numbered(catalog.select(F.col("itemid").cast("long")).distinct().join(known, "itemid", "left_anti"), [F.col("itemid")])
    total = placed.count()
    at = spark.createDataFrame([(p,) for p in draw(total, min(n_negatives, total), seed)], "position long")
    drawn = [r["itemid"] for r in placed.join(F.broadcast(at), "position").select("itemid").collect()]
    return sorted({int(p) for p in positives} | set(drawn))


def keyed(seed: int, *parts: Column | str) -> Column:
    """A number under 2^32 from the digest of the seed and of values: the same wherever and however often it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def next_prime(n: int) -> int:
    """The smallest prime of at least ``n`` and 2."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def drawn_negatives(queries: DataFrame, positives: DataFrame, catalog: DataFrame, keys: Sequence[str], n_negatives: int, seed: int) -> DataFrame:
    """keys, itemid, draw: for each query up to ``n_negatives`` items of the catalog that are none of its positives, all drawn at once.

    Items stand at dense positions in order of their numbers. A query walks them by steps of its own from a start of its own, modulo the smallest prime that is no smaller than the
    catalog: no position comes twice, and as many steps as there are negatives, positives and numbers between the catalog and the prime are always enough. draw numbers the
    taken ones from 1. Queries are rows of different ``keys``; work is in proportion to what is drawn, and neither lists nor the catalog pass the driver.
    """
    if n_negatives < 0:
        raise ValueError("n_negatives must be non-negative")
    placed = cut(numbered(catalog.select(F.col("itemid").cast("long").alias("itemid")).where("itemid is not null").distinct(), [F.col("itemid")]))
    total = placed.count()
    prime = next_prime(total)
    own = positives.select(*keys, F.col("itemid").cast("long").alias("itemid")).distinct()
    asked = queries.select(*keys).distinct().join(own.groupBy(*keys).agg(F.count("*").alias("_own")), list(keys), "left")
    name = [F.col(k).cast("string") for k in keys]
    steps = F.least(F.lit(n_negatives) + F.coalesce("_own", F.lit(0)) + (prime - total), F.lit(prime))
    walked = asked.where(F.lit(min(total, n_negatives) > 0)).select(*keys, (keyed(seed, F.lit("step"), *name) % max(prime - 1, 1) + 1).alias("_step"), (keyed(seed, F.lit("start"), *name) % prime).alias("_start"), F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("_at"))
    stood = walked.select(*keys, "_at", ((F.col("_start") + F.col("_at") * F.col("_step")) % prime).alias("position"))
    found = stood.join(placed, "position").join(own, [*keys, "itemid"], "left_anti")
    return first_n(found.select(*keys, "itemid", "_at"), list(keys), [F.asc("_at")], n_negatives, "draw").drop("_at")


def build_manifest(events: DataFrame, source: str, train_fraction: float = 0.70, validation_fraction: float = 0.15, session_gap_minutes: int = 30, deduplicate_exact_rows: bool = True, distinct: bool = False) -> dict[str, Any]:
    """The frozen temporal protocol of an event table: cutoffs, counts by split and event, sessions. Each is a pass over the events, which are deduplicated once, or not at all where they are ``distinct``."""
    test_fraction = require_fractions(train_fraction, validation_fraction)
    events = cut(deduplicated(events)) if deduplicate_exact_rows and not distinct else events
    train_end, validation_end = temporal_cutoffs(events, train_fraction, validation_fraction)
    labelled = with_split(events, train_end, validation_end)
    by_event = labelled.groupBy("split", "event").count().collect()
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    sessions = sessionize(labelled, session_gap_minutes, "split")
    sizes = sessions.groupBy("visitorid", "session_index").agg(F.count("*").alias("n"), F.sum(F.col("split_boundary_forced_break").cast("long")).alias("forced"))
    total, single, forced = sizes.agg(F.count("*"), F.count_if(F.col("n") == 1), F.coalesce(F.sum("forced"), F.lit(0))).first()
    splits = ("train", "validation", "test")
    return {
        "source": source,
        "deduplicate_exact_rows": deduplicate_exact_rows,
        "train_fraction": train_fraction,
        "validation_fraction": validation_fraction,
        "test_fraction": test_fraction,
        "train_end_ms": train_end,
        "validation_end_ms": validation_end,
        "timestamp_min_ms": low,
        "timestamp_max_ms": high,
        "split_row_counts": {s: sum(r["count"] for r in by_event if r["split"] == s) for s in splits},
        "split_event_counts": {s: {r["event"]: r["count"] for r in sorted(by_event, key=lambda r: str(r["event"])) if r["split"] == s and r["event"] is not None} for s in splits},
        "session_gap_minutes": session_gap_minutes,
        "session_boundary_policy": SESSION_POLICY,
        "prediction_horizon": HORIZON,
        "candidate_time_rule": CANDIDATE_RULE,
        "session_count": total,
        "singleton_session_count": single,
        "split_boundary_forced_sessions": forced,
    }
