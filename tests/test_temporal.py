import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.ranks import nearest_index, nearest_rank, numbered, values_at
from quillon.operators import temporal
from quillon.streaming.sessions import session_counts

MIN = 60_000


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, visitorid long, timestamp long, split string")


def test_cutoffs(spark):
    frame = spark.createDataFrame([(10 * i,) for i in range(1, 11)], "timestamp long")
    assert temporal.temporal_cutoffs(frame, 0.7, 0.2) == (70, 90)
    counts = {r["split"]: r["count"] for r in temporal.with_split(frame, 70, 90).groupBy("split").count().collect()}
    assert counts == {"train": 7, "validation": 2, "test": 1}
    for bad in ((0, 0.5), (0.5, 1), (0.6, 0.4)):
        with pytest.raises(ValueError):
            temporal.temporal_cutoffs(frame, *bad)


def test_order_statistics_match_sorting(spark):
    rng = random.Random(1)
    values = [rng.randint(-(10**12), 10**12) for _ in range(500)] + [7] * 50 + [None] * 3
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(v for v in values if v is not None)
    at = [0, 1, 250, 549]
    assert values_at(frame, "v", at) == [ordered[i] for i in at]
    assert [nearest_rank(n, 0.7) for n in (1, 10, 11)] == [0, 6, 7]
    assert [nearest_index(n, 0.5) for n in (2, 4, 6, 8)] == [0, 2, 2, 4]


def test_numbered_is_dense_in_order(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r.position for r in numbered(frame, [F.desc("v")]).orderBy(F.desc("v")).collect()] == list(range(1000))


@pytest.mark.parametrize(
    "rows,split,index,breaks,forced",
    [
        ([(1, 0, "a"), (1, 30 * MIN, "a"), (1, 61 * MIN, "a"), (2, 5, "a")], None, [0, 0, 1, 0], [False] * 4, [False] * 4),
        ([(1, 0, "train"), (1, 5 * MIN, "validation"), (1, 10 * MIN, "validation")], "split", [0, 1, 1], [False, True, False], [False, True, False]),
        ([(1, 0, "train"), (1, 31 * MIN, "validation")], "split", [0, 1], [False, True], [False, False]),
    ],
)
def test_sessions(spark, rows, split, index, breaks, forced):
    out = temporal.sessionize(events(spark, rows), 30, split).orderBy("row_id").collect()
    assert [r.session_index for r in out] == index
    assert [r.split_boundary_break for r in out] == breaks
    assert [r.split_boundary_forced_break for r in out] == forced
    assert out[0].session_id == "1:0"


def test_point_in_time_join(spark):
    left = spark.createDataFrame([(5, 1), (10, 1), (15, 1), (15, 2)], "timestamp long, itemid long")
    right = spark.createDataFrame([(0, 7, 1, "0"), (1, 12, 1, "1"), (2, 12, 1, "2")], "row_id long, timestamp long, itemid long, available string")
    out = {(r.timestamp, r.itemid): r for r in temporal.point_in_time_join(left, right).collect()}
    assert [out[t, 1].available for t in (5, 10, 15)] == [None, "0", "2"]  # of a tie the last
    assert out[15, 1].timestamp_property == 12 and out[15, 2].available is None
    with pytest.raises(ValueError):
        temporal.point_in_time_join(left, right.drop("itemid"))


def test_eligible_items_and_negatives(spark):
    seen = spark.createDataFrame([(10, 1000), (20, 2000), (30, 3000)], "itemid long, first_seen long")
    assert sorted(r.itemid for r in temporal.time_valid_items(seen, 2000).collect()) == [10, 20]
    catalog = spark.range(1, 101).select(F.col("id").alias("itemid"))
    drawn = [temporal.sampled_candidates(catalog, [5, 9], 10, 42) for _ in range(2)]
    assert drawn[0] == drawn[1] == sorted(drawn[0]) and len(drawn[0]) == 12 and {5, 9} <= set(drawn[0])


def test_manifest_counts(spark):
    rows = [(i, 1000 * i, 1 + i % 3, "view", i % 4, None) for i in range(20)] + [(20, 0, 1, "view", 0, None)]
    frame = spark.createDataFrame(rows, "row_id long, timestamp long, visitorid long, event string, itemid long, transactionid long")
    found = temporal.build_manifest(frame, "x", session_gap_minutes=30)
    assert sum(found["split_row_counts"].values()) == 20 and found["session_count"] >= 3
    assert found["train_end_ms"] == 13_000 and found["validation_end_ms"] == 16_000


def test_stream_sessions_match_batch(spark, tmp_path):
    day = 86_400_000  # the first watermark is the epoch
    rows = [(0, 1, "view", 1), (10 * MIN, 1, "view", 2), (10 * MIN, 1, "view", 2), (40 * MIN, 1, "view", 3), (71 * MIN, 1, "view", 4), (5, 2, "view", 1)]
    rows = [(day + t, *rest) for t, *rest in rows]
    frame = spark.createDataFrame(rows, "timestamp long, visitorid long, event string, itemid long")
    want = {(1, day, day + 40 * MIN, 3), (1, day + 71 * MIN, day + 71 * MIN, 1), (2, day + 5, day + 5, 1)}
    assert {tuple(r) for r in session_counts(frame).collect()} == want
    frame.write.parquet(str(tmp_path / "in"))
    frame.withColumns({"visitorid": F.lit(9).cast("long"), "timestamp": F.lit(10**9).cast("long")}).limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = session_counts(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("sessions").collect()} == want
