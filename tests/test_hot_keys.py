"""Hot keys dealt out over segments: same rows as plain loops, no window over a whole key, and trees of great depth."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions.ranks import hot_segments
from quillon.operators import audit, rankings, temporal

MIN = 60_000


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def hot_events(rng, n, visitors=(1, 1, 1, 1, 1, 1, 1, 1, None, 2)):
    """Nine tenths of the rows belong to one visitor; bursts at one time, ties, and times far apart."""
    out, now = [], 0
    for i in range(n):
        now += rng.choice([0, 0, 1, MIN, 29 * MIN, 30 * MIN, 31 * MIN, 300 * MIN])
        out.append((i, rng.choice(visitors), now, "train" if i < n // 2 else "test"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("split", [None, "split"])
def test_sessions_over_segments(spark, split):
    frame = spark.createDataFrame(hot_events(random.Random(1), 1500), "row_id long, visitorid long, timestamp long, split string").repartition(7)
    plain = temporal.sessionize(frame, 30, split)
    dealt = temporal.sessionize(frame, 30, split, segment_rows=40)
    assert rows_of(dealt.select(plain.columns)) == rows_of(plain)
    names = plain.drop("row_id").columns
    once = frame.drop("row_id").dropDuplicates()  # without row_id, and without ties
    assert rows_of(temporal.sessionize(once, 30, None, segment_rows=40).select("visitorid", "timestamp", "session_index")) == rows_of(temporal.sessionize(once, 30, None).select("visitorid", "timestamp", "session_index"))
    assert "row_id" not in names


def test_states_over_segments(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(i, v, t) for i, v, t, _ in hot_events(rng, 900)], "n long, itemid long, timestamp long")
    right = spark.createDataFrame([(i, v, t, str(i)) for i, v, t, _ in hot_events(rng, 300)] + [(10**6, 3, 5, None)], "row_id long, itemid long, timestamp long, value string")
    for a, b in ((left, right), (left, right.where("timestamp > 100000000")), (left, right.limit(0)), (left.limit(0), right)):
        plain = temporal.point_in_time_join(a, b)
        assert rows_of(temporal.point_in_time_join(a, b, segment_rows=30).select(plain.columns)) == rows_of(plain)
    two = temporal.point_in_time_join(left.withColumn("k", F.lit("x")), right.withColumn("k", F.lit("x")), ["itemid", "k"], segment_rows=30)
    assert rows_of(two.drop("k").select(left.columns + ["timestamp_property", "value"])) == rows_of(temporal.point_in_time_join(left, right).select(left.columns + ["timestamp_property", "value"]))


def test_segments_spread_and_keep_order(spark):
    """No segment has much over its share of rows, save where one time has; segments follow each other in time."""
    frame = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"), (F.col("id") * F.col("id")).alias("at"))
    assert hot_segments(frame, ["k"], "at", 20_000) is None
    hot, rest = hot_segments(frame, ["k"], "at", 1000)
    assert rest.count() == 2000 and hot.count() == 18_000
    each = hot.groupBy("_segment").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("_segment").collect()
    assert 16 <= len(each) <= 19 and max(r.n for r in each) < 1400
    assert all(a.high < b.low for a, b in zip(each, each[1:]))


def test_plans_deal_segments_out(spark):
    frame = spark.range(5000).select(F.lit(1).cast("long").alias("visitorid"), (F.col("id") * 1000).alias("timestamp"), F.col("id").alias("row_id"))
    plan = temporal.sessionize(frame, 30, segment_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert any("lag(" in line and "_segment#" in line.rpartition("windowspecdefinition(")[2].partition("timestamp")[0] for line in plan.splitlines())


def test_deep_trees(spark):
    """A chain and a ring of 100,000 categories."""
    n = 100_000
    ids = spark.range(n)
    chain = ids.select(F.col("id").cast("string").alias("categoryid"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parentid"))
    ring = ids.select(F.col("id").cast("string").alias("categoryid"), F.pmod(F.col("id") - 1, F.lit(n)).cast("string").alias("parentid"))
    for tree, cycle in ((chain, False), (ring, True)):
        began = time.monotonic()
        assert audit.has_cycle(tree) is cycle
        assert time.monotonic() - began < 60


def test_cycles_of_random_trees(spark):
    rng = random.Random(3)
    for size in (3, 7, 30):
        for _ in range(4):
            parents = {i: rng.choice([None, *range(size + 2)]) if rng.random() < 0.6 else max(i - 1, 0) or None for i in range(size)}
            cycle = False
            for i in parents:
                seen, at = set(), i
                while at in parents and parents[at] is not None and at not in seen:
                    seen.add(at)
                    at = parents[at]
                cycle |= at in seen
            tree = spark.createDataFrame([(str(i), None if p is None else str(p)) for i, p in parents.items()], "categoryid string, parentid string")
            assert audit.has_cycle(tree) is cycle


def by_turns(tree, popular, n):
    """Plain reading: children of a category's parent, one item of each in turn."""
    parent, children = {}, {}
    for c, p in tree:
        if p is not None:
            parent[c] = p
            if c not in children.setdefault(p, []):
                children[p].append(c)
    out = {}
    for c, p in parent.items():
        lists = [popular.get(x, []) for x in sorted(children[p], key=lambda x: (not x.isdigit(), int(x) if x.isdigit() else 0, x))]
        items = list(dict.fromkeys(one[r] for r in range(n) for one in lists if r < len(one)))[:n]
        if items:
            out[c] = items
    return out


def test_siblings_by_parent(spark):
    """Numbers in their order (10 after 9), text after numbers, repeated items, a category that moves, and children without items."""
    rng = random.Random(4)
    tree = [(str(i), str(100 + i % 3)) for i in range(30)] + [("x", "100"), ("4", "102"), ("7.0", "101"), ("40", None), ("41", "41")]
    popular = {str(i): rng.sample(range(20), rng.randrange(6)) for i in range(0, 42, 2)} | {"x": [1, 2, 99]}
    tree_frame = spark.createDataFrame([(*r, i) for i, r in enumerate(tree)], "categoryid string, parentid string, row_id long")
    frame = spark.createDataFrame([(c, i, r + 1) for c, items in popular.items() for r, i in enumerate(items)], "category string, itemid long, rank long")
    tree[32] = ("7", "101")
    for n in (1, 4, 50):
        found = {}
        for r in sorted(rankings.sibling_items(tree_frame, frame, n).collect(), key=lambda r: (r.category, r.rank)):
            found.setdefault(r.category, []).append(r.itemid)
        assert found == by_turns(tree, {c: v[:n] for c, v in popular.items()}, n)


def test_no_child_meets_its_siblings(spark):
    """Two joins, both on a key that one side has once."""
    tree = spark.range(2000).select(F.col("id").cast("string").alias("categoryid"), F.lit("p").alias("parentid"))
    popular = spark.range(2000).select(F.col("id").cast("string").alias("category"), F.col("id").alias("itemid"), F.lit(1).cast("long").alias("rank"))
    found = rankings.sibling_items(tree, popular, 5)
    assert found.count() == 10_000
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
