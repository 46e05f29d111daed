"""Exchanges of the scored queries, and scoring and item counts against plain Python."""

import math
import random

from quillon import queries
from quillon.operators import metrics, rankings


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(f"Exchange {kind}") for kind in ("hashpartitioning", "SinglePartition", "rangepartitioning"))


def test_scores_share_exchanges(spark, sf):
    assert exchanges(queries.hybrid_metrics(spark, sf)) <= 13
    assert exchanges(queries.candidate_recall(spark, sf)) <= 19


def test_scoring_is_one_exchange(spark):
    ranked = spark.createDataFrame([("s", "q", "v", 1, 1)], "split string, query_id string, variant string, itemid long, rank long")
    positives = spark.createDataFrame([("s", "q", "view", 1)], "split string, query_id string, task string, itemid long")
    assert exchanges(metrics.query_metrics(ranked, positives, ["v"], 3)) == 1
    assert exchanges(metrics.candidate_recall(ranked, positives, ["v"])) == 1


def test_scores_match_plain_python(spark):
    rng = random.Random(5)
    ranks = {(f"q{q}", v): rng.sample(range(9), rng.randint(0, 6)) for q in range(12) for v in ("a", "b")}
    wanted = {(f"q{q}", t): set(rng.sample(range(9), rng.randint(0, 4))) for q in range(14) for t in ("view", "transaction")}
    rows = [("s", q, v, i, n + 1) for (q, v), items in ranks.items() for n, i in enumerate(items)]
    positives = [("s", q, t, i) for (q, t), items in wanted.items() for i in items]
    ranked = spark.createDataFrame(rows, "split string, query_id string, variant string, itemid long, rank long")
    asked = spark.createDataFrame(positives, "split string, query_id string, task string, itemid long")
    k = 4
    want = {}
    for (q, t), items in wanted.items():
        for v in ("a", "b", "none"):
            places = [n for n, i in enumerate(ranks.get((q, v), [])[:k]) if i in items]
            ideal = sum(1 / math.log2(n + 2) for n in range(min(k, len(items))))
            if items:
                want[q, t, v] = (round(len(places) / len(items), 9), round(sum(1 / math.log2(n + 2) for n in places) / ideal, 9))
    found = metrics.query_metrics(ranked, asked, ["a", "b", "none"], k).collect()
    assert {(r.query_id, r.task, r.variant): (round(r.recall, 9), round(r.ndcg, 9)) for r in found} == want
    # candidates may repeat, and count once
    twice = ranked.unionByName(ranked)
    recall = metrics.candidate_recall(twice, asked, ["a", "b"]).collect()
    assert {(r.query_id, r.task, r.variant): round(r.recall, 9) for r in recall} == {(q, t, v): round(len(items & set(ranks.get((q, v), []))) / len(items), 9) for (q, t), items in wanted.items() if items for v in ("a", "b")}
    whole = spark.createDataFrame([("s", f"q{q}") for q in range(14)], "split string, query_id string")
    sizes = {r.variant: r["mean"] for r in metrics.candidate_size(twice, whole, ["split", "variant"], ["a", "b"]).collect()}
    assert sizes == {v: sum(len(ranks.get((f"q{q}", v), [])) for q in range(14)) / 14 for v in ("a", "b")}


def test_lists_of_item_counts(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1000, 90_000_000, 700_000_000]), rng.choice(["view", "addtocart", "other", None]), rng.choice([1, 2, 3, 4, None]), n) for n in range(80)]
    train = spark.createDataFrame(rows, "timestamp long, event string, itemid long, row_id long")
    items = rankings.item_statistics(train, 7.0)
    key = lambda t: sorted((r["rank"], str(r.itemid), r.score) for r in t.collect())
    for event in ("view", "addtocart", "transaction"):
        assert str(key(rankings.listed(items, event, 3))) == str(key(rankings.event_popularity(train, event, 3)))
    assert str(key(rankings.listed(items, None, 9))) == str(key(rankings.decayed_popularity(train, 7.0, 9)))
