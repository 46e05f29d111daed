import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, fusion, metrics, rankings, sessions
from quillon.sources import tables
from quillon.sources.artifacts import read_manifest

EVENTS = "timestamp long, visitorid long, event string, itemid long, transactionid long, row_id long"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)), i) for i, r in enumerate(rows)], EVENTS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    (at / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1000,1,view,10,\n2000,1,addtocart,10,\n3000,2,view,20,\n4000,2,transaction,20,99\n4000,2,transaction,20,99.0\n")
    (at / "item_properties_part1.csv").write_text("timestamp,itemid,property,value\n500,10,categoryid,1\n1500,10,available,1\n500,20,categoryid,2\n500,30,available,1\n")
    (at / "item_properties_part2.csv").write_text("timestamp,itemid,property,value\n2500,10,available,0\n3500,20,available,1\n3500,20,colorhash,abc\n")
    (at / "category_tree.csv").write_text("categoryid,parentid\n1,\n2,1\n3,1\n")
    return at


def test_dataset_audit(spark, folder):
    data = tables.read_dataset(spark, str(folder))
    found = audit.dataset_audit(data.events, data.properties, data.tree, "x")
    e, p, t = found["events"], found["properties"], found["category_tree"]
    assert (e["row_count"], e["unique_visitors"], e["unique_items"], e["exact_duplicate_rows"]) == (5, 2, 2, 1)
    assert e["event_counts"] == {"addtocart": 1, "transaction": 2, "view": 2}
    assert (e["transaction_rows"], e["transaction_rows_with_id"], e["nontransaction_rows_with_transaction_id"]) == (2, 2, 0)
    assert (p["row_count"], p["unique_items"], p["unique_properties"], p["items_with_multiple_property_timestamps"]) == (7, 3, 3, 2)
    assert (p["category_property_unique_items"], p["available_property_unique_items"]) == (2, 3)
    assert (t["unique_categories"], t["root_categories"], t["missing_parent_references"], t["self_parent_rows"], t["has_cycle"]) == (3, 1, 0, 0, False)
    assert [v for k, v in found["coverage"].items() if k.endswith("coverage")] == [1.0] * 3


def test_missing_files_and_columns(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError, match="category_tree.csv"):
        tables.require_files(spark, str(tmp_path))
    (tmp_path / "events.csv").write_text("timestamp,event\n1,view\n")
    with pytest.raises(ValueError, match="events.csv: missing required columns"):
        tables.read_csv(spark, str(tmp_path / "events.csv"), tables.EVENTS, "events.csv")


@pytest.mark.parametrize("rows,cycle", [([("1", "2"), ("2", "1")], True), ([("1", "1")], True), ([("1", None), ("2", "1"), ("3", "2"), ("4", "9")], False), ([("1", "2"), ("2", "1"), ("2", None)], False)])
def test_cycles(spark, rows, cycle):
    frame = spark.createDataFrame(rows, "categoryid string, parentid string").coalesce(1)
    assert audit.has_cycle(frame) is cycle


def test_observed_paths(spark):
    rows = [(1, 10, "view", 100), (2, 10, "addtocart", 100), (3, 10, "transaction", 100, 900), (3, 10, "transaction", 100, 900), (1, 11, "addtocart", 101), (2, 11, "transaction", 101, 901), (3, 12, "transaction", 102, 902), (1, 13, "view", 103), (3, 13, "transaction", 103, 903), (4, 14, "addtocart", 104), (5, 14, "view", 104)]
    found = audit.observation_audit(table(spark, rows), "x")
    assert (found["raw_rows"], found["exact_duplicate_rows"], found["deduplicated_rows"], found["unique_visitor_item_pairs"]) == (11, 1, 10, 5)
    assert found["pair_pattern_counts"] == dict.fromkeys(("addtocart+transaction", "transaction", "view+addtocart", "view+addtocart+transaction", "view+transaction"), 1)
    assert (found["cart_pairs"], found["cart_pairs_with_prior_view"], found["transaction_pairs"], found["transaction_pairs_with_prior_view"]) == (3, 1, 4, 2)
    assert (found["transaction_pairs_with_prior_cart"], found["transaction_pairs_with_prior_view_and_cart"], found["transaction_pairs_with_ordered_view_cart"]) == (2, 1, 1)


def test_unexpected_types_are_other(spark):
    assert audit.observation_audit(table(spark, [(1, 1, "signup", 1)]), "x")["pair_pattern_counts"] == {"other": 1}


TRAIN = [(0, 1, "view", 10), (1000, 1, "view", 11), (2000, 1, "addtocart", 11), (3000, 1, "transaction", 11, 1), (4000, 2, "view", 10), (5000, 2, "view", 12), (6000, 2, "view", 10)]


def lists(frame, key):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r[key], r["rank"])):
        out.setdefault(r[key], []).append(r["itemid"])
    return out


def test_neighbors_and_history(spark):
    train = table(spark, TRAIN)
    pairs = rankings.adjacent_pairs(train, 30)
    assert lists(rankings.neighbors(pairs, 10), "source") == {10: [11, 12], 12: [10]}
    assert lists(rankings.neighbors(pairs, 10, symmetric=True), "source") == {10: [12, 11], 11: [10], 12: [10]}
    assert lists(rankings.visitor_history(train, 10), "visitorid") == {1: [11, 10], 2: [10, 12]}
    assert [r.itemid for r in rankings.event_popularity(train, "view").orderBy("rank").collect()] == [10, 11, 12]
    assert {r.itemid: r.cohort for r in rankings.item_cohorts(train).collect()} == {10: "head", 11: "mid_tail", 12: "long_tail"}


def test_latest_category_and_siblings(spark):
    properties = spark.createDataFrame([(1, 10, "categoryid", "1", 0), (5, 10, "categoryid", "2", 1), (5, 10, "categoryid", "3", 2), (9, 10, "categoryid", "4", 3), (1, 11, "available", "1", 4)], "timestamp long, itemid long, property string, value string, row_id long")
    assert [tuple(r) for r in rankings.latest_category(properties, 5).collect()] == [(10, "3")]
    popular = spark.createDataFrame([("1", 10, 1), ("1", 11, 2), ("2", 20, 1), ("2", 21, 2)], "category string, itemid long, rank long")
    tree = spark.createDataFrame([("1", "9"), ("2", "9"), ("9", None)], "categoryid string, parentid string")
    assert lists(rankings.sibling_items(tree, popular, 4), "category") == {"1": [10, 20, 11, 21], "2": [10, 20, 11, 21]}


def candidates(spark, found):
    return spark.createDataFrame([("test", "q", s, i, r + 1) for s, items in found.items() for r, i in enumerate(items)], "split string, query_id string, source string, itemid long, rank long")


def test_fusion_and_completion(spark):
    found = candidates(spark, {"category": [1, 2, 3], "covisitation": [2, 4, 1]})
    out = fusion.fused(found, ("category", "covisitation"), 4, 0, 4).orderBy("rank").collect()
    assert [r.itemid for r in out] == [2, 1, 4, 3] and [round(r.score, 4) for r in out] == [1.5, 1.3333, 0.5, 0.3333]
    query = spark.createDataFrame([("test", "q")], "split string, query_id string")
    fallback = spark.createDataFrame([(2, 1), (5, 2), (6, 3)], "itemid long, rank long")
    ranked = spark.createDataFrame([("test", "q", 1, 1), ("test", "q", 2, 2)], "split string, query_id string, itemid long, rank long")
    assert [r.itemid for r in fusion.completed(ranked, query, fallback, 3).orderBy("rank").collect()] == [1, 2, 5]
    for depth, offset in ((3, 0), (4, -1)):
        with pytest.raises(ValueError):
            fusion.fused(found, ("category",), depth, offset, 4)


def test_features_and_budgets(spark):
    out = fusion.features(candidates(spark, {"category": [2, 1], "covisitation": [1], "recency": [3]}), dict.fromkeys(fusion.COMPONENTS, 3), 1).orderBy("itemid").collect()
    assert [r.itemid for r in out] == [1, 2, 3]
    assert [(out[0].category_rr, out[0].covisitation_rr, out[0].recency_present)] == [(1 / 3, 0.5, 0.0)]
    found = candidates(spark, {"category": [1, 2, 3, 4], "covisitation": [7, 8], "visitor_history": [10]})
    assert sorted(r.itemid for r in fusion.features(found, {"category": 4, "covisitation": 1, "recency": 1, "visitor_history": 1}, 0).collect()) == [1, 2, 3, 4, 7, 10]
    assert [b.key for b in fusion.budget_grid((1, 2), (1,), (0, 2))] == ["c1_b1_p0", "c2_b1_p0", "c1_b1_p2", "c2_b1_p2"]


def test_recall_and_ndcg(spark):
    ranked = spark.createDataFrame([("t", "q", "v", i, r + 1) for r, i in enumerate([3, 2, 1])], "split string, query_id string, variant string, itemid long, rank long")
    positives = spark.createDataFrame([("t", "q", "view", 1), ("t", "q", "view", 3), ("t", "q", "transaction", 99)], "split string, query_id string, task string, itemid long")
    found = {r.task: r for r in metrics.query_metrics(ranked, positives, ["v"], 3).collect()}
    assert found["view"].recall == 1.0 and round(found["view"].ndcg, 6) == 0.919721
    assert found["transaction"].recall == found["transaction"].ndcg == 0.0


def test_stage_queries(spark):
    events = table(spark, [(1, 1, "view", 10), (2, 1, "addtocart", 11), (3, 1, "transaction", 11, 1)]).withColumn("split", F.lit("validation"))
    found = sessions.stage_queries(events, "validation")
    assert sorted(r.stage for r in found.queries.collect()) == ["cart_stage", "view_stage"]
    assert [tuple(r)[2:] for r in found.positives.where("stage = 'cart_stage'").collect()] == [("cart_stage", "transaction", 11)]


def test_sampled_sessions(spark):
    events = table(spark, [(1000 * i + j, i, "view", j) for i in range(30) for j in range(2)]).withColumn("split", F.lit("test"))
    one, two = (sessions.session_queries(events, "test", 30, 7, 365) for _ in range(2))
    ids = lambda q: sorted(r.query_id for r in q.queries.collect())
    assert ids(one) == ids(two) and len(ids(one)) == 7 and one.eligible == 30


def test_command_line(spark, folder, tmp_path):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-m", "quillon", "audit", str(folder), "--output-dir", str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads((tmp_path / "audit.json").read_text())["events"]["row_count"] == 5
    assert "exact_duplicate_rows" in (tmp_path / "audit.md").read_text()


def test_manifest_contract(spark):
    good = {"train_end_ms": 1, "validation_end_ms": 2, "session_gap_minutes": 30, "session_boundary_policy": "split_boundary_breaks_session", "prediction_horizon": "remainder_of_current_split_bounded_session"}
    assert read_manifest(spark, good) == good
    for change in ({"session_boundary_policy": "x"}, {"prediction_horizon": "x"}):
        with pytest.raises(ValueError):
            read_manifest(spark, good | change)
    with pytest.raises(ValueError):
        read_manifest(spark, {k: v for k, v in good.items() if k != "train_end_ms"})
