"""Queries as rows with their lists: the same candidates, rankings, scores and fits as from a row for each candidate."""

import random

import numpy as np
import pytest

from quillon import queries
from quillon.functions.guards import EVENT_TYPES
from quillon.operators import fusion, learning, metrics, temporal
from quillon.operators.fusion import COMPONENTS, FEATURES
from quillon.plans import evaluations

DEPTH, K = 4, 3


@pytest.fixture(scope="module")
def made(spark):
    """Lists over few items, one of them null; some queries have no key of a list."""
    rng = random.Random(8)
    items = [None, *range(1, 9)]
    lists = lambda keys: [(key, i, n + 1) for key in keys for n, i in enumerate(rng.sample(items, rng.randint(1, 6)))]
    table = lambda name, keys: spark.createDataFrame(lists(keys), f"{name}, itemid long, rank long")
    one = table("none string", ["x"]).drop("none")
    s = fusion.Sources(
        one, spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1, 8)], "itemid long, category string"), table("category string", ["a"]), table("source long", [1, 2, 3]), table("source long", [1]), one,
        table("visitorid long", [1, 3]), None, table("none string", ["x"]).drop("none"),
    )
    asked = [("test", f"q{n}", rng.choice([1, 2, 3, 4]), rng.choice([None, *range(1, 9)])) for n in range(25)]
    frame = spark.createDataFrame(asked, "split string, query_id string, visitorid long, last_item long")
    wanted = [("test", q, t, i) for _, q, _, _ in asked for t in EVENT_TYPES for i in rng.sample(range(1, 9), rng.randint(0, 3))]
    return s, frame, spark.createDataFrame(wanted, "split string, query_id string, task string, itemid long")


def rows(frame, *names):
    return sorted(map(tuple, frame.select(*names).collect()), key=str)


def test_rankings_and_scores(made):
    s, asked, wanted = made
    found = fusion.looked_up(asked, s, COMPONENTS, DEPTH)
    gathered = fusion.gathered(asked, s, COMPONENTS, DEPTH, K)
    assert gathered.count() == asked.count()
    held = gathered.join(metrics.wanted_of(wanted), ["split", "query_id"])
    old = metrics.query_metrics(fusion.completed_variants(found, asked, s.fallback, evaluations.HYBRIDS, DEPTH, 60.0, K), wanted, list(evaluations.HYBRIDS), K)
    new = evaluations.hybrid_metrics(held, 60.0, K)
    told = lambda f: sorted((r.query_id, r.task, r.variant, round(r.recall, 9), round(r.ndcg, 9)) for r in f.collect())
    assert told(new) == told(old) and told(new)
    union = fusion.union_of(COMPONENTS)
    names = ("query_id", "task", "found", "positives")
    assert rows(metrics.row_recall(held, union), *names) == rows(metrics.candidate_recall(found, wanted), *names)
    assert rows(metrics.row_size(gathered, union, ["split"]), "mean", "median", "p95") == rows(metrics.candidate_size(found, asked, ["split"]), "mean", "median", "p95")
    features = fusion.features(found, dict.fromkeys(COMPONENTS, DEPTH), 60.0)
    models = dict(queries._MODELS)
    items = gathered.select("split", "query_id", fusion.items_of(COMPONENTS, 60.0, fallback=False).alias("items"))
    place = lambda f: sorted(((r.query_id, r.task, r["rank"], str(r.itemid), round(r.score, 9)) for r in f.collect()))
    assert learning.ranked_rows(items, models, K).columns == learning.ranked(features, models, K).columns
    assert place(learning.ranked_rows(items, models, K)) == place(learning.ranked(features, models, K))


def test_counted_training_rows(made):
    s, asked, wanted = made
    features = fusion.features(fusion.looked_up(asked, s, COMPONENTS, DEPTH), dict.fromkeys(COMPONENTS, DEPTH), 60.0)
    held = fusion.gathered(asked, s, COMPONENTS, DEPTH, K).join(metrics.wanted_of(wanted), ["split", "query_id"])
    counted = learning.counted_rows(held.select("split", "query_id", "wanted", fusion.items_of(COMPONENTS, 60.0, fallback=False).alias("items")), 2)
    for task in EVENT_TYPES:
        each = learning.training_rows(features, wanted, task, 2).groupBy("label", *FEATURES).count()
        assert rows(counted.where(f"task = '{task}'"), "label", *FEATURES, "n") == rows(each, "label", *FEATURES, "count")


def test_fits_take_their_steps_together(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((400, 8)) * 3) / 3
    x[:, 6] = 0.1  # a constant whose sum rounds
    y = (x[:, 0] - x[:, 1] + 0.4 * rng.standard_normal(400) > 0.2).astype(int)
    table = spark.createDataFrame([("ab"[i % 2], int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "model string, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    counted = table.groupBy("model", "label", *FEATURES).count().withColumnRenamed("count", "n")
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    taken = {}
    for group, names in (("one", ["a"]), ("both", ["a", "b"])):
        spark.sparkContext.setJobGroup(group, group)
        taken[group] = learning.fits(counted.where(counted.model.isin(names)), names)
        taken[f"{group} jobs"] = jobs(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert taken["both"]["a"][1:] == taken["one"]["a"][1:] == (200, int(y[::2].sum()))
    assert np.allclose(taken["both"]["a"][0].coefficients, taken["one"]["a"][0].coefficients, atol=1e-9)
    assert taken["both"]["a"][0].deviation[6] == 1.0
    assert taken["both jobs"] < 2 * taken["one jobs"]


def test_distinct_events_are_not_deduplicated_again(spark, sf):
    base = queries._Base(spark, sf)
    assert base.data.distinct and base.manifest() == temporal.build_manifest(queries.star_dataset(spark, sf).events, "events", session_gap_minutes=queries.GAP)
