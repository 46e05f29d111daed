import numpy as np

from quillon import queries


def test_sampled_sessions_are_the_draw_of_all(spark, sf):
    """Places drawn by NumPy among all eligible sessions in the order of visitor and session."""
    base = queries._Base(spark, sf)
    whole = queries.sessions.session_queries(base.split, "test", queries.GAP).queries.select("visitorid", "query_id").collect()
    ordered = sorted((r.visitorid, int(r.query_id.split(":")[1])) for r in whole)
    assert len(ordered) > 20
    places = np.sort(np.random.default_rng(365).choice(len(ordered), size=20, replace=False))
    found = {r.query_id for r in queries.sampled_sessions(spark, sf).collect()}
    assert found == {"{}:{}".format(*ordered[p]) for p in places}


def test_one_scan_serves_both_cutoffs(spark, monkeypatch):
    """Evaluations of rankers read the properties once, for both cutoffs, and baselines score once for all cohorts."""
    from quillon.operators import metrics, rankings
    from quillon.plans import evaluations
    from tests.test_evaluations import FUNNEL, dataset, manifest

    calls = []
    for module, name in ((rankings, "states_at"), (rankings, "latest_category"), (metrics, "query_metrics"), (metrics, "cohort_metrics")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **b: calls.append(n) or f(*a, **b))
    data, frozen = dataset(spark, FUNNEL, {10: "1", 11: "1", 12: "1"}), manifest(4000, 6000)
    evaluations.evaluate_reranker(data, frozen, k=2, category_depth=3, behavioral_depth=3, internal_fit_fraction=0.5)
    assert calls.count("states_at") == 1 and "latest_category" not in calls
    calls.clear()
    evaluations.evaluate_baselines(data, frozen, k=2, neighbor_top_n=3)
    assert calls.count("cohort_metrics") == 1 and "query_metrics" not in calls


def test_drawn_negatives(spark):
    """All that is left where the catalogue is small, no positive, no repeat, the same in every run, and places drawn about evenly."""
    from collections import Counter

    from quillon.operators import temporal

    catalog = spark.range(50).selectExpr("id * 3 as itemid")
    queries = spark.range(400).selectExpr("concat('q', id) as query_id", "'test' as split")
    positives = queries.selectExpr("split", "query_id", "explode(array(0L, 3L, 999L)) as itemid")
    keys = ["split", "query_id"]
    drawn = lambda n, seed=1: sorted(tuple(r) for r in temporal.drawn_negatives(queries.repartition(n % 3 + 1), positives, catalog, keys, n, seed).select("query_id", "draw", "itemid").collect())
    some = drawn(5)
    assert len(some) == 2000 and some == drawn(5) and some != drawn(5, 2)
    assert {i for _, _, i in some}.isdisjoint({0, 3}) and len({(q, i) for q, _, i in some}) == 2000
    counts = Counter(i for _, _, i in some)
    assert len(counts) == 48 and max(counts.values()) < 3 * min(counts.values())
    assert {(q, i) for q, _, i in drawn(100)} == {(f"q{q}", 3 * i) for q in range(400) for i in range(2, 50)}
    assert drawn(0) == []
    assert [temporal.next_prime(n) for n in (0, 2, 4, 90, 100, 7919)] == [2, 2, 5, 97, 101, 7919]
