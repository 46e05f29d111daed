import json
import math

import numpy as np
import pytest

from quillon.operators import fusion, learning
from quillon.plans import decisions, evaluations
from quillon.sources.tables import Dataset

TASKS = ("view", "addtocart", "transaction")


def dataset(spark, rows, categories, tree=()):
    events = spark.createDataFrame([(*r, *[None] * (5 - len(r)), i) for i, r in enumerate(rows)], "timestamp long, visitorid long, event string, itemid long, transactionid long, row_id long")
    properties = spark.createDataFrame([(0, i, "categoryid", c, n) for n, (i, c) in enumerate(categories.items())], "timestamp long, itemid long, property string, value string, row_id long")
    return Dataset(events, properties, spark.createDataFrame(list(tree) or [("1", None)], "categoryid string, parentid string"))


def manifest(train, validation):
    return {"source": "m", "train_end_ms": train, "validation_end_ms": validation, "session_gap_minutes": 30, "session_boundary_policy": "split_boundary_breaks_session", "prediction_horizon": "remainder_of_current_split_bounded_session"}


def test_baselines(spark):
    rows = [(0, 1, "view", 10), (1000, 1, "view", 11), (2000, 1, "addtocart", 11), (3000, 1, "transaction", 11, 1), (4000, 2, "view", 10), (5000, 2, "view", 12), (6000, 2, "view", 10), (7000, 3, "view", 10), (8000, 3, "view", 11), (9000, 3, "transaction", 11, 2), (10000, 4, "view", 10), (11000, 4, "addtocart", 11), (12000, 4, "transaction", 11, 3)]
    found = evaluations.evaluate_baselines(dataset(spark, rows, {10: "A", 11: "A", 12: "B"}), manifest(6000, 9000), k=2, neighbor_top_n=10)
    assert found["training_rows"] == 7 and found["validation_evaluated_sessions"] == found["test_evaluated_sessions"] == 1
    for split in ("validation", "test"):
        assert found["metrics"][split]["most_view"]["transaction"]["queries"] == 1
        assert found["metrics"][split]["last_item_transition"]["transaction"]["recall_at_k"] == 1.0
        assert found["visitor_cohorts"][split]["new"]["most_view"]["transaction"]["queries"] == 1
    assert math.isnan(found["metrics"]["validation"]["most_view"]["addtocart"]["ndcg_at_k"])
    json.dumps(found)


FUNNEL = [(t, v, "view", 10) for t, v in ((1000, 1), (1200, 2), (1400, 3), (1600, 4))] + [(t + 50, v, "view", i) for t, v, i in ((1000, 1, 11), (1200, 2, 12), (1400, 3, 11), (1600, 4, 12))]
for _t, _v, _i in ((3000, 5, 11), (3200, 6, 12), (5000, 7, 11), (7000, 8, 12)):
    FUNNEL += [(_t, _v, "view", 10), (_t + 50, _v, "view", _i), (_t + 60, _v, "addtocart", _i), (_t + 70, _v, "transaction", _i, _v)]


def test_rankers_and_fusion(spark):
    data, frozen = dataset(spark, FUNNEL, {10: "1", 11: "1", 12: "1"}), manifest(4000, 6000)
    found = evaluations.evaluate_learned(data, frozen, k=2, source_depth=3, internal_fit_fraction=0.5, max_sessions_per_split=None)
    assert set(found["training_examples"]) == set(TASKS) and all(n > 0 for n in found["training_positive_examples"].values())
    assert set(found["metrics"]["validation"]) == {"category_only", "equal_rrf", "learned_task_specific"}
    assert len(found["standardized_coefficients"]["view"]) == 8 and isinstance(found["validation_retain_learned_ranker"], bool)
    again = evaluations.evaluate_reranker(data, frozen, k=2, category_depth=3, behavioral_depth=3, internal_fit_fraction=0.5)
    assert again["metrics"]["test"]["learned_task_specific"] == found["metrics"]["test"]["learned_task_specific"]
    with pytest.raises(ValueError):
        evaluations.evaluate_reranker(data, frozen, parent_depth=1)
    hybrid = evaluations.evaluate_hybrid(data, frozen, k=2, source_depth=3)
    assert set(hybrid["variants"]) == set(evaluations.HYBRIDS) and set(hybrid["validation_ablation_delta_ndcg"]) == set(fusion.COMPONENTS)
    with pytest.raises(ValueError):
        evaluations.evaluate_hybrid(data, frozen, k=5, source_depth=3)


def test_stages(spark):
    rows = []
    for v, (t, i) in enumerate(zip((1000, 1200, 1400, 1600, 3000, 3300, 5000, 7000), (11, 12) * 4, strict=True)):
        rows += [(t, v, "view", 10), (t + 10, v, "view", i), (t + 20, v, "addtocart", i), (t + 40, v, "transaction", i, v)]
    found = evaluations.evaluate_stages(dataset(spark, rows, {10: "1", 11: "1", 12: "1"}), manifest(4000, 6000), k=2, category_depth=3, behavioral_depth=3, internal_fit_fraction=0.5)
    assert found["validation_queries"] == {"view_stage": 1, "cart_stage": 1}
    assert set(found["metrics"]["validation"]["stage_conditioned"]) == {"view_stage", "cart_stage"}


def test_retrieval_and_efficiency(spark):
    rows = [(1000, 1, "view", 10), (1050, 1, "view", 11), (1100, 2, "view", 10), (1150, 2, "view", 12), (1200, 3, "view", 20), (1250, 3, "view", 21)]
    for t, v, i in ((5000, 4, 12), (7000, 5, 11)):
        rows += [(t, v, "view", 10), (t + 10, v, "view", i), (t + 20, v, "addtocart", i), (t + 30, v, "transaction", i, v)]
    data = dataset(spark, rows, {10: "1", 11: "1", 12: "2", 20: "2", 21: "2"}, [("1", "9"), ("2", "9"), ("9", None)])
    found = evaluations.evaluate_retrieval(data, manifest(4000, 6000), k=1, base_depth=1, expanded_depth=3)
    size = found["candidate_size"]["validation"]
    assert size["expanded_union"]["mean"] >= size["base_union"]["mean"] > 0
    swept = evaluations.evaluate_efficiency(data, manifest(4000, 6000), category_depths=(1, 2), behavioral_depths=(1, 2), parent_depths=(0, 2))
    assert swept["expanded_reference"] == "c2_b2_p2" and len(swept["budgets"]) == 8
    assert swept["selected_efficient_configuration"] in swept["budgets"] and swept["validation_pareto_frontier"]
    for bad in ({"retention_threshold": 0}, {"category_depths": (0,)}, {"parent_depths": (-1,)}):
        with pytest.raises(ValueError):
            evaluations.evaluate_efficiency(data, manifest(4000, 6000), **bad)


def test_frontier():
    recall, size = {"cheap": 0.5, "dominated": 0.4, "high": 0.7}, {"cheap": 100, "dominated": 120, "high": 200}
    assert decisions.pareto_frontier(recall, size) == ["cheap", "high"]


def test_nan_retains_nothing():
    cell = {t: {"ndcg_at_k": math.nan} for t in TASKS}
    good = {t: {"ndcg_at_k": 0.5} for t in TASKS}
    assert not decisions.retain_learned({"a": cell, "b": good}, "a", "b")
    assert not decisions.retain_hybrid({"a": good, "b": good}, "a", ["b"])
    assert decisions.retain_hybrid({"a": {t: {"ndcg_at_k": 0.6} for t in TASKS}, "b": good}, "a", ["b"])


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 8))
    x[:, 7] = 0.0  # a constant feature
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(300) > 0.2).astype(int)
    frame = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "label int, " + ", ".join(f"{f} double" for f in fusion.FEATURES))
    model, n, p = learning.fit(frame)
    assert (n, p) == (300, y.sum())
    sd = x.std(0)
    z = np.c_[np.ones(300), (x - x.mean(0)) / np.where(sd, sd, 1)]
    w = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    penalty, beta = np.diag([0.0] + [1.0] * 8), np.zeros(9)
    for _ in range(60):
        chance = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.lstsq((z * (w * chance * (1 - chance))[:, None]).T @ z + penalty, z.T @ (w * (chance - y)) + penalty @ beta, rcond=None)[0]
    assert np.allclose([model.intercept, *model.coefficients], beta, atol=1e-6)
    with pytest.raises(ValueError):
        learning.fit(frame.where("label = 1"))


def test_final_selection(spark, tmp_path):
    metrics = {s: {v: {t: {"ndcg_at_k": 0.1} for t in TASKS} for v in ("category_conditioned_popularity", "learned_task_specific")} for s in ("validation", "test")}
    means = dict.fromkeys(("hybrid_full", "category_only", "learned_task_specific", "stage_conditioned"), 0.1)
    content = {v: {"metrics": metrics, "validation_mean_ndcg": means} for v in decisions.ARTIFACTS}
    for v, (flag, value) in decisions.FROZEN_FLAGS.items():
        content[v][flag] = value
    content["v0.6"]["validation_mean_candidate_recall"] = {"base_union": 0.6, "expanded_union": 0.7}
    size = {"c300_b100_p0": {"mean": 319.0}, "c300_b300_p300": {"mean": 690.0}}
    content["v0.7"] |= {"selected_efficient_configuration": "c300_b100_p0", "selected_test_retention": dict.fromkeys(TASKS, 0.97), "candidate_recall": {s: {"c300_b100_p0": dict.fromkeys(TASKS, 0.6)} for s in ("validation", "test")}, "candidate_size": {"test": size}}

    def write():
        for v, (folder, name) in decisions.ARTIFACTS.items():
            (tmp_path / folder).mkdir(exist_ok=True)
            (tmp_path / folder / name).write_text(json.dumps(content[v]))

    write()
    found = decisions.final_selection(spark, str(tmp_path))
    assert sum(r["decision"] == "reject" for r in found["benchmark"]) == 4
    assert found["evidence_summary"]["selected_retriever_test_mean_candidates"] == 319.0
    content["v0.8"]["validation_retain_learned_ranker"] = True
    write()
    with pytest.raises(ValueError, match="v0.8"):
        decisions.final_selection(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        decisions.final_selection(spark, str(tmp_path / "none"))
