"""Ranks of positives counted beside their query's candidates, and training rows that are never arrays of structures: the same as in the query's row."""

import pytest
from pyspark.sql import functions as F
from test_gathered import DEPTH, K, made, rows  # noqa: F401

from quillon import queries
from quillon.functions.guards import EVENT_TYPES
from quillon.operators import fusion, learning, metrics
from quillon.operators.fusion import COMPONENTS, FEATURES

PLAIN = {"category_only": ["category"], "rrf": list(COMPONENTS), "two": ["recency", "visitor_history"]}


def held_of(made):  # noqa: F811
    s, asked, wanted = made
    return fusion.gathered(asked, s, COMPONENTS, DEPTH, K).join(metrics.wanted_of(wanted), ["split", "query_id"])


def orders_of(short=None):
    return [*[fusion.fused_order(parts, 60.0, short) for parts in PLAIN.values()], learning.learned_order([(F.col("task") == t, m) for t, m in queries._MODELS.items()])]


@pytest.mark.parametrize("short", [None, 2])
def test_places(made, short):  # noqa: F811
    held = held_of(made)
    items = held.select("split", "query_id", "wanted", fusion.items_of(COMPONENTS, 60.0).alias("items"), fusion.items_of(COMPONENTS, 60.0, short).alias("short"))
    plain = [fusion.fused_items(F.col("short"), parts, K).alias(v) for v, parts in PLAIN.items()]
    ranked = items.select("*", *plain, *[learning.ranked_items(F.col("items"), m, K).alias(t) for t, m in queries._MODELS.items()])
    each = ranked.select("*", F.inline("wanted"))
    learned = F.coalesce(*[F.when(F.col("task") == t, metrics.place_of(F.col(t))) for t in EVENT_TYPES])
    want = each.select("query_id", "task", "itemid", *[metrics.place_of(F.col(v)).alias(f"_p{i}") for i, v in enumerate(PLAIN)], learned.alias(f"_p{len(PLAIN)}"))
    found = metrics.positive_places(held, orders_of(short), 60.0, K)
    names = ["query_id", "task", "itemid", *[f"_p{i}" for i in range(len(PLAIN) + 1)]]
    assert rows(found, *names) == rows(want, *names)
    assert found.where("_p0 is not null").count() and found.where("_p0 is null").count()
    union = fusion.union_of(COMPONENTS)
    names = ("query_id", "task", "found", "positives")
    assert rows(metrics.place_sums(found, len(PLAIN) + 1), *names) == rows(metrics.row_recall(held, union), *names)


def test_a_task_without_a_model_has_no_rank(made):  # noqa: F811
    order = learning.learned_order([(F.col("task") == "view", queries._MODELS["view"])])
    found = metrics.positive_places(held_of(made), [order], 60.0, K)
    assert found.where("task = 'view' and _p0 is not null").count() and not found.where("task <> 'view' and _p0 is not null").count()


def test_training_rows(made):  # noqa: F811
    held = held_of(made)
    old = learning.counted_rows(held.select("split", "query_id", "wanted", fusion.items_of(COMPONENTS, 60.0, fallback=False).alias("items")), 2)
    new = learning.counted_candidates(held, 60.0, 2)
    names = ("task", "label", *FEATURES, "n")
    assert rows(new, *names) == rows(old, *names) and new.count()


def test_the_jvm_compiles_the_code(spark, made):  # noqa: F811
    """Methods of 8,000 bytes or more stay interpreted, which is much slower."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = [fusion.fused_order(["category"], 60.0), fusion.fused_order(COMPONENTS, 60.0)]
        by_task = learning.learned_order([(F.col("task") == t, m) for t, m in queries._MODELS.items()])
        by_cell = learning.learned_order([((F.lit("s") == st) & (F.col("task") == t), m) for (st, t), m in queries._STAGE_MODELS.items()])
        for orders in ([*plain, by_task], [plain[0], by_cell, by_cell]):
            code = metrics.positive_places(held_of(made), orders, 60.0, K)._jdf.queryExecution().debug().codegenToSeq()
            assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
