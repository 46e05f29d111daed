"""Evaluations: from a dataset and a manifest to a report, each a few joins and aggregates over long tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce, wraps
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import EVENT_TYPES, require_at_least, require_positive, require_share
from ..functions.ranks import drop_path, first_n, nearest_index, new_path, values_at
from ..operators import fusion, learning, metrics, rankings, sessions, temporal
from ..operators.fusion import COMPONENTS
from ..sources.tables import Dataset, deduplicated
from . import decisions
from .reports import NOTES

BASELINES = ("most_view", "most_addtocart", "most_transaction", "time_decayed_popularity", "visitor_history_repeat", "last_item_covisitation", "last_item_transition", "category_conditioned_popularity")
HYBRIDS = {f"{c}_only": [c] for c in COMPONENTS} | {"hybrid_full": list(COMPONENTS)} | {f"hybrid_minus_{c}": [x for x in COMPONENTS if x != c] for c in COMPONENTS}
#: Variants of retrieval: category depth, behavioral depth, parent list; base or expanded.
RETRIEVALS = {"base_union": ("base", "base", None), "deep_category": ("expanded", "base", None), "deep_behavioral": ("base", "expanded", None), "parent_category": ("base", "base", "expanded"), "expanded_union": ("expanded", "expanded", "expanded")}
# Where queries stand, as reports name it.
POINT = "after_first_event_of_each_multi_event_split_bounded_session"
STAGE_POINTS = {"view_stage": "after_first_event_only_when_first_event_is_view", "cart_stage": "immediately_after_first_observed_addtocart_with_later_session_events"}
SPLITS = ("validation", "test")
VISITOR_COHORTS, ITEM_COHORTS = ("new", "sparse", "repeat"), ("head", "mid_tail", "long_tail", "unseen")


#: What gives back the frames that the evaluation in progress has persisted or written.
_HELD: list[list[Callable[[], object]]] = []


def keep(df: DataFrame) -> DataFrame:
    """The frame, persisted until the evaluation ends."""
    if _HELD:
        _HELD[-1].append(df.persist().unpersist)
    return df


def written(df: DataFrame) -> DataFrame:
    """The frame, read from a table that is there until the evaluation ends. Unlike a persisted one its tasks are as many as its rows ask for, not as many as shuffles have partitions, each of which writes a file for each of the next."""
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    if _HELD:
        _HELD[-1].append(lambda: drop_path(df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def releasing(f: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
    """An evaluation that gives back what it has persisted, however it ends."""

    @wraps(f)
    def run(*args: Any, **parameters: Any) -> dict[str, Any]:
        _HELD.append([])
        try:
            return f(*args, **parameters)
        finally:
            for give_back in _HELD.pop():
                give_back()

    return run


@dataclass(frozen=True)
class Protocol:
    """A dataset under a manifest: labelled events, the training part, queries of validation and test; the layout of all events by session, and the end of the internal fit window where there is one."""

    events: DataFrame
    train: DataFrame
    asked: sessions.Queries
    counts: dict[str, tuple[int, int]]
    pairs: DataFrame | None = None
    laid: DataFrame | None = None
    end: int | None = None


def protocol(data: Dataset, manifest: dict[str, Any], max_sessions: int | None, seed: int, stages: bool = False, fit_fraction: float | None = None) -> Protocol:
    """Events are laid out by session once, for queries of all splits, positives, pairs and the internal parts of training, and written, so that each of these reads its own columns."""
    events = temporal.with_split(data.events if data.distinct else keep(deduplicated(data.events)), manifest["train_end_ms"], manifest["validation_end_ms"])
    train, gap = events.where("split = 'train'"), manifest["session_gap_minutes"]
    end = None if fit_fraction is None else fit_end(train, fit_fraction)
    laid = temporal.named(written(sessions.laid_out(events, gap, end, stages).drop("session_id", "row_id")))
    if max_sessions is None:  # all sessions of both splits: one reading
        rows = laid.where("split <> 'train' and events >= 2")
        eligible = {r["split"]: r["count"] for r in rows.where("place = 0").groupBy("split").count().collect()}
        both = (sessions.staged if stages else sessions.asked)(rows, sum(eligible.values()))
        evaluated = None if stages else eligible
    else:
        ask = sessions.stage_queries if stages else sessions.session_queries
        each = {s: ask(laid, s, gap, max_sessions, seed + i) for i, s in enumerate(SPLITS)}
        eligible = {s: q.eligible for s, q in each.items()}
        both = each["validation"].union(each["test"])
        evaluated = None
    # where rankers are fitted too, positives are read once
    both = sessions.Queries(written(both.queries), both.positives if end is not None else written(both.positives), both.eligible)
    if evaluated is None:
        evaluated = {r["split"]: r["count"] for r in both.queries.groupBy("split").count().collect()}
    return Protocol(events, train, both, {s: (eligible.get(s, 0), evaluated.get(s, 0)) for s in SPLITS}, sessions.following_pairs(laid.where("split = 'train'")), laid, end)


def _cell(row: Any) -> dict[str, Any]:
    return {"queries": row["queries"], "recall_at_k": row["recall"], "ndcg_at_k": row["ndcg"]} if row else {"queries": 0, "recall_at_k": math.nan, "ndcg_at_k": math.nan}


def nested(table: DataFrame | list[Any], by: Sequence[str], levels: Sequence[Sequence[str]]) -> dict[str, Any]:
    """A report's nesting of an aggregated table; absent cells have no queries and NaN."""
    rows = {tuple(r[c] for c in by): r for r in (table if isinstance(table, list) else table.collect())}  # splits, variants, tasks and cohorts

    def build(prefix: tuple, left: Sequence[Sequence[str]]) -> Any:
        return {v: build((*prefix, v), left[1:]) for v in left[0]} if left else _cell(rows.get(prefix))

    return build((), levels)


def _recalls(scored: DataFrame, variants: Sequence[str] | None) -> dict[str, Any]:
    by = ["split", *(["variant"] if variants else []), "task"]
    rows = {tuple(r[c] for c in by): r["recall"] for r in scored.groupBy(*by).agg(F.avg("recall").alias("recall")).collect()}
    if variants is None:
        return {s: {t: rows.get((s, t), math.nan) for t in EVENT_TYPES} for s in SPLITS}
    return {s: {v: {t: rows.get((s, v, t), math.nan) for t in EVENT_TYPES} for v in variants} for s in SPLITS}


def _sizes(table: DataFrame, variants: Sequence[str] | None) -> dict[str, Any]:
    by = ["split", *(["variant"] if variants else [])]
    rows = {tuple(r[c] for c in by): {n: float(r[n]) for n in ("mean", "median", "p95")} for r in table.collect()}
    none = {"mean": 0.0, "median": 0.0, "p95": 0.0}
    return {s: {v: rows.get((s, v), none) for v in variants} if variants else rows.get((s,), none) for s in SPLITS}


def _head(manifest: dict[str, Any], source: str, p: Protocol, seed: int, **parameters: Any) -> dict[str, Any]:
    return {"source": source, "manifest": manifest.get("source", ""), **parameters, "prediction_point": POINT, "prediction_horizon": manifest["prediction_horizon"], "validation_evaluated_sessions": p.counts["validation"][1], "test_evaluated_sessions": p.counts["test"][1], "evaluation_sample_seed": seed}


def baseline_rankings(p: Protocol, sources: fusion.Sources, k: int) -> DataFrame:
    """Rankings of the eight baselines for each query; those by key are completed with the most viewed items."""
    queries = p.asked.queries
    same = [(name, rankings.listed(sources.items, name.removeprefix("most_"), k)) for name in BASELINES[:3]] + [(BASELINES[3], rankings.listed(sources.items, None, k))]
    lists = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("variant"), "itemid", "rank") for name, t in same])
    for_all = queries.select("split", "query_id").crossJoin(F.broadcast(lists))  # four lists of k items
    names = dict(zip(("visitor_history", "covisitation", "transition", "category"), BASELINES[4:], strict=True))
    found = fusion.looked_up(queries, sources, list(names), k)
    # a list alone is its own fusion
    own = fusion.completed_variants(found, queries, sources.fallback, {v: [c] for c, v in names.items()}, k, 60.0, k)
    return for_all.unionByName(own.select("split", "query_id", "variant", "itemid", "rank"))


@releasing
def evaluate_baselines(data: Dataset, manifest: dict[str, Any], source: str = "", k: int = 20, half_life_days: float = 7.0, neighbor_top_n: int = 50, max_sessions_per_split: int | None = 50_000, seed: int = 365) -> dict[str, Any]:
    """Recall and NDCG of the baselines, over all queries, by the visitor's history, and by the popularity of positives."""
    require_positive(k=k, half_life_days=half_life_days)
    p = protocol(data, manifest, max_sessions_per_split, seed)
    sources = fusion.fit_sources(p.train, data.properties, None, manifest["train_end_ms"], manifest["session_gap_minutes"], max(k, neighbor_top_n), half_life_days, p.asked.queries, k, pairs=p.pairs)
    visitors = p.asked.queries.join(rankings.history_counts(p.train), "visitorid", "left").select("split", "query_id", rankings.visitor_cohort(F.col("history")).alias("cohort"))
    parts = p.asked.positives.join(rankings.item_cohorts(p.train), "itemid", "left").withColumn("cohort", F.coalesce("cohort", F.lit("unseen")))
    rows = metrics.cohort_metrics(baseline_rankings(p, sources, k), parts, visitors, BASELINES, k).collect()  # splits, cohorts, variants and tasks
    of = {scope: [r for r in rows if r["scope"] == scope] for scope in ("overall", "visitor", "item")}
    keys = ["split", "cohort", "variant", "task"]
    return _head(manifest, source, p, seed, k=k) | {
        "training_rows": p.train.count(), "validation_sessions": p.counts["validation"][0], "test_sessions": p.counts["test"][0],
        "visitor_cohort_definition": {"new": "no training event", "sparse": "1 to 4 training events", "repeat": "5 or more training events"},
        "item_cohort_definition": {"head": "most popular tenth of training items", "mid_tail": "next four tenths", "long_tail": "the rest", "unseen": "not in training"},
        "baselines": list(BASELINES),
        "metrics": nested(of["overall"], ["split", "variant", "task"], [SPLITS, BASELINES, EVENT_TYPES]),
        "visitor_cohorts": nested(of["visitor"], keys, [SPLITS, VISITOR_COHORTS, BASELINES, EVENT_TYPES]),
        "item_cohorts": nested(of["item"], keys, [SPLITS, ITEM_COHORTS, BASELINES, EVENT_TYPES]),
        "notes": NOTES["baselines"],
    }


def gathered_rows(p: Protocol, s: fusion.Sources, depths: dict[str, int] | int, k: int) -> tuple[DataFrame, DataFrame]:
    """The queries with their lists, a row each (see fusion.gathered), and those with positives beside these, which alone are scored."""
    rows = written(fusion.gathered(p.asked.queries, s, COMPONENTS, depths, k))
    keys = fusion.keys_of(rows)
    # few bytes and much work: as many tasks as shuffles have partitions, not as few as the bytes would fill
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return rows, dealt.join(metrics.wanted_of(p.asked.positives), keys)


def hybrid_metrics(rows: DataFrame, offset: float, k: int) -> DataFrame:
    """Recall and NDCG of each query with a positive, by HYBRIDS; ``rows`` as of gathered_rows()."""
    held = rows.select("split", "query_id", "wanted", fusion.items_of(COMPONENTS, offset).alias("items"))
    ranked = held.select("split", "query_id", "wanted", *[fusion.fused_items(F.col("items"), parts, k).alias(v) for v, parts in HYBRIDS.items()])
    return metrics.row_metrics(ranked, {v: metrics.place_of(F.col(v)) for v in HYBRIDS}, k)


def fused_rankings(candidates: DataFrame, queries: DataFrame, fallback: DataFrame, variants: dict[str, list[str]], depth: int, offset: float, k: int) -> DataFrame:
    """Completed fusions of several sets of components."""
    return fusion.completed_variants(candidates, queries, fallback, variants, depth, offset, k)


@releasing
def evaluate_hybrid(data: Dataset, manifest: dict[str, Any], source: str = "", k: int = 20, source_depth: int = 100, rrf_offset: float = 60.0, half_life_days: float = 7.0, max_sessions_per_split: int | None = 50_000, seed: int = 365) -> dict[str, Any]:
    """Fusion of the four sources, each alone, and all but each; whether validation retains the whole."""
    require_positive(k=k)
    require_at_least(k, "k", source_depth=source_depth)
    p = protocol(data, manifest, max_sessions_per_split, seed)
    s = fusion.fit_sources(p.train, data.properties, None, manifest["train_end_ms"], manifest["session_gap_minutes"], source_depth, half_life_days, p.asked.queries, k, pairs=p.pairs)
    scored = hybrid_metrics(gathered_rows(p, s, source_depth, k)[1], rrf_offset, k)
    cells = nested(metrics.averaged(scored, ["split", "variant", "task"]), ["split", "variant", "task"], [SPLITS, list(HYBRIDS), EVENT_TYPES])
    own = cells["validation"]
    delta = {c: {t: own["hybrid_full"][t]["ndcg_at_k"] - own[f"hybrid_minus_{c}"][t]["ndcg_at_k"] for t in EVENT_TYPES} for c in COMPONENTS}
    return _head(manifest, source, p, seed, k=k, source_depth=source_depth, rrf_offset=rrf_offset) | {
        "components": list(COMPONENTS), "variants": HYBRIDS, "metrics": cells, "validation_ablation_delta_ndcg": delta, "validation_mean_ndcg": decisions.mean_ndcg(own),
        "validation_retain_full_hybrid": decisions.retain_hybrid(own, "hybrid_full", [f"{c}_only" for c in COMPONENTS]),
        "retain_rule": "mean validation NDCG above that of every single component, and no task below the best of them on two of three tasks", "notes": NOTES["hybrid"],
    }


def fit_end(train: DataFrame, fraction: float) -> int:
    """The end of the internal fit window."""
    return values_at(train, "timestamp", [nearest_index(train.count(), fraction)])[0]


def _internal(train: DataFrame, fraction: float) -> tuple[int, DataFrame, DataFrame]:
    """The end of the internal fit window, events up to it, and later ones under the split name ranker_train."""
    end = fit_end(train, fraction)
    return end, train.where(F.col("timestamp") <= end), train.where(F.col("timestamp") > end).withColumn("split", F.lit("ranker_train"))


def _inner(asked: sessions.Queries) -> sessions.Queries:
    return replace(asked, queries=written(asked.queries))


def _inner_sources(p: Protocol, data: Dataset, queries: DataFrame, gap: float, depth: int, half_life_days: float, k: int, states: DataFrame) -> fusion.Sources:
    """Lists of the internal fit window for the queries after it."""
    return fusion.fit_sources(p.train.where(F.col("timestamp") <= p.end), data.properties, None, p.end, gap, depth, half_life_days, queries, k, _category(states, "inner"), sessions.earlier_pairs(p.laid, p.end))


def _category(states: DataFrame, name: str) -> DataFrame:
    """itemid, category of one of several cutoffs, see rankings.states_at."""
    return states.where(F.col(name).isNotNull()).select("itemid", F.col(name).alias("category"))


def _counted(inner: sessions.Queries, sources: fusion.Sources, depths: dict[str, int], offset: float, max_nonrelevant: int) -> DataFrame:
    """Training rows of all tasks, counted by their features."""
    rows = fusion.gathered(inner.queries, sources, COMPONENTS, depths, 1).join(metrics.wanted_of(inner.positives), fusion.keys_of(inner.queries))
    return learning.counted_candidates(rows, offset, max_nonrelevant)


@releasing
def evaluate_reranker(
    data: Dataset, manifest: dict[str, Any], source: str = "", k: int = 20, category_depth: int = 300, behavioral_depth: int = 100, parent_depth: int = 0, rrf_offset: float = 60.0, half_life_days: float = 7.0, internal_fit_fraction: float = 0.80,
    max_internal_ranker_sessions: int | None = 20_000, max_sessions_per_split: int | None = 50_000, max_nonrelevant_per_query: int = 50, seed: int = 365, rrf_name: str = "efficient_rrf",
    models: dict[str, learning.Model] | None = None,
) -> dict[str, Any]:
    """Logistic rerankers by task on the union of sources, against category order and fusion on the same candidates.

    Coefficients come from the later part of the training period, with lists fitted on its earlier part; lists are fitted anew on the
    whole period for evaluation. Fusion takes every list to the category depth at most. With ``models``, rankers by task, nothing is fitted.
    """
    require_positive(k=k)
    require_at_least(k, "k", category_depth=category_depth, behavioral_depth=behavioral_depth)
    if parent_depth:
        raise ValueError("parent_depth must be 0")
    require_share("internal_fit_fraction", internal_fit_fraction)
    p = protocol(data, manifest, max_sessions_per_split, seed, fit_fraction=internal_fit_fraction)
    gap, deepest = manifest["session_gap_minutes"], max(category_depth, behavioral_depth)
    depths = {c: category_depth if c == "category" else behavioral_depth for c in COMPONENTS}
    end = p.end
    states = written(rankings.states_at(data.properties, "categoryid", {"inner": end, "whole": manifest["train_end_ms"]}))
    if models is None:
        inner = _inner(sessions.session_queries(sessions.later_part(p.laid, end, "ranker_train"), "ranker_train", gap, max_internal_ranker_sessions, seed + 10))
        inner_sources = _inner_sources(p, data, inner.queries, gap, deepest, half_life_days, k, states)
        counted = _counted(inner, inner_sources, depths, rrf_offset, max_nonrelevant_per_query)
        fitted = learning.fits(counted.withColumnRenamed("task", "model"), EVENT_TYPES)
    else:
        inner, fitted = None, {t: (m, 0, 0) for t, m in models.items()}
    s = fusion.fit_sources(p.train, data.properties, None, manifest["train_end_ms"], gap, deepest, half_life_days, p.asked.queries, k, _category(states, "whole"), p.pairs)
    rows, held = gathered_rows(p, s, depths, k)
    fixed = {"category_only": ["category"], rrf_name: list(COMPONENTS)}
    name = "learned_task_specific"
    by = ["split", "variant", "task"]
    short = None if category_depth >= behavioral_depth else category_depth
    orders = {v: fusion.fused_order(parts, rrf_offset, short) for v, parts in fixed.items()} | {name: learning.learned_order([(F.col("task") == t, m) for t, (m, _, _) in fitted.items()])}
    sums = written(metrics.place_sums(metrics.positive_places(held, list(orders.values()), rrf_offset, k), len(orders)))  # a row for each query and task
    cells = nested(metrics.averaged(metrics.place_scores(sums, list(orders), k), by), by, [SPLITS, [*fixed, name], EVENT_TYPES])
    recalls = sums.withColumn("recall", F.col("found") / F.col("positives"))
    union = fusion.union_of(COMPONENTS)
    means = decisions.mean_ndcg(cells["validation"])
    best = decisions.best_of(means, list(fixed))
    return _head(manifest, source, p, seed, k=k, category_depth=category_depth, behavioral_depth=behavioral_depth, parent_depth=0, rrf_offset=rrf_offset) | {
        "internal_fit_fraction": internal_fit_fraction, "internal_fit_end_ms": end, "internal_ranker_sessions": inner.queries.count() if inner else 0,
        "training_examples": {t: n for t, (_, n, _) in fitted.items()}, "training_positive_examples": {t: n for t, (_, _, n) in fitted.items()},
        "feature_names": list(fusion.FEATURES), "standardized_coefficients": {t: m.named() for t, (m, _, _) in fitted.items()},
        "candidate_recall": _recalls(recalls, None), "candidate_size": _sizes(metrics.row_size(rows, union, ["split"]), None),
        "metrics": cells, "validation_mean_ndcg": means, "best_deterministic_validation_baseline": best, "validation_retain_learned_ranker": decisions.retain_learned(cells["validation"], name, best),
        "retain_rule": "mean validation NDCG above the comparator's, and above it on two of three tasks", "notes": NOTES["rerank"],
    }


@releasing
def evaluate_learned(data: Dataset, manifest: dict[str, Any], source: str = "", k: int = 20, source_depth: int = 100, **parameters: Any) -> dict[str, Any]:
    """Logistic rankers with one depth for all sources, judged against category order alone."""
    require_at_least(k, "k", source_depth=source_depth)
    out = evaluate_reranker(data, manifest, source, k, source_depth, source_depth, rrf_name="equal_rrf", **parameters)
    for extra in ("category_depth", "behavioral_depth", "parent_depth", "candidate_size", "best_deterministic_validation_baseline"):
        del out[extra]
    return out | {"notes": NOTES["learned"], "source_depth": source_depth, "validation_retain_learned_ranker": decisions.retain_learned(out["metrics"]["validation"], "learned_task_specific", "category_only")}


def _variant_candidates(found: DataFrame, depths: dict[str, int]) -> DataFrame:
    """Candidates of each retrieval variant, from one look-up at the expanded depth."""
    reached = []
    for name, (category, behavioral, parent) in RETRIEVALS.items():
        limit = {"category": depths[category], "parent": depths[parent] if parent else 0} | {c: depths[behavioral] for c in COMPONENTS[1:]}
        bound = reduce(lambda a, c: F.when(F.col("source") == c[0], c[1]) if a is None else a.when(F.col("source") == c[0], c[1]), limit.items(), None)
        reached.append(F.when(F.col("rank") <= bound, F.lit(name)))
    return found.withColumn("variant", F.explode(F.array_compact(F.array(*reached))))


@releasing
def evaluate_retrieval(data: Dataset, manifest: dict[str, Any], source: str = "", k: int = 20, base_depth: int = 100, expanded_depth: int = 300, half_life_days: float = 7.0, max_sessions_per_split: int | None = 50_000, seed: int = 365) -> dict[str, Any]:
    """Candidate recall, size and fused ranking of five retrieval variants; whether validation retains the largest."""
    require_positive(k=k)
    require_at_least(k, "k", base_depth=base_depth)
    if expanded_depth <= base_depth:
        raise ValueError("expanded_depth must be greater than base_depth")
    p = protocol(data, manifest, max_sessions_per_split, seed)
    s = fusion.fit_sources(p.train, data.properties, data.tree, manifest["train_end_ms"], manifest["session_gap_minutes"], expanded_depth, half_life_days, p.asked.queries, k, pairs=p.pairs)
    order = ("category", "parent", *COMPONENTS[1:])
    found = fusion.looked_up(p.asked.queries, s, order, expanded_depth)
    varied = keep(_variant_candidates(found, {"base": base_depth, "expanded": expanded_depth}))
    names = list(RETRIEVALS)
    asked = p.asked.queries.select("*", F.explode(F.array(*[F.lit(v) for v in names])).alias("variant"))
    ranked = fusion.completed(fusion.fused(varied, order, expanded_depth, 60.0, k, ["variant"]), asked, s.fallback, k, ["variant"])
    recall = _recalls(metrics.candidate_recall(varied, p.asked.positives, names), names)
    by = ["split", "variant", "task"]
    return _head(manifest, source, p, seed, k=k, base_depth=base_depth, expanded_depth=expanded_depth) | {
        "variants": {n: f"category to {c}, behavior to {b}, parent list {'to ' + q if q else 'absent'}" for n, (c, b, q) in RETRIEVALS.items()},
        "candidate_recall": recall, "candidate_size": _sizes(metrics.candidate_size(varied, p.asked.queries, ["split", "variant"], names), names),
        "ranking_metrics": nested(metrics.averaged(metrics.query_metrics(ranked, p.asked.positives, names, k), by), by, [SPLITS, names, EVENT_TYPES]),
        "validation_mean_candidate_recall": {v: decisions.mean(list(recall["validation"][v].values())) for v in names},
        "validation_retain_expanded_union": decisions.retain_retrieval(recall["validation"], "base_union", "expanded_union"), "retain_rule": "mean validation candidate recall 0.03 above the base union's, and no task below it", "notes": NOTES["retrieval"],
    }


@releasing
def evaluate_efficiency(
    data: Dataset, manifest: dict[str, Any], source: str = "", category_depths: Sequence[int] = (100, 200, 300), behavioral_depths: Sequence[int] = (100, 300), parent_depths: Sequence[int] = (0, 100, 300), retention_threshold: float = 0.95,
    half_life_days: float = 7.0, max_sessions_per_split: int | None = 50_000, seed: int = 365,
) -> dict[str, Any]:
    """Candidate recall and size of all budgets in one pass, the frontier, and the smallest budget that keeps the threshold."""
    require_share("retention_threshold", retention_threshold, closed=True)
    for name, depths, least in (("category_depths", category_depths, 1), ("behavioral_depths", behavioral_depths, 1), ("parent_depths", parent_depths, 0)):
        if not depths or min(depths) < least:
            raise ValueError(f"{name} must be {'positive' if least else 'non-negative'}")
    budgets = fusion.budget_grid(category_depths, behavioral_depths, parent_depths)
    reference = fusion.Budget(max(category_depths), max(behavioral_depths), max(parent_depths)).key
    p = protocol(data, manifest, max_sessions_per_split, seed)
    deepest = max(*category_depths, *behavioral_depths, *parent_depths)
    s = fusion.fit_sources(p.train, data.properties, data.tree, manifest["train_end_ms"], manifest["session_gap_minutes"], deepest, half_life_days, p.asked.queries, 1, pairs=p.pairs)
    found = fusion.looked_up(p.asked.queries, s, (*COMPONENTS, "parent"), {"category": max(category_depths), "parent": max(parent_depths)} | {c: max(behavioral_depths) for c in COMPONENTS[1:]})
    hits = keep(fusion.budget_hits(found, p.asked.positives, budgets).withColumnRenamed("budget", "variant"))
    names = [b.key for b in budgets]
    recall = _recalls(hits.where("task is not null").withColumn("recall", F.col("found") / F.col("positives")), names)
    sizes = p.asked.queries.select("split", "query_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("variant")).join(hits.where("task is null").select("split", "query_id", "variant", "found"), ["split", "query_id", "variant"], "left")
    n = F.coalesce("found", F.lit(0))
    size = _sizes(sizes.groupBy("split", "variant").agg(F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.95)).alias("p95")), names)
    means = {sp: {v: decisions.mean(list(recall[sp][v].values())) for v in names} for sp in SPLITS}
    by_size = {v: size["validation"][v]["mean"] for v in names}
    points = hits.where("split = 'validation' and task is not null").groupBy(F.col("variant").alias("budget"), "task").agg(F.avg(F.col("found") / F.col("positives")).alias("recall"))
    measured = data.events.sparkSession.createDataFrame([(v, float(n)) for v, n in by_size.items()], "budget string, size double")
    chosen = decisions.efficient_choice(points.join(F.broadcast(measured), "budget"), reference, retention_threshold).first()
    chosen = chosen["budget"] if chosen else reference
    return _head(manifest, source, p, seed) | {
        "retention_threshold": retention_threshold, "budgets": {b.key: {"category_depth": b.category, "behavioral_depth": b.behavioral, "parent_depth": b.parent} for b in budgets},
        "candidate_recall": recall, "candidate_size": size, "mean_candidate_recall": means, "validation_pareto_frontier": decisions.pareto_frontier(means["validation"], by_size), "expanded_reference": reference,
        "selected_efficient_configuration": chosen, "selection_rule": "smallest mean candidate set that keeps the threshold's share of the reference's recall on each validation task",
        "selected_validation_retention": decisions.retention(recall["validation"], chosen, reference), "selected_test_retention": decisions.retention(recall["test"], chosen, reference), "notes": NOTES["efficiency"],
    }


@releasing
def evaluate_stages(
    data: Dataset, manifest: dict[str, Any], source: str = "", k: int = 20, category_depth: int = 300, behavioral_depth: int = 100, parent_depth: int = 0, rrf_offset: float = 60.0, half_life_days: float = 7.0, internal_fit_fraction: float = 0.80,
    max_internal_ranker_sessions: int | None = 20_000, max_sessions_per_split: int | None = 50_000, max_nonrelevant_per_query: int = 50, seed: int = 365,
    models: dict[str, learning.Model] | None = None, stage_models: dict[tuple[str, str], learning.Model] | None = None,
) -> dict[str, Any]:
    """Rankers by stage and task against rankers by task pooled over stages and category order.

    With ``models`` by task and ``stage_models`` by stage and task nothing is fitted.
    """
    require_positive(k=k)
    require_at_least(k, "k", category_depth=category_depth, behavioral_depth=behavioral_depth)
    if parent_depth:
        raise ValueError("parent_depth must be 0")
    require_share("internal_fit_fraction", internal_fit_fraction)
    p = protocol(data, manifest, max_sessions_per_split, seed, stages=True, fit_fraction=internal_fit_fraction)
    gap, deepest = manifest["session_gap_minutes"], max(category_depth, behavioral_depth)
    depths = {c: category_depth if c == "category" else behavioral_depth for c in COMPONENTS}
    tasks_of = sessions.STAGE_TASKS
    end = p.end
    states = written(rankings.states_at(data.properties, "categoryid", {"inner": end, "whole": manifest["train_end_ms"]}))
    if models is None or stage_models is None:
        inner = _inner(sessions.stage_queries(sessions.later_part(p.laid, end, "ranker_train"), "ranker_train", gap, max_internal_ranker_sessions, seed + 10))
        inner_sources = _inner_sources(p, data, inner.queries, gap, deepest, half_life_days, k, states)
        counted = written(_counted(inner, inner_sources, depths, rrf_offset, max_nonrelevant_per_query))
        cell = F.concat_ws("/", "stage", "task")
        every = counted.withColumn("model", cell).unionByName(counted.withColumn("model", F.col("task"))).drop("stage", "task")
        found = learning.fits(every, [*[f"{st}/{t}" for st, ts in tasks_of.items() for t in ts], *EVENT_TYPES])
        staged, pooled = {(st, t): found[f"{st}/{t}"] for st, ts in tasks_of.items() for t in ts}, {t: found[t][0] for t in EVENT_TYPES}
    else:
        inner, staged, pooled = None, {c: (m, 0, 0) for c, m in stage_models.items()}, models
    s = fusion.fit_sources(p.train, data.properties, None, manifest["train_end_ms"], gap, deepest, half_life_days, p.asked.queries, k, _category(states, "whole"), p.pairs)
    rows, held = gathered_rows(p, s, depths, k)
    names = ("category_only", "pooled_task_specific", "stage_conditioned")
    # a cell is a stage and task
    models_of = {names[1]: lambda st, t: pooled[t], names[2]: lambda st, t: staged[st, t][0]}
    orders = {names[0]: fusion.fused_order(["category"], rrf_offset)} | {v: learning.learned_order([((F.col("stage") == st) & (F.col("task") == t), of(st, t)) for st, ts in tasks_of.items() for t in ts]) for v, of in models_of.items()}
    sums = written(metrics.place_sums(metrics.positive_places(held, list(orders.values()), rrf_offset, k), len(orders)))  # a row for each query and task
    by = ["split", "variant", "stage", "task"]
    flat = {tuple(r[c] for c in by): r for r in metrics.averaged(metrics.place_scores(sums, list(orders), k), by).collect()}
    cells = {sp: {v: {st: {t: _cell(flat.get((sp, v, st, t))) for t in ts} for st, ts in tasks_of.items()} for v in names} for sp in SPLITS}
    union = fusion.union_of(COMPONENTS)
    recall = {tuple(r): r["recall"] for r in sums.groupBy("split", "stage", "task").agg(F.avg(F.col("found") / F.col("positives")).alias("recall")).collect()}
    recall = {k_[:3]: v for k_, v in recall.items()}
    sizes = {(r["split"], r["stage"]): float(r["mean"]) for r in metrics.row_size(rows, union, ["split", "stage"]).collect()}
    counts = {(r["split"], r["stage"]): r["count"] for r in p.asked.queries.groupBy("split", "stage").count().collect()}
    ndcg = {v: {(st, t): cells["validation"][v][st][t]["ndcg_at_k"] for st, ts in tasks_of.items() for t in ts} for v in names}
    means = {v: decisions.mean(list(c.values())) for v, c in ndcg.items()}
    best = decisions.best_of(means, names[:2])
    return {
        "source": source, "manifest": manifest.get("source", ""), "k": k, "category_depth": category_depth, "behavioral_depth": behavioral_depth, "parent_depth": 0, "internal_fit_fraction": internal_fit_fraction, "internal_fit_end_ms": end,
        "internal_ranker_sessions": inner.queries.count() if inner else 0, "prediction_points": STAGE_POINTS,
        "stage_tasks": {st: list(ts) for st, ts in tasks_of.items()}, "training_examples": {st: {t: staged[st, t][1] for t in ts} for st, ts in tasks_of.items()}, "training_positive_examples": {st: {t: staged[st, t][2] for t in ts} for st, ts in tasks_of.items()},
        "validation_queries": {st: counts.get(("validation", st), 0) for st in tasks_of}, "test_queries": {st: counts.get(("test", st), 0) for st in tasks_of},
        "candidate_recall": {sp: {st: {t: recall.get((sp, st, t), math.nan) for t in ts} for st, ts in tasks_of.items()} for sp in SPLITS}, "candidate_size": {sp: {st: sizes.get((sp, st), 0.0) for st in tasks_of} for sp in SPLITS},
        "metrics": cells, "validation_mean_ndcg": means, "best_validation_comparator": best, "validation_retain_stage_conditioning": decisions.retain_stages(ndcg, "stage_conditioned", best),
        "retain_rule": "mean validation NDCG over stages and tasks above the comparator's, and above it in half of the cells", "notes": NOTES["stage"],
    }
