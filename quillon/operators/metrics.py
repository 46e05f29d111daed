"""Recall, NDCG, candidate recall and size, by split, variant, task and cohort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion


def _ideal(n: Column, k: int) -> Column:
    """Gain of the best ranking with n positives."""
    totals, total = [], 0.0
    for i in range(k):
        total += 1 / math.log2(i + 2)
        totals.append(total)
    return F.get(F.array(*[F.lit(t) for t in totals]), F.least(n, F.lit(k)).cast("int") - 1)


def _met(ranked: DataFrame, positives: DataFrame, variants: Sequence[str], label: Sequence[str]) -> DataFrame:
    """query keys, label, variant, rank: each positive by each variant, with its rank there or null.

    Rankings and positives are dealt out by query once, beside each other, and meet by grouping: all that follows is by query too and needs no further exchange.
    """
    keys = _keys(positives)
    on = [*keys, "itemid", *(["task"] if "task" in ranked.columns else [])]
    sides = ranked.select(*on, "variant", "rank", F.lit(None).cast(positives.select(F.struct(*label)).schema[0].dataType).alias("_wanted"))
    wanted = positives.select(*on, F.lit(None).cast("string").alias("variant"), F.lit(None).cast("long").alias("rank"), F.struct(*label).alias("_wanted"))
    ranks = [F.min(F.when(F.col("variant") == v, F.col("rank"))).alias(f"_r{i}") for i, v in enumerate(variants)]
    items = sides.unionByName(wanted).repartition(*keys).groupBy(*on).agg(*ranks, F.collect_list("_wanted").alias("_wanted"))
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_r{i}").alias("rank")) for i, v in enumerate(variants)])
    asked = items.where(F.size("_wanted") > 0).select(*keys, F.explode("_wanted").alias("_wanted"), each.alias("_each"))
    return asked.select(*keys, "_wanted.*", F.inline("_each"))


def _keys(table: DataFrame) -> list[str]:
    return [c for c in ("split", "query_id", "stage") if c in table.columns]


def _sums() -> tuple[Column, Column, Column]:
    """Of rows of _met(): positives, hits, and the gain of these."""
    return F.count("*").alias("positives"), F.count("rank").alias("hits"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("gain")


def _scores(k: int) -> tuple[Column, Column]:
    return (F.col("hits") / F.col("positives")).alias("recall"), (F.col("gain") / _ideal(F.col("positives"), k)).alias("ndcg")


def query_metrics(ranked: DataFrame, positives: DataFrame, variants: Sequence[str], k: int) -> DataFrame:
    """Recall and NDCG at k of each query, variant and task with a positive.

    ``ranked`` has the query's keys, variant, itemid and rank, and task where a ranking is for one task; ``positives`` may have a cohort.
    """
    keys, label = _keys(positives), ["task", *(["cohort"] if "cohort" in positives.columns else [])]
    met = _met(ranked.where(F.col("rank") <= k), positives, variants, label)
    return met.groupBy(*keys, *label, "variant").agg(*_sums()).select(*keys, *label, "variant", *_scores(k))


def wanted_of(positives: DataFrame) -> DataFrame:
    """query keys and wanted: the array of a query's positives (task, itemid), for those that have any."""
    return positives.groupBy(*_keys(positives)).agg(F.collect_list(F.struct("task", "itemid")).alias("wanted"))


def place_of(items: Column) -> Column:
    """The rank of a positive's itemid in a ranked array of items, or null."""
    return F.nullif(F.array_position(items, F.col("itemid")), F.lit(0))


def row_metrics(rows: DataFrame, ranks: dict[str, Column], k: int) -> DataFrame:
    """query_metrics() where each query is a row that has its rankings in arrays, cut at k, and wanted: ``ranks`` are by variant the rank of a positive's task and itemid in that row."""
    keys = _keys(rows)
    names = [f"_p{i}" for i in range(len(ranks))]
    told = rows.select("*", F.inline("wanted")).select(*keys, "task", *[c.alias(n) for n, c in zip(names, ranks.values(), strict=True)])
    return place_scores(place_sums(told, len(ranks)), list(ranks), k)


def place_sums(told: DataFrame, n: int) -> DataFrame:
    """query keys, task, positives, and for the i-th of n variants _p<i>h and _p<i>g, its hits and gain: from a row for each positive with its ranks _p<i>. found counts positives that are ``_hit``, where these say so."""
    sums = [c for p in (f"_p{i}" for i in range(n)) for c in (F.count(p).alias(f"{p}h"), F.coalesce(F.sum(1 / F.log2(F.col(p) + 1)), F.lit(0.0)).alias(f"{p}g"))]
    return told.groupBy(*_keys(told), "task").agg(F.count("*").alias("positives"), *([F.count_if("_hit").alias("found")] if "_hit" in told.columns else []), *sums)


def place_scores(sums: DataFrame, variants: Sequence[str], k: int) -> DataFrame:
    """query_metrics() of place_sums()."""
    keys = _keys(sums)
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_p{i}h").alias("hits"), F.col(f"_p{i}g").alias("gain")) for i, v in enumerate(variants)])
    return sums.select(*keys, "task", "positives", F.inline(each)).select(*keys, "task", "variant", *_scores(k))


def _with_places(rows: DataFrame, orders: Sequence[fusion.Order], offset: float, item: str, prefix: str) -> DataFrame:
    """Rows with an item's ranks, shares and places in each order, as <prefix>_<source>, <prefix>s_<source> and <prefix><i>_<j>. Each stands on columns made before it, which keeps the compiled code short."""
    of, share = (lambda n: F.col(f"{prefix}_{n}")), (lambda n: F.col(f"{prefix}s_{n}"))
    ranked = rows.select("*", *fusion.position_columns((*fusion.COMPONENTS, ""), item, prefix))
    shared = ranked.select("*", *[fusion.share_of(of(n), offset).alias(f"{prefix}s_{n}") for n in fusion.COMPONENTS])
    return shared.select("*", *[c.alias(f"{prefix}{i}_{j}") for i, o in enumerate(orders) for j, c in enumerate(o.places(of, share, None if o.model is None else F.col(f"_m{i}")))])


def positive_places(rows: DataFrame, orders: Sequence[fusion.Order], offset: float, k: int) -> DataFrame:
    """query keys, task, itemid, _hit, _p<i>: each positive of rows of fusion.gathered() with wanted, whether any source has it, and its rank, if that is at most k, in each order.

    A rank is one more than the candidates that come before, so nothing is sorted: where a positive is a candidate the query's other candidates become rows beside it and are counted,
    in compiled code. A query's candidates are no more than the depths of its lists together.
    """
    keys, names = _keys(rows), (*fusion.COMPONENTS, "")
    lists = [f"{c}_{n}" for c in "ln" for n in names]
    own, other = (lambda n: F.col(f"p_{n}")), (lambda n: F.col(f"q_{n}"))
    known = rows.select(*keys, "wanted", *[f"l_{n}" for n in names], *fusion.null_places(names))
    held = [f"_m{i}" for i, o in enumerate(orders) if o.model is not None]
    asked = known.select(*keys, *lists, F.inline("wanted")).select("*", *[orders[int(m[2:])].model.alias(m) for m in held])
    wanted = _with_places(asked, orders, offset, "itemid", "p")
    # tier 0: present, 1: in the fallback list alone, null: not ranked
    tier = [F.when(o.present(own), 0).when(own("").isNotNull(), 1) for o in orders]
    tiers = [(t if o.asked is None else F.when(o.asked, t)).alias(f"_t{i}") for i, (o, t) in enumerate(zip(orders, tier, strict=True))]
    sized = [c for c in wanted.columns if c[0] == "p" and c[1].isdigit()]
    hit = reduce(Column.__or__, [own(n).isNotNull() for n in fusion.COMPONENTS]).alias("_hit")
    # the others beside it; the filter also ends the code that is compiled as one: the JVM leaves methods of over 8,000 bytes interpreted
    others = F.when(F.col("_hit") | F.col("p_").isNotNull(), F.filter(fusion.union_of(names), lambda i: ~i.eqNullSafe(F.col("itemid"))))
    beside = wanted.select(*keys, "task", "itemid", *lists, *held, "p_", hit, *tiers, *sized).select("*", F.explode_outer(others).alias("_item"))
    placed = _with_places(beside, orders, offset, "_item", "q")

    def before(i: int, o: fusion.Order) -> Column:
        earlier = F.col("_item").isNull() | (F.col("_item") < F.col("itemid"))
        for own_place in reversed([c for c in sized if c.startswith(f"p{i}_")]):
            c = F.col(f"q{own_place[1:]}")
            earlier = (c < F.col(own_place)) | ((c == F.col(own_place)) & earlier)
        late = F.coalesce(F.col("q_") < F.col("p_"), F.lit(False))
        return F.when(F.col(f"_t{i}") == 0, o.present(other) & earlier).when(F.col(f"_t{i}") == 1, o.present(other) | late).cast("int")

    told = placed.select(*keys, "task", "itemid", "_hit", *[before(i, o).alias(f"_b{i}") for i, o in enumerate(orders)])
    counted = told.groupBy(*keys, "task", "itemid").agg(F.max("_hit").alias("_hit"), *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(orders))])
    return counted.select(*keys, "task", "itemid", "_hit", *[F.when(F.col(f"_b{i}") < k, F.col(f"_b{i}") + 1).alias(f"_p{i}") for i in range(len(orders))])


def row_recall(rows: DataFrame, items: Column) -> DataFrame:
    """candidate_recall() where each query is a row that has its candidates in an array, and wanted."""
    keys = _keys(rows)
    told = rows.select(*keys, items.alias("_items"), F.inline("wanted")).select(*keys, "task", place_of(F.col("_items")).alias("place"))
    return told.groupBy(*keys, "task").agg(F.count("place").alias("found"), F.count("*").alias("positives")).select(*keys, "task", "positives", "found", (F.col("found") / F.col("positives")).alias("recall"))


def row_size(rows: DataFrame, items: Column, by: Sequence[str]) -> DataFrame:
    """candidate_size() where each query is a row that has its candidates in an array."""
    sizes = rows.select(*by, F.size(items).alias("n"))
    return sizes.groupBy(*by).agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"))


def cohort_metrics(ranked: DataFrame, positives: DataFrame, visitors: DataFrame, variants: Sequence[str], k: int) -> DataFrame:
    """split, scope, cohort, variant, task, queries, recall, ndcg: overall, by cohort of the visitor and by cohort of the positive items, from one scoring of all rankings.

    ``positives`` have the cohort of their item; ``visitors`` (query keys, cohort) has a row for each query. Hits are counted once, by query and item cohort; grouping sets
    give them whole as well, and a query without a cohort's positives has no part in it. scope is overall (cohort null), visitor or item.
    """
    keys = _keys(positives)
    by = [*keys, "task", "variant", "cohort"]
    found = _met(ranked.where(F.col("rank") <= k), positives, variants, ["task", "cohort"]).groupBy(*by).agg(*_sums())
    sums = found.groupingSets([by, by[:-1]], *by).agg(F.grouping("cohort").alias("whole"), *[F.sum(c).alias(c) for c in ("positives", "hits", "gain")])
    scored = sums.select(*by, "whole", *_scores(k))
    told = scored.join(visitors.select(*keys, F.col("cohort").alias("visitor")), keys, "left")
    place = lambda scope, cohort: F.struct(F.lit(scope).alias("scope"), cohort.cast("string").alias("cohort"))
    places = F.when(F.col("whole") == 1, F.array(place("overall", F.lit(None)), place("visitor", F.col("visitor")))).otherwise(F.array(place("item", F.col("cohort"))))
    rows = told.select("split", "variant", "task", "recall", "ndcg", F.explode(places).alias("at")).select("*", "at.*").drop("at")
    return averaged(rows, ["split", "scope", "cohort", "variant", "task"])


def averaged(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))


def candidate_recall(candidates: DataFrame, positives: DataFrame, variants: Sequence[str] = ()) -> DataFrame:
    """query keys, task, [variant,] recall: the share of a query's positives among its candidates (query keys, itemid, [variant]), which may repeat.

    ``variants`` are those of the candidates, where these have any.
    """
    keys, names = _keys(positives), list(variants) or [""]
    by = [*keys, "task", *(["variant"] if variants else [])]
    known = candidates.select(*keys, "itemid", "variant" if variants else F.lit("").alias("variant"), F.lit(1).cast("long").alias("rank"))
    return _met(known, positives, names, ["task"]).groupBy(*by).agg(F.count("rank").alias("found"), F.count("*").alias("positives")).select(*by, "positives", "found", (F.col("found") / F.col("positives")).alias("recall"))


def candidate_size(candidates: DataFrame, queries: DataFrame, by: Sequence[str], variants: Sequence[str] = ()) -> DataFrame:
    """mean, median and 95th percentile of the number of different candidates; queries without any count as zero. ``variants`` as in candidate_recall."""
    keys, names = _keys(queries), list(variants) or [""]
    known = candidates.select(*keys, "itemid", "variant" if variants else F.lit("").alias("variant"))
    asked = queries.select(*keys, F.lit(None).cast(candidates.schema["itemid"].dataType).alias("itemid"), F.lit(None).cast("string").alias("variant"))
    inside = [F.count_if(F.col("variant") == v).cast("boolean").cast("int").alias(f"_n{i}") for i, v in enumerate(names)]
    items = known.unionByName(asked).repartition(*keys).groupBy(*keys, "itemid").agg(*inside, F.count_if(F.col("variant").isNull()).alias("_asked"))
    whole = items.groupBy(*keys).agg(F.sum("_asked").alias("_asked"), *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(names))]).where(F.col("_asked") > 0)
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_n{i}").alias("n")) for i, v in enumerate(names)]))
    sizes = whole.select(*keys, each)
    return sizes.groupBy(*by).agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"))
