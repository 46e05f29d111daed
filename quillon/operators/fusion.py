"""Candidates: lists of sources looked up for each query, unions, reciprocal-rank fusion, completion, feature tables.

A candidate table is long: the query's keys, source, itemid, rank.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import require_at_least
from ..functions.ranks import cut, first_n
from . import rankings

#: Sources in the order in which their shares are added up; the parent list, where there is one, comes second.
COMPONENTS = ("category", "covisitation", "recency", "visitor_history")
FEATURES = tuple(f"{c}_{kind}" for kind in ("rr", "present") for c in COMPONENTS)


@dataclass(frozen=True)
class Sources:
    """Lists fitted on one training period, to a depth, and the fallback list."""

    items: DataFrame
    categories: DataFrame
    category: DataFrame
    covisitation: DataFrame
    transition: DataFrame
    recency: DataFrame
    visitor_history: DataFrame
    parent: DataFrame | None
    fallback: DataFrame


def fit_sources(train: DataFrame, properties: DataFrame, tree: DataFrame | None, cutoff_ms: int, gap_minutes: float, depth: int, half_life_days: float, queries: DataFrame, fallback_depth: int, categories: DataFrame | None = None, pairs: DataFrame | None = None) -> Sources:
    """All lists of a training period; look-up tables are kept for the visitors and contexts of the queries alone.

    ``categories`` (itemid, category) stands for those of the properties at the cutoff, ``pairs`` (source, target) for those of the period's sessions, where they are known.
    """
    categories = rankings.latest_category(properties, cutoff_ms) if categories is None else categories
    items = cut(rankings.item_statistics(train, half_life_days))  # a row for each item, read by every list of counts
    category = rankings.category_lists(items, categories, depth)
    pairs = rankings.adjacent_pairs(train, gap_minutes) if pairs is None else pairs
    contexts = queries.select(F.col("last_item").alias("itemid")).distinct()
    return Sources(
        items, categories, category, rankings.neighbors(pairs, depth, symmetric=True, sources=contexts), rankings.neighbors(pairs, depth, sources=contexts), rankings.listed(items, None, depth),
        rankings.visitor_history(train, depth, queries.select("visitorid")), rankings.sibling_items(tree, category, depth) if tree is not None else None, rankings.listed(items, "view", fallback_depth),
    )


def keys_of(queries: DataFrame) -> list[str]:
    return [c for c in ("split", "query_id", "stage") if c in queries.columns]


def looked_up(queries: DataFrame, sources: Sources, names: Sequence[str], depths: dict[str, int] | int) -> DataFrame:
    """Candidates of each query from the named sources, each to its depth; a query whose key a source lacks has none from it."""
    keys = keys_of(queries)
    contexts = queries.select(*keys, "visitorid", "last_item")
    placed = contexts.join(sources.categories.withColumnRenamed("itemid", "last_item"), "last_item")
    parts = []
    for name in names:
        depth = depths if isinstance(depths, int) else depths[name]
        if name in ("category", "parent"):
            lists = sources.category if name == "category" else sources.parent
            found = placed.join(lists.where(F.col("rank") <= depth), "category")
        elif name in ("covisitation", "transition"):
            found = contexts.join(getattr(sources, name).where(F.col("rank") <= depth).withColumnRenamed("source", "last_item"), "last_item")
        elif name == "visitor_history":
            found = contexts.join(sources.visitor_history.where(F.col("rank") <= depth), "visitorid")
        else:
            found = contexts.crossJoin(F.broadcast(sources.recency.where(F.col("rank") <= depth)))  # one list of ``depth`` items for all
        parts.append(found.select(*keys, F.lit(name).alias("source"), "itemid", "rank"))
    return reduce(DataFrame.unionByName, parts)


def _in_order(lists: DataFrame, key: str | None, depth: int, name: str) -> DataFrame:
    """A row for each key: l_<name>, its items to the depth in the order of their ranks, which count from 1 without gaps."""
    kept = lists.where(F.col("rank") <= depth)
    items = F.transform(F.sort_array(F.collect_list(F.struct("rank", "itemid"))), lambda x: x["itemid"]).alias(f"l_{name}")
    return kept.groupBy(key).agg(items) if key else kept.agg(items)


def gathered(queries: DataFrame, sources: Sources, names: Sequence[str], depths: dict[str, int] | int, k: int) -> DataFrame:
    """keys and, for each named source, l_<source>: the items that looked_up() has as rows, in their order; null where a source lacks the query's key. l_ are the first k of the fallback list.

    A query stays one row: lists are laid down once for a key, and what follows needs neither rows nor an exchange for each candidate. A row is no longer than the depths together.
    """
    deep = {n: depths if isinstance(depths, int) else depths[n] for n in names}
    contexts = queries.select("last_item").where("last_item is not null").distinct()
    if "category" in deep:
        placed = contexts.join(sources.categories.withColumnRenamed("itemid", "last_item"), "last_item", "left")
        contexts = placed.join(_in_order(sources.category, "category", deep["category"], "category"), "category", "left").drop("category")
    for name in ("covisitation", "transition"):
        if name in deep:
            contexts = contexts.join(_in_order(getattr(sources, name).withColumnRenamed("source", "last_item"), "last_item", deep[name], name), "last_item", "left")
    found = queries.select(*keys_of(queries), "visitorid", "last_item").join(contexts, "last_item", "left")
    if "visitor_history" in deep:
        found = found.join(_in_order(sources.visitor_history, "visitorid", deep["visitor_history"], "visitor_history"), "visitorid", "left")
    if "recency" in deep:
        found = found.crossJoin(F.broadcast(_in_order(sources.recency, None, deep["recency"], "recency")))  # one row
    found = found.crossJoin(F.broadcast(_in_order(sources.fallback, None, k, "")))  # one row
    return found.select(*keys_of(queries), *[f"l_{n}" for n in names], "l_")


def _position(items: Column, item: Column) -> Column:
    """The item's place in an array from 1, or null; an item may be null."""
    return F.nullif(F.when(item.isNull(), F.array_position(F.transform(items, lambda x: x.isNull()), True)).otherwise(F.array_position(items, item)), F.lit(0))


def union_of(names: Sequence[str]) -> Column:
    """Of a row of gathered(): the different items of the named lists, in an array."""
    return F.array_distinct(F.concat(*[F.coalesce(F.col(f"l_{n}"), F.array().cast("array<bigint>")) for n in names]))


#: The rank of one item by source, null where that lacks it; "" is the fallback list.
Ranks = Callable[[str], Column]


@dataclass(frozen=True)
class Order:
    """A ranking of a query's candidates: which are present, and by what these are placed, told by their ranks and shares (see share_of); the rest of the fallback list follows in its order. Ties go by item. ``asked``: the positives' rows that it is for. ``model``: what a positive's row holds for it, which places are told too."""

    present: Callable[[Ranks], Column]
    places: Callable[[Ranks, Ranks, Column | None], Sequence[Column]]
    asked: Column | None = None
    model: Column | None = None


def null_places(names: Sequence[str]) -> list[Column]:
    """Of a row of gathered(): n_<source>, where a null item stands in each named list. Made once for a query, these leave position_columns() without functions that keep a plan from being compiled whole."""
    return [F.nullif(F.array_position(F.transform(f"l_{n}", lambda x: x.isNull()), True), F.lit(0)).alias(f"n_{n}") for n in names]


def position_columns(names: Sequence[str], item: str, prefix: str) -> list[Column]:
    """Of a row of gathered() with null_places(): the ranks of an item in the named lists, as <prefix>_<source>."""
    return [F.when(F.col(item).isNull(), F.col(f"n_{n}")).otherwise(F.nullif(F.array_position(f"l_{n}", F.col(item)), F.lit(0))).alias(f"{prefix}_{n}") for n in names]


def share_of(rank: Column, offset: float) -> Column:
    """What a rank adds to a fused score; nothing where there is none."""
    return F.coalesce(1.0 / (F.lit(float(offset)) + rank), F.lit(0.0))


def fused_order(parts: Sequence[str], offset: float, depth: int | None = None) -> Order:
    """The order of fused_items(); ``depth`` shortens all sources."""
    rank = lambda of, n: of(n) if depth is None else F.when(of(n) <= depth, of(n))
    own = lambda of, share, n: share(n) if depth is None else F.when(of(n) <= depth, share(n)).otherwise(0.0)

    def places(of: Ranks, share: Ranks, _: Column | None) -> list[Column]:
        best = F.least(*[rank(of, n) for n in parts]) if len(parts) > 1 else rank(of, parts[0])
        return [-reduce(lambda a, b: a + b, [own(of, share, n) for n in parts]), best]

    return Order(lambda of: reduce(Column.__or__, [rank(of, n).isNotNull() for n in parts]), places)


def items_of(names: Sequence[str], offset: float, depth: int | None = None, fallback: bool = True) -> Column:
    """Of a row of gathered(): each item once, as structs of itemid, its rank r_<source> and share s_<source> by source, and r_, that of the fallback list. ``depth`` shortens all sources."""
    require_at_least(0, "0", rrf_offset=offset)
    lists = {n: F.col(f"l_{n}") if depth is None or not n else F.slice(f"l_{n}", 1, depth) for n in (*names, *([""] if fallback else []))}
    every = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in lists.values()]))
    ranks = F.transform(every, lambda i: F.struct(i.alias("itemid"), *[_position(c, i).alias(f"r_{n}") for n, c in lists.items()]))
    share = lambda r: F.coalesce(1.0 / (F.lit(float(offset)) + r), F.lit(0.0))
    return F.transform(ranks, lambda x: F.struct(x["itemid"].alias("itemid"), *[x[f"r_{n}"].alias(f"r_{n}") for n in lists], *[share(x[f"r_{n}"]).alias(f"s_{n}") for n in names]))


def best_items(items: Column, places: Callable[[Column], Sequence[Column]], present: Callable[[Column], Column], k: int) -> Column:
    """The first k items of items_of() that are present or in the fallback list: those present by ``places``, the rest by the fallback list; ties go by item."""
    late = lambda x: ~present(x)
    order = lambda x: F.struct(late(x).alias("late"), *[F.when(present(x), c).alias(f"o{i}") for i, c in enumerate(places(x))], F.when(late(x), x["r_"]).alias("rest"), x["itemid"].alias("itemid"))
    return F.transform(F.slice(F.sort_array(F.transform(F.filter(items, lambda x: present(x) | x["r_"].isNotNull()), order)), 1, k), lambda x: x["itemid"])


def any_of(names: Sequence[str]) -> Callable[[Column], Column]:
    """Whether an item of items_of() is in any of the sources."""
    return lambda x: reduce(Column.__or__, [x[f"r_{n}"].isNotNull() for n in names])


def fused_items(items: Column, parts: Sequence[str], k: int) -> Column:
    """The first k items of completed_variants() for one set of components."""

    def places(x: Column) -> list[Column]:
        best = F.least(*[x[f"r_{c}"] for c in parts]) if len(parts) > 1 else x[f"r_{parts[0]}"]
        return [-reduce(lambda a, b: a + b, [x[f"s_{c}"] for c in parts]), best]

    return best_items(items, places, any_of(parts), k)


def candidate_sets(candidates: DataFrame) -> DataFrame:
    """The union of sources: each item of a query once."""
    return candidates.drop("source", "rank").distinct()


def completed(ranked: DataFrame, queries: DataFrame, fallback: DataFrame, k: int, labels: Sequence[str] = ()) -> DataFrame:
    """Rankings (itemid, rank) filled up to k with the fallback list, without repeats.

    At most as many fallback items repeat as a ranking has, so its first k suffice. ``labels`` are further keys of a ranking;
    ``queries`` has a row for each ranking asked for.
    """
    keys = [*keys_of(queries), *labels]
    first = ranked.where(F.col("rank") <= k).select(*keys, "itemid", F.lit(0).alias("tier"), "rank")
    rest = queries.select(*keys).crossJoin(F.broadcast(fallback.where(F.col("rank") <= k).select("itemid", F.lit(1).alias("tier"), "rank")))
    each = first.unionByName(rest).groupBy(*keys, "itemid").agg(F.min(F.struct("tier", "rank")).alias("at"))
    return first_n(each, keys, [F.asc("at.tier"), F.asc("at.rank"), F.asc("itemid")], k).drop("at")


def _fusion(name: str, parts: Sequence[str], offset: float) -> Column:
    """variant, score and best rank of an item with a rank r_<source> for each source."""
    shares = [F.coalesce(1.0 / (F.lit(float(offset)) + F.col(f"r_{c}")), F.lit(0.0)) for c in parts]
    best = F.least(*[F.col(f"r_{c}") for c in parts]) if len(parts) > 1 else F.col(f"r_{parts[0]}")
    return F.struct(F.lit(name).alias("variant"), reduce(lambda x, y: x + y, shares).alias("score"), best.alias("best"))


def fused_variants(candidates: DataFrame, variants: dict[str, Sequence[str]], depth: int, offset: float, k: int, labels: Sequence[str] = ()) -> DataFrame:
    """Reciprocal-rank fusion by several sets of components in one pass: variant, itemid, score, rank.

    An item's score is the sum of 1 / (offset + rank) over the variant's components, added in their order; ties go by best rank, then item.
    """
    require_at_least(k, "k", source_depth=depth)
    require_at_least(0, "0", rrf_offset=offset)
    keys = [*[c for c in ("split", "query_id", "stage") if c in candidates.columns], *labels]
    every = list(dict.fromkeys(c for parts in variants.values() for c in parts))
    kept = candidates.where(F.col("source").isin(*every) & (F.col("rank") <= depth))
    ranks = kept.groupBy(*keys, "itemid").agg(*[F.min(F.when(F.col("source") == c, F.col("rank"))).alias(f"r_{c}") for c in every])
    each = ranks.select(*keys, "itemid", F.explode(F.array(*[_fusion(n, p, offset) for n, p in variants.items()])).alias("at")).select(*keys, "itemid", "at.*")
    return first_n(each.where("best is not null"), [*keys, "variant"], [F.desc("score"), F.asc("best"), F.asc("itemid")], k).drop("best")


def completed_variants(candidates: DataFrame, queries: DataFrame, fallback: DataFrame, variants: dict[str, Sequence[str]], depth: int, offset: float, k: int) -> DataFrame:
    """query keys, variant, itemid, rank: fused_variants() of each query, filled up to k by the fallback list as completed() does.

    Fallback items stand beside the candidates from the start, so one exchange by query serves the union of sources, all fusions and their completion. No query has more
    than the depths of its sources together.
    """
    require_at_least(k, "k", source_depth=depth)
    require_at_least(0, "0", rrf_offset=offset)
    keys = keys_of(queries)
    every = list(dict.fromkeys(c for parts in variants.values() for c in parts))
    kept = candidates.where(F.col("source").isin(*every) & (F.col("rank") <= depth)).select(*keys, "source", "itemid", "rank")
    filled = queries.select(*keys).crossJoin(F.broadcast(fallback.where(F.col("rank") <= k).select(F.lit("").alias("source"), "itemid", "rank")))  # k items
    together = kept.unionByName(filled).repartition(*keys)
    ranks = together.groupBy(*keys, "itemid").agg(*[F.min(F.when(F.col("source") == c, F.col("rank"))).alias(f"r_{c}") for c in ("", *every)])
    each = ranks.select(*keys, "itemid", "r_", F.explode(F.array(*[_fusion(n, p, offset) for n, p in variants.items()])).alias("at")).select(*keys, "itemid", "r_", "at.*")
    late = F.col("best").isNull()
    order = [late.asc(), F.desc("score"), F.asc("best"), F.when(late, F.col("r_")).asc(), F.asc("itemid")]
    return first_n(each.where("best is not null or r_ is not null"), [*keys, "variant"], order, k).select(*keys, "variant", "itemid", "rank")


def fused(candidates: DataFrame, components: Sequence[str], depth: int, offset: float, k: int, labels: Sequence[str] = ()) -> DataFrame:
    """Reciprocal-rank fusion by one set of components, see fused_variants."""
    renamed = {c: f"_{c}" for c in labels}
    one = fused_variants(candidates.withColumnsRenamed(renamed), {"": components}, depth, offset, k, list(renamed.values()))
    return one.drop("variant").withColumnsRenamed({v: c for c, v in renamed.items()})


def features(candidates: DataFrame, depths: dict[str, int], offset: float) -> DataFrame:
    """For each candidate its reciprocal ranks and presence flags by source; items beyond a source's depth are not its."""
    keys = [c for c in ("split", "query_id", "stage") if c in candidates.columns]
    rank = {c: F.min(F.when((F.col("source") == c) & (F.col("rank") <= depths[c]), F.col("rank"))) for c in COMPONENTS}
    wide = candidates.groupBy(*keys, "itemid").agg(*[rank[c].alias(f"r_{c}") for c in COMPONENTS])
    present = reduce(Column.__or__, [F.col(f"r_{c}").isNotNull() for c in COMPONENTS])
    rr = [F.coalesce(1.0 / (F.lit(float(offset)) + F.col(f"r_{c}")), F.lit(0.0)).alias(f"{c}_rr") for c in COMPONENTS]
    return wide.where(present).select(*keys, "itemid", *rr, *[F.col(f"r_{c}").isNotNull().cast("double").alias(f"{c}_present") for c in COMPONENTS])


@dataclass(frozen=True, order=True)
class Budget:
    """Depths of a retrieval configuration."""

    category: int
    behavioral: int
    parent: int

    @property
    def key(self) -> str:
        return f"c{self.category}_b{self.behavioral}_p{self.parent}"


def budget_grid(category: Sequence[int], behavioral: Sequence[int], parent: Sequence[int]) -> list[Budget]:
    """All combinations, smaller sums of depths first."""
    grid = [Budget(c, b, p) for c in category for b in behavioral for p in parent]
    return sorted(grid, key=lambda x: (x.category + x.behavioral + x.parent, x))


def budget_hits(candidates: DataFrame, positives: DataFrame, budgets: Sequence[Budget]) -> DataFrame:
    """Long table (query keys, budget, size, task, found, positives) of all budgets in one pass over candidates.

    Each candidate keeps its smallest rank by kind of source; whether a budget reaches it is then a comparison. task is null in the row with
    a query's size, as queries without positives have one too.
    """
    keys = [c for c in ("split", "query_id", "stage") if c in candidates.columns]
    behavioral = F.col("source").isin("covisitation", "recency", "visitor_history")
    kinds = {"c": F.col("source") == "category", "b": behavioral, "p": F.col("source") == "parent"}
    least = candidates.groupBy(*keys, "itemid").agg(*[F.min(F.when(on, F.col("rank"))).alias(n) for n, on in kinds.items()])
    inside = {x.key: (F.col("c") <= x.category) | (F.col("b") <= x.behavioral) | (F.col("p") <= x.parent) for x in budgets}
    hit = {n: F.coalesce(on, F.lit(False)).cast("int") for n, on in inside.items()}
    sizes = least.groupBy(*keys).agg(*[F.sum(on).alias(n) for n, on in hit.items()]).select("*", F.lit(None).cast("string").alias("task"), F.lit(None).cast("long").alias("positives"))
    found = positives.join(least.select(*keys, "itemid", *[on.alias(n) for n, on in hit.items()]), [*keys, "itemid"], "left")
    by_task = found.groupBy(*keys, "task").agg(F.count("*").alias("positives"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in hit])
    wide = sizes.unionByName(by_task)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("budget"), F.col(n).cast("long").alias("found")) for n in hit])).alias("at")
    return wide.select(*keys, "task", "positives", stacked).select(*keys, "task", "positives", "at.budget", "at.found")
