"""Ranked lists fitted on training events: long tables (key, itemid, rank), never arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import EVENT_TYPES, require_positive
from ..functions.ranks import first_n, numbered
from .temporal import DAY_MS, sessionize


def _appearance() -> Column:
    return F.min("row_id").alias("first_row")


def event_popularity(train: DataFrame, event: str, n: int | None = None) -> DataFrame:
    """itemid, score, rank: items by count of one event type, then by first appearance."""
    counts = train.where(F.col("event") == event).groupBy("itemid").agg(F.count("*").alias("score"), _appearance())
    return first_n(counts, [], [F.desc("score"), F.asc("first_row")], n).select("itemid", "score", "rank")


def _aged(train: DataFrame, half_life_days: float) -> tuple[DataFrame, Column]:
    """The events beside the time of the last one, and each one's weight: halved with every half-life of age then."""
    require_positive(half_life_days=half_life_days)
    last = train.agg(F.max("timestamp").alias("last"))
    return train.join(F.broadcast(last)), F.pow(F.lit(2.0), -(F.col("last") - F.col("timestamp")) / F.lit(half_life_days * DAY_MS))  # one row


def decayed_popularity(train: DataFrame, half_life_days: float = 7.0, n: int | None = None) -> DataFrame:
    """itemid, score, rank: items by events of all types, each halved with every half-life of age at the last event.

    Weights are compared to nine decimals, then by first appearance.
    """
    aged, weight = _aged(train, half_life_days)
    scored = aged.groupBy("itemid").agg(F.round(F.sum(weight), 9).alias("score"), _appearance())
    return first_n(scored, [], [F.desc("score"), F.asc("first_row")], n).select("itemid", "score", "rank")


def item_statistics(train: DataFrame, half_life_days: float) -> DataFrame:
    """A row for each item: events, weight (as decayed_popularity has it) and first_row; of each event type <type>_events and <type>_first.

    One scan and one exchange of the events; written once, it serves all lists that rest on counts of items.
    """
    aged, weight = _aged(train, half_life_days)
    own = [c for e in EVENT_TYPES for of in (F.col("event") == e,) for c in (F.count_if(of).alias(f"{e}_events"), F.min(F.when(of, F.col("row_id"))).alias(f"{e}_first"))]
    return aged.groupBy("itemid").agg(F.count("*").alias("events"), F.round(F.sum(weight), 9).alias("weight"), _appearance(), *own)


def listed(items: DataFrame, event: str | None, n: int) -> DataFrame:
    """itemid, score, rank from item_statistics(): the rows of event_popularity() for an event type, those of decayed_popularity() for none."""
    score, first = ("weight", "first_row") if event is None else (f"{event}_events", f"{event}_first")
    return first_n(items.where(F.col(score) > 0).select("itemid", F.col(score).alias("score"), F.col(first).alias("_first")), [], [F.desc("score"), F.asc("_first")], n).select("itemid", "score", "rank")


def adjacent_pairs(train: DataFrame, gap_minutes: float) -> DataFrame:
    """source, target of events that follow each other in a session, equal items among them."""
    sessions = sessionize(train.select("visitorid", "timestamp", "itemid", "row_id"), gap_minutes)
    following = F.lead("itemid").over(Window.partitionBy("visitorid", "session_index").orderBy("timestamp", "row_id"))
    return sessions.select(F.col("itemid").alias("source"), following.alias("target")).where(F.col("target").isNotNull() & F.col("source").isNotNull())


def neighbors(pairs: DataFrame, n: int, symmetric: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """source, itemid, score, rank: targets of each source by count, then item. Self-pairs don't count; ``symmetric`` counts both ways.

    ``sources`` (itemid) keeps those sources alone, after pairs have been turned round and counted: there are fewer counts than pairs.
    """
    kept = pairs.where(F.col("source") != F.col("target"))
    if symmetric:
        both = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
        kept = kept.select(F.inline(both))
    counts = kept.groupBy("source", F.col("target").alias("itemid")).agg(F.count("*").alias("score"))
    if sources is not None:
        counts = counts.join(sources.select(F.col("itemid").alias("source")).distinct(), "source", "left_semi")
    return first_n(counts, ["source"], [F.desc("score"), F.asc("itemid")], n)


def visitor_history(train: DataFrame, n: int, visitors: DataFrame | None = None) -> DataFrame:
    """visitorid, itemid, score, rank: a visitor's items by count, last time, item."""
    kept = train if visitors is None else train.join(visitors.select("visitorid").distinct(), "visitorid", "left_semi")
    counts = kept.groupBy("visitorid", "itemid").agg(F.count("*").alias("score"), F.max("timestamp").alias("last_ts"))
    return first_n(counts, ["visitorid"], [F.desc("score"), F.desc("last_ts"), F.asc("itemid")], n).drop("last_ts")


def history_counts(train: DataFrame) -> DataFrame:
    return train.groupBy("visitorid").agg(F.count("*").alias("history"))


def latest_category(properties: DataFrame, cutoff_ms: int) -> DataFrame:
    """itemid, category: the last category row of each item at or before the cutoff."""
    rows = properties.where((F.col("property") == "categoryid") & (F.col("timestamp") <= cutoff_ms))
    return rows.groupBy("itemid").agg(F.max_by("value", F.struct("timestamp", "row_id")).alias("category"))


def states_at(properties: DataFrame, name: str, cutoffs: Mapping[str, int]) -> DataFrame:
    """itemid and a column for each cutoff: the last value of one property at or before it. All cutoffs are met in one scan by one conditional aggregate."""
    order = F.struct("timestamp", "row_id")
    last = [F.max_by("value", F.when(F.col("timestamp") <= at, order)).alias(column) for column, at in cutoffs.items()]
    return properties.where((F.col("property") == name) & (F.col("timestamp") <= max(cutoffs.values()))).groupBy("itemid").agg(*last)


def state_intervals(properties: DataFrame, name: str) -> DataFrame:
    """itemid, value, valid_from, valid_to of one property; a state holds from its time until before the next one's, the last without an end.

    Of rows of equal times the last counts. A state at any time t is the row with valid_from <= t < valid_to.
    """
    known = properties.where((F.col("property") == name) & F.col("itemid").isNotNull())
    states = known.groupBy("itemid", "timestamp").agg(F.max_by("value", "row_id").alias("value"))
    until = F.lead("timestamp").over(Window.partitionBy("itemid").orderBy("timestamp"))
    return states.select("itemid", "value", F.col("timestamp").alias("valid_from"), until.alias("valid_to"))


def category_popularity(train: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    """category, itemid, score, rank: items of each category by events of all types, then item."""
    return category_lists(train.groupBy("itemid").agg(F.count("*").alias("events")), categories, n)


def category_lists(items: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    """category_popularity() from events by item, see item_statistics."""
    counts = items.select("itemid", F.col("events").alias("score")).join(categories.where("category is not null"), "itemid")
    return first_n(counts.select("category", "itemid", "score"), ["category"], [F.desc("score"), F.asc("itemid")], n)


def _category_key(column: str) -> Column:
    """A category's key: numbers without leading zeros or fractions, other text as it is."""
    number = F.expr(f"try_cast({column} as decimal(38,6))")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("string")).otherwise(F.col(column))


def normalized_tree(tree: DataFrame) -> DataFrame:
    """Keys of categories and parents; a column _row is kept."""
    return tree.select(_category_key("categoryid").alias("categoryid"), _category_key("parentid").alias("parentid"), *[c for c in tree.columns if c == "_row"]).where("categoryid is not null")


def sibling_items(tree: DataFrame, popular: DataFrame, n: int) -> DataFrame:
    """category, itemid, rank: items of all categories under the same parent (its own too), one from each in turn, up to n.

    Categories take turns in the order of their numbers; a repeated item counts at its first turn.
    The list depends on the parent alone: it is made once for each parent, and its children look it up. Of rows that repeat a category the
    last with a parent names its parent; it counts as a child of all of them.
    """
    known = normalized_tree(tree.withColumn("_row", F.col("row_id") if "row_id" in tree.columns else F.lit(0))).where("parentid is not null")
    turn = F.row_number().over(Window.partitionBy("parentid").orderBy(F.expr("try_cast(categoryid as decimal(38,0))").asc_nulls_last(), "categoryid"))
    turns = known.select("parentid", "categoryid").distinct().withColumn("turn", turn)
    lists = popular.where(F.col("rank") <= n).select(F.col("category").alias("categoryid"), "itemid", "rank")
    first = turns.join(lists, "categoryid").groupBy("parentid", "itemid").agg(F.min(F.struct("rank", "turn")).alias("at"))
    merged = first_n(first, ["parentid"], [F.asc("at.rank"), F.asc("at.turn")], n).select("parentid", "itemid", "rank")
    parents = known.groupBy(F.col("categoryid").alias("category")).agg(F.max_by("parentid", F.struct("_row", "parentid")).alias("parentid"))
    return parents.join(merged, "parentid").select("category", "itemid", "rank")


def item_cohorts(train: DataFrame) -> DataFrame:
    """itemid, cohort: head, mid_tail or long_tail by the share of items that are more popular (ties: earlier ones)."""
    counts = train.groupBy("itemid").agg(F.count("*").alias("score"), _appearance())
    placed = numbered(counts, [F.desc("score"), F.asc("first_row")])
    share = F.col("position") / F.col("items")
    cohort = F.when(share < 0.10, "head").when(share < 0.50, "mid_tail").otherwise("long_tail")
    return placed.join(F.broadcast(counts.agg(F.count("*").alias("items")))).select("itemid", cohort.alias("cohort"))


def visitor_cohort(history: Column) -> Column:
    n = F.coalesce(history, F.lit(0))
    return F.when(n == 0, "new").when(n < 5, "sparse").otherwise("repeat")
