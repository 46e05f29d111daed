"""Audits: the four tables, the category tree, and observed funnel paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import EVENT_TYPES, EVENTS, PROPERTIES, TREE, require_table
from ..functions.ranks import drop_path, new_path
from .rankings import normalized_tree


def _n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def file_profile(df: DataFrame, name: str) -> dict[str, Any]:
    names = [c for c in df.columns if c != "row_id"]
    row = df.agg(F.count("*").alias("_rows"), *[_n(F.col(c).isNull(), c) for c in names]).first()
    return {"name": name, "row_count": row["_rows"], "columns": names, "null_counts": {c: row[c] for c in names}}


def event_profile(events: DataFrame) -> dict[str, Any]:
    """Counts of an event table; exact duplicates are rows beyond the first of equal ones."""
    require_table(events, EVENTS, "events.csv")
    has_id = F.col("transactionid").isNotNull()
    counted = events.agg(
        F.count("*").alias("row_count"), F.count_distinct("visitorid").alias("unique_visitors"), F.count_distinct("itemid").alias("unique_items"), F.min("timestamp").alias("timestamp_min_ms"), F.max("timestamp").alias("timestamp_max_ms"),
        _n(F.col("event") == "transaction", "transaction_rows"), _n((F.col("event") == "transaction") & has_id, "transaction_rows_with_id"), _n((F.col("event") != "transaction") & has_id, "nontransaction_rows_with_transaction_id"),
    ).first()
    kinds = {r["event"]: r["count"] for r in events.where("event is not null").groupBy("event").count().collect()}
    groups = events.select(EVENTS.fieldNames()).groupBy(*EVENTS.fieldNames()).count().agg(F.sum(F.col("count") - 1)).first()[0] or 0
    return counted.asDict() | {"event_counts": dict(sorted(kinds.items())), "unexpected_event_count": sum(n for k, n in kinds.items() if k not in EVENT_TYPES), "exact_duplicate_rows": groups}


def property_profile(properties: DataFrame) -> dict[str, Any]:
    require_table(properties, PROPERTIES, "item_properties")
    items = properties.groupBy("itemid").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), *[F.count_if(F.col("property") == p).alias(p) for p in ("categoryid", "available")])
    known = F.col("itemid").isNotNull()
    per_item = items.agg(
        F.sum("n").alias("row_count"), _n(known, "unique_items"), F.min("a").alias("timestamp_min_ms"), F.max("b").alias("timestamp_max_ms"), _n(known & (F.col("a") != F.col("b")), "items_with_multiple_property_timestamps"),
        F.sum("categoryid").alias("category_property_rows"), _n(known & (F.col("categoryid") > 0), "category_property_unique_items"), F.sum("available").alias("available_property_rows"), _n(known & (F.col("available") > 0), "available_property_unique_items"),
    ).first()
    out = {k: v or 0 if "timestamp_m" not in k else v for k, v in per_item.asDict().items()}
    return out | {"unique_properties": properties.agg(F.count_distinct("property")).first()[0]}


def has_cycle(tree: DataFrame) -> bool:
    """Whether some category is its own ancestor, by pointer doubling. Of rows that repeat a category the last counts.

    After k rounds a category points to its ancestor at distance 2^k, and those that have none are gone. Once that is further than there are
    categories, whoever is left goes round. Each round is one join of a written table with itself, and replaces it.
    """
    spark = tree.sparkSession
    row = F.col("row_id") if "row_id" in tree.columns else F.monotonically_increasing_id()
    pointers = normalized_tree(tree.withColumn("_row", row).groupBy("categoryid").agg(F.max_by("parentid", "_row").alias("parentid"))).where("parentid is not null")
    path = new_path(spark, "ancestors")
    pointers.select(F.col("categoryid").alias("node"), F.col("parentid").alias("up")).write.parquet(path)
    read = lambda: spark.read.schema("node string, up string").parquet(path)
    left = total = read().count()
    distance = 1
    try:
        while left and distance <= total:
            if not read().where("node = up").isEmpty():
                return True
            further = new_path(spark, "ancestors")
            read().join(read().select(F.col("node").alias("up"), F.col("up").alias("further")), "up").select("node", F.col("further").alias("up")).write.parquet(further)
            drop_path(spark, path)
            path, distance = further, 2 * distance
            left = read().count()
        return left > 0
    finally:
        drop_path(spark, path)


def tree_profile(tree: DataFrame) -> dict[str, Any]:
    require_table(tree, TREE, "category_tree.csv")
    known = normalized_tree(tree)
    categories = known.select(F.col("categoryid").alias("parentid")).distinct()
    counts = known.agg(F.count_distinct("categoryid").alias("unique_categories"), _n(F.col("parentid").isNull(), "root_categories"), _n(F.col("categoryid") == F.col("parentid"), "self_parent_rows")).first().asDict()
    missing = known.where("parentid is not null").select("parentid").distinct().join(categories, "parentid", "left_anti").count()
    return {"row_count": tree.count()} | counts | {"missing_parent_references": missing, "has_cycle": has_cycle(tree)}


def coverage(events: DataFrame, properties: DataFrame) -> dict[str, Any]:
    """How many of the event table's items have any property, a category, an availability."""
    items = events.where("itemid is not null").select("itemid").distinct()
    marks = properties.groupBy("itemid").agg(F.lit(True).alias("any"), *[(F.count_if(F.col("property") == p) > 0).alias(p) for p in ("categoryid", "available")])
    row = items.join(marks, "itemid", "left").agg(F.count("*").alias("items"), *[F.count_if(F.col(c)).alias(c) for c in ("any", "categoryid", "available")]).first()
    part = lambda n: n / row["items"] if row["items"] else 0.0
    return {
        "event_items_with_any_property": row["any"], "event_item_property_coverage": part(row["any"]), "event_items_with_category_property": row["categoryid"], "event_item_category_coverage": part(row["categoryid"]),
        "event_items_with_available_property": row["available"], "event_item_available_coverage": part(row["available"]),
    }


PATTERNS = ("view", "addtocart", "view+addtocart", "transaction", "view+transaction", "addtocart+transaction", "view+addtocart+transaction")


def pair_milestones(events: DataFrame) -> DataFrame:
    """visitorid, itemid and the first time of each event type; rows without visitor, item or event have no pair."""
    known = events.dropna(subset=["visitorid", "itemid", "event"])
    return known.groupBy("visitorid", "itemid").agg(*[F.min(F.when(F.col("event") == e, F.col("timestamp"))).alias(f"first_{e}") for e in EVENT_TYPES])


def pair_patterns(pairs: DataFrame) -> DataFrame:
    """pattern, pairs: which event types a pair has; other where it has none of the known ones."""
    code = sum((F.col(f"first_{e}").isNotNull().cast("int") * (1 << i) for i, e in enumerate(EVENT_TYPES)), F.lit(0))
    name = F.get(F.array(*[F.lit(x) for x in ("other", *PATTERNS)]), code)
    return pairs.groupBy(name.alias("pattern")).agg(F.count("*").alias("pairs"))


def funnel_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs with a cart or a transaction, and with what stood before it (at the same time counts as before)."""
    view, cart, bought = (F.col(f"first_{e}") for e in EVENT_TYPES)
    return pairs.agg(
        F.count("*").alias("unique_visitor_item_pairs"), _n(cart.isNotNull(), "cart_pairs"), _n(view <= cart, "cart_pairs_with_prior_view"), _n(bought.isNotNull(), "transaction_pairs"), _n(view <= bought, "transaction_pairs_with_prior_view"),
        _n(cart <= bought, "transaction_pairs_with_prior_cart"), _n((view <= bought) & (cart <= bought), "transaction_pairs_with_prior_view_and_cart"), _n((view <= cart) & (cart <= bought), "transaction_pairs_with_ordered_view_cart"),
    )


def observation_audit(events: DataFrame, source: str) -> dict[str, Any]:
    from ..sources.tables import deduplicated

    require_table(events, EVENTS, "events.csv")
    raw = events.count()
    once = deduplicated(events)
    left = once.count()
    pairs = pair_milestones(once).persist()
    try:
        patterns = {r["pattern"]: r["pairs"] for r in pair_patterns(pairs).collect()}
        return {"source": source, "raw_rows": raw, "exact_duplicate_rows": raw - left, "deduplicated_rows": left, "pair_pattern_counts": dict(sorted(patterns.items()))} | funnel_counts(pairs).first().asDict()
    finally:
        pairs.unpersist()


def dataset_audit(events: DataFrame, properties: DataFrame, tree: DataFrame, source: str, files: list[dict[str, Any]] | None = None) -> dict[str, Any]:
    """All profiles of a dataset; ``files`` are those of the files that the tables were read from, else the tables stand for them."""
    return {
        "source_dir": source,
        "files": files or [file_profile(events, "events.csv"), file_profile(properties, "item_properties"), file_profile(tree, "category_tree.csv")],
        "events": event_profile(events),
        "properties": property_profile(properties),
        "category_tree": tree_profile(tree),
        "coverage": coverage(events, properties),
    }
