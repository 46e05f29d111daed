"""Queries: prediction points inside sessions, with the items that follow as positives.

queries: split, query_id, [stage,] visitorid, timestamp, last_item. positives: split, query_id, [stage,] task, itemid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import EVENT_TYPES
from ..functions.ranks import numbered
from .temporal import draw, keyed, sessionize

STAGE_TASKS = {"view_stage": ("view", "addtocart", "transaction"), "cart_stage": ("transaction",)}


@dataclass(frozen=True)
class Queries:
    """The two tables, and how many sessions could have been asked before sampling."""

    queries: DataFrame
    positives: DataFrame
    eligible: int

    def union(self, other: Queries) -> Queries:
        return Queries(self.queries.unionByName(other.queries), self.positives.unionByName(other.positives), self.eligible + other.eligible)


def laid_out(events: DataFrame, gap_minutes: float, later_than: int | None = None, stages: bool = False) -> DataFrame:
    """Events with their session: session_index and session_id in the visitor's split, place in it, events (its size) and next_item.

    One layout by visitor serves all that asks for sessions: queries of every split, positives, and pairs of items that follow each other. With ``later_than``, a time, it has what
    later_part() and earlier_pairs() need besides: next_at, the time of the next event, and early, how many of the session's events are not later. ``stages`` adds what stage_queries() asks of a session.
    """
    sessions = sessionize(events.select("visitorid", "timestamp", "event", "itemid", "split", "row_id"), gap_minutes, by=["visitorid", "split"]).drop("split_boundary_break", "split_boundary_forced_break")
    whole = Window.partitionBy("visitorid", "split", "session_index")
    order = whole.orderBy("timestamp", "row_id")
    laid = sessions.withColumns({"place": F.row_number().over(order) - 1, "next_item": F.lead("itemid").over(order), "events": F.count("*").over(whole)})
    if later_than is not None:
        laid = laid.withColumns({"next_at": F.lead("timestamp").over(order), "early": F.count_if(F.col("timestamp") <= later_than).over(whole)})
    return _marked(laid) if stages else laid


def _marked(laid: DataFrame) -> DataFrame:
    """Laid out events with their session's cart, the place of its first add-to-cart, and opens, the event it begins with; late_cart and late_opens are those of its part that is not early."""
    whole = Window.partitionBy("visitorid", "split", "session_index")
    at = F.when(F.col("event") == "addtocart", F.col("place"))
    marks = {"cart": F.min(at).over(whole), "opens": F.max(F.when(F.col("place") == 0, F.col("event"))).over(whole)}
    if "early" in laid.columns:
        marks |= {"late_cart": F.min(F.when(F.col("place") >= F.col("early"), at)).over(whole), "late_opens": F.max(F.when(F.col("place") == F.col("early"), F.col("event"))).over(whole)}
    return laid.withColumns(marks)


def later_part(laid: DataFrame, later_than: int, split: str) -> DataFrame:
    """The training events after a time, laid out as they would be by themselves under a split's name, from a layout that was made for that time.

    A time cuts a session in two where nothing else does, so a later part keeps its order and loses its early events alone. Numbers of sessions go on from those before.
    """
    late = laid.where((F.col("split") == "train") & (F.col("timestamp") > later_than))
    marks = {"cart": F.col("late_cart") - F.col("early"), "opens": F.col("late_opens")} if "late_cart" in laid.columns else {}
    return late.withColumns({"split": F.lit(split), "place": F.col("place") - F.col("early"), "events": F.col("events") - F.col("early")} | marks)


def earlier_pairs(laid: DataFrame, later_than: int) -> DataFrame:
    """following_pairs() of the training events up to a time, from a layout that was made for that time."""
    return following_pairs(laid.where((F.col("split") == "train") & (F.col("next_at") <= later_than)))


def following_pairs(laid: DataFrame) -> DataFrame:
    """source, target of events that follow each other in a session."""
    return laid.where("itemid is not null and next_item is not null").select(F.col("itemid").alias("source"), F.col("next_item").alias("target"))


def _of_split(events: DataFrame, split: str, gap_minutes: float) -> DataFrame:
    """The split's events, laid out unless they are."""
    own = events.where(F.col("split") == split)
    return own if "next_item" in events.columns else laid_out(own, gap_minutes)


def _sampled(rows: DataFrame, max_sessions: int | None, seed: int, how: str) -> tuple[DataFrame, int]:
    """Rows of multi-event sessions; of a drawn sample of those if there are more.

    ``numpy`` draws places in the order of visitor and session by NumPy's generator, which passes the places through the driver;
    ``keyed`` takes the sessions with the smallest keyed numbers, whoever computes them.
    """
    long = rows.where("events >= 2")
    heads = long.where("place = 0").select("visitorid", "session_index")
    total = heads.count()
    if not max_sessions or total <= max_sessions:
        return long, total
    if how == "keyed":
        chosen = heads.orderBy(keyed(seed, F.col("visitorid").cast("string"), F.col("session_index").cast("string")), "visitorid", "session_index").limit(max_sessions)
    else:
        at = rows.sparkSession.createDataFrame([(p,) for p in draw(total, max_sessions, seed)], "position long")
        chosen = numbered(heads, [F.col("visitorid"), F.col("session_index")]).join(F.broadcast(at), "position", "left_semi")
    return long.join(chosen.select("visitorid", "session_index"), ["visitorid", "session_index"], "left_semi"), total


def _query_columns() -> list[Column]:
    return [F.col("split"), F.col("session_id").alias("query_id")]


def asked(rows: DataFrame, eligible: int) -> Queries:
    """Queries and positives of laid out rows of multi-event sessions, of one split or more."""
    queries = rows.where("place = 0").select(*_query_columns(), "visitorid", "timestamp", F.col("itemid").alias("last_item"))
    later = rows.where((F.col("place") > 0) & F.col("event").isin(*EVENT_TYPES) & F.col("itemid").isNotNull())
    # dealt out by query, so that what gathers a query's positives needs no further exchange
    return Queries(queries, later.select(*_query_columns(), F.col("event").alias("task"), "itemid").repartition("split", "query_id").distinct(), eligible)


def session_queries(events: DataFrame, split: str, gap_minutes: float = 30, max_sessions: int | None = None, seed: int = 365, how: str = "numpy") -> Queries:
    """One query for each session of at least two events: the first is the context, items of later ones are positives by event type.

    ``events`` may be laid out already; ``how`` is the draw of a sample, see _sampled.
    """
    return asked(*_sampled(_of_split(events, split, gap_minutes), max_sessions, seed, how))


def stage_queries(events: DataFrame, split: str, gap_minutes: float = 30, max_sessions: int | None = None, seed: int = 365, how: str = "numpy") -> Queries:
    """view_stage queries where a session begins with a view; cart_stage queries after the first add-to-cart that is not a session's last event.

    A cart_stage query has later transactions as positives; it may have none.
    """
    return staged(*_sampled(_of_split(events, split, gap_minutes), max_sessions, seed, how))


def staged(rows: DataFrame, eligible: int) -> Queries:
    """stage_queries() of laid out rows of multi-event sessions, of one split or more."""
    marked = rows if "cart" in rows.columns else _marked(rows)
    view = F.lit("view_stage").alias("stage")
    cart = F.lit("cart_stage").alias("stage")
    at = ["visitorid", "timestamp", F.col("itemid").alias("last_item")]
    has_cart = F.col("cart") < F.col("events") - 1
    queries = marked.where("place = 0 and event = 'view'").select(*_query_columns(), view, *at).unionByName(marked.where((F.col("place") == F.col("cart")) & has_cart).select(*_query_columns(), cart, *at))
    known = marked.where(F.col("event").isin(*EVENT_TYPES) & F.col("itemid").isNotNull())
    label = [F.col("event").alias("task"), "itemid"]
    after_view = known.where("place > 0 and opens = 'view'").select(*_query_columns(), view, *label)
    after_cart = known.where((F.col("place") > F.col("cart")) & has_cart & (F.col("event") == "transaction")).select(*_query_columns(), cart, *label)
    return Queries(queries, after_view.unionByName(after_cart).repartition("split", "query_id", "stage").distinct(), eligible)
