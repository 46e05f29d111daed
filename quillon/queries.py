"""One query for each operator of the engine over the star-schema test tables, and DuckDB SQL with the same rows.

Rankings use a session gap of a day, so that all tasks have queries at every scale, and depths that are small against the
catalogue of a hundred items, so that lists end and fallback is reached. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.guards import EVENT_TYPES, TREE
from .functions.ranks import cut, first_n, nearest_index, new_path, values_at
from .operators import audit, fusion, learning, metrics, rankings, sessions, temporal
from .operators.fusion import COMPONENTS
from .plans import decisions, evaluations
from .sources.artifacts import HORIZON
from .sources.tables import EXPECTED_FILES, Dataset, deduplicated, read_csv, read_dataset, star_dataset

GAP, K, DEPTH, HALF_LIFE, OFFSET = 1440, 5, 8, 7.0, 60.0
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# DuckDB: the adapter, splits, sessions, queries and lists, each a table of a WITH clause.
_EV = """
ev AS (SELECT epoch_us(ts) // 1000 AS timestamp, user_id AS visitorid, CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS itemid, CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid, event_id AS row_id FROM events),
ordered AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp, row_id) AS rn, count(*) OVER () AS n FROM ev),
cut AS (SELECT max(CASE WHEN rn = ceil(n * 0.7) THEN timestamp END) AS train_end, max(CASE WHEN rn = ceil(n * 0.85) THEN timestamp END) AS validation_end FROM ordered),
sp AS (SELECT ev.*, CASE WHEN timestamp <= train_end THEN 'train' WHEN timestamp <= validation_end THEN 'validation' ELSE 'test' END AS split FROM ev, cut),
train AS (SELECT * FROM sp WHERE split = 'train'),
cats AS (SELECT p_partkey AS itemid, p_type || '/' || p_brand AS category FROM part),
tree AS (SELECT DISTINCT p_type || '/' || p_brand AS categoryid, p_type AS parentid FROM part UNION SELECT DISTINCT p_type, NULL FROM part)"""


def _sessions_sql(name: str, table: str, by: str, gap: int, split: bool) -> str:
    change = "ps IS NOT NULL AND ps <> split" if split else "false"
    return f""",
{name}_0 AS (SELECT *, lag(timestamp) OVER w AS pt, lag(split) OVER w AS ps FROM {table} WINDOW w AS (PARTITION BY {by} ORDER BY timestamp, row_id)),
{name}_1 AS (SELECT *, coalesce(timestamp - pt > {gap * 60000}, false) AS gap, coalesce({change}, false) AS change FROM {name}_0),
{name} AS (SELECT *, CAST(sum(CASE WHEN gap OR change THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY timestamp, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index FROM {name}_1)"""


_PLACED = (
    _EV
    + _sessions_sql("qs", "sp", "visitorid, split", GAP, False)
    + """,
placed AS (SELECT *, visitorid || ':' || session_index AS query_id, row_number() OVER (PARTITION BY split, visitorid, session_index ORDER BY timestamp, row_id) - 1 AS place, count(*) OVER (PARTITION BY split, visitorid, session_index) AS n FROM qs)"""
)
_Q = (
    _PLACED
    + """,
q AS (SELECT split, query_id, visitorid, timestamp, itemid AS last_item FROM placed WHERE place = 0 AND n >= 2 AND split <> 'train'),
pos AS (SELECT DISTINCT split, query_id, event AS task, itemid FROM placed WHERE place > 0 AND n >= 2 AND split <> 'train' AND event IN ('view', 'addtocart', 'transaction'))"""
)


def _popularity_sql(event: str) -> str:
    return f"SELECT itemid, count(*) AS score, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) AS rank FROM train WHERE event = '{event}' GROUP BY itemid"


_DECAY = f"SELECT itemid, score, row_number() OVER (ORDER BY score DESC, first_row) AS rank FROM (SELECT itemid, min(row_id) AS first_row, round(sum(pow(2.0, -((SELECT max(timestamp) FROM train) - timestamp) / {HALF_LIFE * 86400000})), 9) AS score FROM train GROUP BY itemid)"


def _lists_sql(depth: int) -> str:
    """All ranked lists of the training period to a depth."""
    top = f"WHERE rank <= {depth}"
    return (
        _sessions_sql("ts", "train", "visitorid", GAP, False)
        + f""",
adjacent AS (SELECT itemid AS source, lead(itemid) OVER (PARTITION BY visitorid, session_index ORDER BY timestamp, row_id) AS target FROM ts),
pairs AS (SELECT * FROM adjacent WHERE target IS NOT NULL AND source <> target),
both_ways AS (SELECT source, target FROM pairs UNION ALL SELECT target, source FROM pairs),
trans AS (SELECT * FROM (SELECT source, target AS itemid, count(*) AS score, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, target) AS rank FROM pairs GROUP BY 1, 2) {top}),
covis AS (SELECT * FROM (SELECT source, target AS itemid, count(*) AS score, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, target) AS rank FROM both_ways GROUP BY 1, 2) {top}),
hist AS (SELECT * FROM (SELECT visitorid, itemid, count(*) AS score, row_number() OVER (PARTITION BY visitorid ORDER BY count(*) DESC, max(timestamp) DESC, itemid) AS rank FROM train GROUP BY 1, 2) {top}),
catpop AS (SELECT * FROM (SELECT category, itemid, count(*) AS score, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, itemid) AS rank FROM train JOIN cats USING (itemid) GROUP BY 1, 2) {top}),
recency AS (SELECT * FROM ({_DECAY}) {top}),
fallback AS (SELECT * FROM ({_popularity_sql('view')}) WHERE rank <= {K}),
family AS (SELECT DISTINCT t.categoryid AS category, s.categoryid AS sibling FROM tree t JOIN tree s ON t.parentid = s.parentid),
turns AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sibling) AS turn FROM family),
parent AS (SELECT * FROM (SELECT category, itemid, row_number() OVER (PARTITION BY category ORDER BY r, turn) AS rank FROM (SELECT t.category, c.itemid, min(c.rank * 100000 + t.turn) AS rt, min(c.rank * 100000 + t.turn) // 100000 AS r, min(c.rank * 100000 + t.turn) % 100000 AS turn FROM turns t JOIN catpop c ON c.category = t.sibling GROUP BY 1, 2)) {top})"""
    )


_CAND = (
    _lists_sql(DEPTH)
    + """,
qc AS (SELECT q.*, category FROM q LEFT JOIN cats ON cats.itemid = q.last_item),
cand AS (
  SELECT split, query_id, 'category' AS source, c.itemid, c.rank FROM qc JOIN catpop c USING (category)
  UNION ALL SELECT split, query_id, 'covisitation', c.itemid, c.rank FROM q JOIN covis c ON c.source = last_item
  UNION ALL SELECT split, query_id, 'transition', c.itemid, c.rank FROM q JOIN trans c ON c.source = last_item
  UNION ALL SELECT split, query_id, 'recency', c.itemid, c.rank FROM q, recency c
  UNION ALL SELECT split, query_id, 'visitor_history', c.itemid, c.rank FROM q JOIN hist c USING (visitorid)
  UNION ALL SELECT split, query_id, 'parent', c.itemid, c.rank FROM qc JOIN parent c USING (category))"""
)


def _completed_sql(ranked: str, labels: str = "variant", asked: str = "asked") -> str:
    """Rankings filled up with the fallback: ``ranked`` names a table with split, query_id, labels, itemid, rank; asked has its keys."""
    keys = f"split, query_id, {labels}"
    return f"""SELECT * FROM (SELECT {keys}, itemid, row_number() OVER (PARTITION BY {keys} ORDER BY spot, itemid) AS rank FROM (SELECT {keys}, itemid, min(spot) AS spot FROM (
  SELECT {keys}, itemid, rank AS spot FROM {ranked} WHERE rank <= {K} UNION ALL SELECT {keys}, itemid, 1000000 + rank FROM {asked}, fallback) GROUP BY ALL)) WHERE rank <= {K}"""


def _rrf_sql(components: list[str]) -> str:
    shares = " + ".join(f"coalesce(1.0::DOUBLE / ({OFFSET}::DOUBLE + min(CASE WHEN source = '{c}' THEN rank END)), 0.0::DOUBLE)" for c in components)
    names = ", ".join(f"'{c}'" for c in components)
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY score DESC, best, itemid) AS rank FROM (SELECT split, query_id, itemid, {shares} AS score, min(rank) AS best FROM cand WHERE source IN ({names}) GROUP BY 1, 2, 3)) WHERE rank <= {K}"


def _metrics_sql(ranked: str, positives: str = "pos", extra: str = "", by_task: bool = False) -> str:
    """Recall and NDCG of each query with a positive; ``extra`` names a further key of the positives; ``by_task``: a ranking is for one task."""
    e = f", {extra}" if extra else ""
    pe = f", p.{extra}" if extra else ""
    gains = " ".join(f"WHEN {n} THEN {sum(1 / __import__('math').log2(i + 2) for i in range(n))!r}" for n in range(1, K + 1))
    return f"""SELECT split, query_id, task{e}, variant, coalesce(hits, 0) / positives AS recall, coalesce(gain, 0) / CASE least(positives, {K}) {gains} END AS ndcg
FROM (SELECT split, query_id, task{e}, count(*) AS positives FROM {positives} GROUP BY ALL) CROSS JOIN (SELECT DISTINCT variant FROM {ranked})
LEFT JOIN (SELECT p.split, p.query_id, p.task{pe}, r.variant, count(*) AS hits, sum(1 / log2(r.rank + 1)) AS gain FROM {positives} p JOIN {ranked} r ON r.split = p.split AND r.query_id = p.query_id AND r.itemid = p.itemid{' AND r.task = p.task' if by_task else ''} GROUP BY ALL)
USING (split, query_id, task{e}, variant)"""


_AVG = "CAST(count(*) AS BIGINT) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class _Base:
    """What most queries share: the dataset, its cutoffs, split events, the training part, queries and positives."""

    def __init__(self, spark: SparkSession, folder: str):
        found = star_dataset(spark, folder)
        # read by every list, by the queries and by manifests: laid down once, and read by the columns and times that are asked for
        self.events = cut(deduplicated(found.events))
        self.data: Dataset = replace(found, events=self.events, distinct=True)
        self.train_end, self.validation_end = temporal.temporal_cutoffs(self.events)
        self.split = temporal.with_split(self.events, self.train_end, self.validation_end)
        self.train = self.split.where(F.col("timestamp") <= self.train_end)

    @cached_property
    def laid(self) -> DataFrame:
        """Events by visitor with their sessions, written once for queries, positives and pairs."""
        return cut(sessions.laid_out(self.split, GAP))

    @cached_property
    def pairs(self) -> DataFrame:
        return sessions.following_pairs(self.laid.where("split = 'train'"))

    @cached_property
    def _asked(self) -> sessions.Queries:
        return sessions.asked(self.laid.where("split <> 'train' and events >= 2"), 0)

    def asked(self) -> sessions.Queries:
        return self._asked

    def sources(self, queries: DataFrame, depth: int = DEPTH) -> fusion.Sources:
        return fusion.fit_sources(self.train, self.data.properties, self.data.tree, self.train_end, GAP, depth, HALF_LIFE, queries, K, pairs=self.pairs)

    def manifest(self) -> dict:
        return temporal.build_manifest(self.events, "events", session_gap_minutes=GAP, distinct=True)

    def frozen(self) -> dict:
        """What evaluations read of manifest(): the cutoffs, which are known here, and its fixed values. Its counts are passes over the events that no report of a query has."""
        return {"source": "events", "train_end_ms": self.train_end, "validation_end_ms": self.validation_end, "session_gap_minutes": GAP, "prediction_horizon": HORIZON}


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _averaged(scored: DataFrame, by: list[str]) -> DataFrame:
    return _rounded(metrics.averaged(scored, by), "recall", "ndcg")


# -- tables, splits, sessions ------------------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT split, event, count(*) AS events FROM sp GROUP BY ALL")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Base(spark, sf_dir).split.groupBy("split", "event").agg(F.count("*").alias("events"))


@query(f"WITH {_EV} SELECT train_end, validation_end FROM cut")
def temporal_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return spark.createDataFrame([(b.train_end, b.validation_end)], "train_end long, validation_end long")


_SES = _EV + _sessions_sql("ses", "sp", "visitorid", 30, True)


@query(f"WITH {_SES} SELECT row_id, visitorid, timestamp, session_index, visitorid || ':' || session_index AS session_id, change AS split_boundary_break, change AND NOT gap AS split_boundary_forced_break FROM ses")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.sessionize(_Base(spark, sf_dir).split, 30, "split")
    return out.select("row_id", "visitorid", "timestamp", "session_index", "session_id", "split_boundary_break", "split_boundary_forced_break")


@query(
    f"WITH {_SES}, sizes AS (SELECT split, visitorid, session_index, count(*) AS n, sum(CASE WHEN change AND NOT gap THEN 1 ELSE 0 END) AS forced FROM ses GROUP BY ALL) "
    "SELECT split, count(*) AS sessions, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, CAST(sum(forced) AS BIGINT) AS forced, max(n) AS longest FROM sizes GROUP BY split"
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ses = temporal.sessionize(_Base(spark, sf_dir).split, 30, "split")
    sizes = ses.groupBy("split", "visitorid", "session_index").agg(F.count("*").alias("n"), F.count_if("split_boundary_forced_break").alias("forced"))
    return sizes.groupBy("split").agg(F.count("*").alias("sessions"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("forced").alias("forced"), F.max("n").alias("longest"))


_LEFT = "orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(
    "WITH bought AS (SELECT DISTINCT o_custkey AS visitorid, l_partkey AS itemid, epoch_us(o_orderdate) // 1000 AS timestamp FROM orders JOIN lineitem ON l_orderkey = o_orderkey), "
    "state AS (SELECT epoch_us(l_shipdate) // 1000 AS timestamp, l_partkey AS itemid, CASE WHEN max(l_linestatus) = 'O' THEN '1' ELSE '0' END AS value FROM lineitem GROUP BY 1, 2) "
    "SELECT b.visitorid, b.itemid, b.timestamp, s.timestamp AS timestamp_property, s.value FROM bought b ASOF LEFT JOIN state s ON b.itemid = s.itemid AND b.timestamp >= s.timestamp"
)
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    millis = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000").alias("timestamp")
    bought = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("visitorid"), F.col("l_partkey").alias("itemid"), millis).distinct()
    state = star_dataset(spark, sf_dir).properties.where("property = 'available'").drop("property")
    return temporal.point_in_time_join(bought, state)


#: Rows of a key beyond which the queries on hot keys deal it out: all of their keys have more.
_SEGMENT = 500


@query(
    "WITH state AS (SELECT l_returnflag AS flag, epoch_us(l_shipdate) // 1000 AS timestamp, min(l_linestatus) || count(*) AS value FROM lineitem WHERE l_quantity >= 50 GROUP BY 1, 2), "
    "received AS (SELECT l_orderkey, l_partkey, l_returnflag AS flag, epoch_us(l_shipdate) // 1000 AS timestamp FROM lineitem) "
    "SELECT r.l_orderkey, r.l_partkey, r.flag, r.timestamp, s.timestamp AS timestamp_property, s.value FROM received r ASOF LEFT JOIN state s ON r.flag = s.flag AND r.timestamp >= s.timestamp"
)
def asof_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their flag, three keys in all: each is dealt out over segments of time."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    millis = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div 1000").alias("timestamp")
    flag = F.col("l_returnflag").alias("flag")
    state = lines.where("l_quantity >= 50").groupBy(flag, millis("l_shipdate")).agg(F.concat(F.min("l_linestatus"), F.count("*").cast("string")).alias("value"))
    return temporal.point_in_time_join(lines.select("l_orderkey", "l_partkey", flag, millis("l_shipdate")), state, "flag", segment_rows=_SEGMENT)


_HOT = (
    _EV
    + ", hot AS (SELECT row_id, length(event) AS visitorid, timestamp, split FROM sp)"
    + _sessions_sql("ses", "hot", "visitorid", 1, True)
)


@query(f"WITH {_HOT} SELECT row_id, visitorid, session_index, visitorid || ':' || session_index AS session_id, change AS split_boundary_break, change AND NOT gap AS split_boundary_forced_break FROM ses")
def sessions_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a few visitors who have all events, dealt out over segments of time."""
    hot = _Base(spark, sf_dir).split.select("row_id", F.length("event").cast("long").alias("visitorid"), "timestamp", "split")
    return temporal.sessionize(hot, 1, "split", segment_rows=_SEGMENT).drop("timestamp", "split")


@query(f"WITH {_EV} SELECT itemid FROM ev, cut WHERE itemid IS NOT NULL GROUP BY itemid HAVING min(timestamp) <= (SELECT train_end FROM cut)")
def catalog_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return temporal.time_valid_items(temporal.first_seen(b.events), b.train_end)


# -- audits ------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_EV} SELECT count(*) AS row_count, count(DISTINCT visitorid) AS unique_visitors, count(DISTINCT itemid) AS unique_items, min(timestamp) AS timestamp_min_ms, max(timestamp) AS timestamp_max_ms, "
    "count(*) FILTER (event = 'transaction') AS transaction_rows, count(*) FILTER (event = 'transaction' AND transactionid IS NOT NULL) AS transaction_rows_with_id, "
    "count(*) FILTER (event <> 'transaction' AND transactionid IS NOT NULL) AS nontransaction_rows_with_transaction_id, count(*) FILTER (event NOT IN ('view', 'addtocart', 'transaction')) AS unexpected_event_count, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT timestamp, visitorid, event, itemid, transactionid FROM ev)) AS exact_duplicate_rows FROM ev"
)
def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.event_profile(star_dataset(spark, sf_dir).events)
    return spark.createDataFrame([{k: v for k, v in found.items() if k != "event_counts"}], ", ".join(f"{k} long" for k in found if k != "event_counts"))


_PAIRS = _EV + ", milestones AS (SELECT visitorid, itemid, min(CASE WHEN event = 'view' THEN timestamp END) AS v, min(CASE WHEN event = 'addtocart' THEN timestamp END) AS c, min(CASE WHEN event = 'transaction' THEN timestamp END) AS t FROM ev WHERE visitorid IS NOT NULL AND itemid IS NOT NULL GROUP BY 1, 2)"


@query(
    f"WITH {_PAIRS} SELECT coalesce(nullif(concat_ws('+', CASE WHEN v IS NOT NULL THEN 'view' END, CASE WHEN c IS NOT NULL THEN 'addtocart' END, CASE WHEN t IS NOT NULL THEN 'transaction' END), ''), 'other') AS pattern, count(*) AS pairs FROM milestones GROUP BY 1"
)
def funnel_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pair_patterns(audit.pair_milestones(_Base(spark, sf_dir).events))


@query(
    f"WITH {_PAIRS} SELECT count(*) AS unique_visitor_item_pairs, count(c) AS cart_pairs, count(*) FILTER (v <= c) AS cart_pairs_with_prior_view, count(t) AS transaction_pairs, count(*) FILTER (v <= t) AS transaction_pairs_with_prior_view, "
    "count(*) FILTER (c <= t) AS transaction_pairs_with_prior_cart, count(*) FILTER (v <= t AND c <= t) AS transaction_pairs_with_prior_view_and_cart, count(*) FILTER (v <= c AND c <= t) AS transaction_pairs_with_ordered_view_cart FROM milestones"
)
def funnel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.funnel_counts(audit.pair_milestones(_Base(spark, sf_dir).events))


_PROPS = "props AS (SELECT 0 AS timestamp, p_partkey AS itemid, 'categoryid' AS property FROM part UNION ALL SELECT DISTINCT epoch_us(l_shipdate) // 1000, l_partkey, 'available' FROM lineitem)"


@query(
    f"WITH {_PROPS}, items AS (SELECT itemid, count(*) AS n, min(timestamp) AS a, max(timestamp) AS b, count(*) FILTER (property = 'categoryid') AS c, count(*) FILTER (property = 'available') AS v FROM props GROUP BY 1) "
    "SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS unique_items, min(a) AS timestamp_min_ms, max(b) AS timestamp_max_ms, count(*) FILTER (a <> b) AS items_with_multiple_property_timestamps, CAST(sum(c) AS BIGINT) AS category_property_rows, "
    "count(*) FILTER (c > 0) AS category_property_unique_items, CAST(sum(v) AS BIGINT) AS available_property_rows, count(*) FILTER (v > 0) AS available_property_unique_items, (SELECT count(DISTINCT property) FROM props) AS unique_properties FROM items"
)
def property_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.property_profile(star_dataset(spark, sf_dir).properties)
    return spark.createDataFrame([found], ", ".join(f"{k} long" for k in found))


def _tree_sql(tree: str) -> str:
    """Profile of a tree: a cycle is a path of parents that is longer than there are categories. The walk is guarded by that length."""
    return f"""WITH RECURSIVE {tree}, up AS (SELECT categoryid AS start, parentid AS node, 1 AS depth FROM tree WHERE parentid IS NOT NULL
  UNION ALL SELECT up.start, tree.parentid, up.depth + 1 FROM up JOIN tree ON tree.categoryid = up.node WHERE tree.parentid IS NOT NULL AND up.depth <= (SELECT count(DISTINCT categoryid) FROM tree))
SELECT (SELECT count(*) FROM tree) AS row_count, (SELECT count(DISTINCT categoryid) FROM tree) AS unique_categories, (SELECT count(*) FROM tree WHERE parentid IS NULL) AS root_categories, (SELECT count(*) FROM tree WHERE parentid = categoryid) AS self_parent_rows,
  (SELECT count(DISTINCT parentid) FROM tree WHERE parentid NOT IN (SELECT categoryid FROM tree)) AS missing_parent_references, (SELECT coalesce(max(depth), 0) > (SELECT count(DISTINCT categoryid) FROM tree) FROM up) AS has_cycle"""


def _tree_row(spark: SparkSession, tree: DataFrame) -> DataFrame:
    found = audit.tree_profile(tree)
    return spark.createDataFrame([found], ", ".join(f"{k} {'boolean' if k == 'has_cycle' else 'long'}" for k in found))


@query(_tree_sql("tree AS (SELECT DISTINCT p_type || '/' || p_brand AS categoryid, p_type AS parentid FROM part UNION SELECT DISTINCT p_type, NULL FROM part)"))
def tree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_row(spark, star_dataset(spark, sf_dir).tree)


@query(_tree_sql("tree AS (SELECT CAST(n_nationkey AS VARCHAR) AS categoryid, CASE WHEN n_nationkey % 5 = 4 THEN CAST(100 + n_regionkey AS VARCHAR) WHEN n_nationkey % 5 = 3 THEN NULL ELSE CAST((7 * n_nationkey + 3) % 25 AS VARCHAR) END AS parentid FROM nation)"))
def tree_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of nations that has parents of themselves, circles, roots and missing parents."""
    n = F.col("n_nationkey")
    parent = F.when(n % 5 == 4, (100 + F.col("n_regionkey")).cast("string")).when(n % 5 != 3, ((7 * n + 3) % 25).cast("string"))
    return _tree_row(spark, spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.cast("string").alias("categoryid"), parent.alias("parentid")))


#: A chain of all parts by number, and the same closed to a ring.
_CHAIN = "tree AS (SELECT CAST(p_partkey AS VARCHAR) AS categoryid, CASE WHEN p_partkey > (SELECT min(p_partkey) FROM part) THEN CAST(p_partkey - 1 AS VARCHAR) {} END AS parentid FROM part)"


def _chain(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    ends = part.agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))  # one row
    parent = F.when(F.col("p_partkey") > F.col("low"), F.col("p_partkey") - 1).otherwise(F.col("high") if closed else F.lit(None))
    return _tree_row(spark, part.crossJoin(F.broadcast(ends)).select(F.col("p_partkey").cast("string").alias("categoryid"), parent.cast("string").alias("parentid")))


@query(_tree_sql(_CHAIN.format("")))
def deep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree as deep as there are parts."""
    return _chain(spark, sf_dir, False)


@query(_tree_sql(_CHAIN.format("ELSE (SELECT CAST(max(p_partkey) AS VARCHAR) FROM part)")))
def deep_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, closed to one circle."""
    return _chain(spark, sf_dir, True)


@query(f"WITH {_EV} SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("timestamp", "visitorid", "event", "itemid", "transactionid")) + ", count(*) AS row_count FROM ev")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.file_profile(star_dataset(spark, sf_dir).events, "events")
    row = found["null_counts"] | {"row_count": found["row_count"]}
    return spark.createDataFrame([row], ", ".join(f"{c} long" for c in row))


@query(
    f"WITH {_EV}, {_PROPS}, items AS (SELECT DISTINCT itemid FROM ev WHERE itemid IS NOT NULL UNION SELECT 1000000 + r_regionkey FROM region) SELECT round(avg(CASE WHEN itemid IN (SELECT itemid FROM props) THEN 1.0 ELSE 0.0 END), 6) AS any_part, "
    "round(avg(CASE WHEN itemid IN (SELECT itemid FROM props WHERE property = 'available') THEN 1.0 ELSE 0.0 END), 6) AS available_part FROM items"
)
def coverage_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of items with properties where some items have none."""
    data = star_dataset(spark, sf_dir)
    strange = spark.read.parquet(f"{sf_dir}/region.parquet").select((1_000_000 + F.col("r_regionkey")).cast("long").alias("itemid"))
    found = audit.coverage(data.events.select("itemid").unionByName(strange), data.properties)
    return spark.createDataFrame([(round(found["event_item_property_coverage"], 6), round(found["event_item_available_coverage"], 6))], "any_part double, available_part double")


def _written_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The test tables as CSV files in the shared folder, read back. The first property file has an older category of each item at the same time as the second's."""
    data = star_dataset(spark, sf_dir)
    folder = new_path(spark, "csv")
    named = data.properties.drop("row_id")
    older = named.where("property = 'categoryid'").withColumn("value", F.concat("value", F.lit("/old")))
    tables = zip(EXPECTED_FILES, (data.events.drop("row_id"), older, named, data.tree), strict=True)
    for name, table in tables:
        table.write.option("header", True).csv(f"{folder}/{name}")
    return read_dataset(spark, folder)


@query(
    "WITH lists AS (SELECT s_nationkey AS nation, s_suppkey AS itemid, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier), "
    "turns AS (SELECT n_regionkey, itemid, r, row_number() OVER (PARTITION BY n_regionkey, r ORDER BY n_nationkey) AS turn FROM nation JOIN lists ON nation = n_nationkey), "
    f"merged AS (SELECT n_regionkey, itemid, row_number() OVER (PARTITION BY n_regionkey ORDER BY r, turn) AS rank FROM turns WHERE r <= {DEPTH}) "
    f"SELECT CAST(n_nationkey AS VARCHAR) AS category, itemid, rank FROM nation JOIN merged USING (n_regionkey) WHERE rank <= {DEPTH}"
)
def csv_tree_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nations under regions, from a tree file whose numbers are in no order and have a fraction of zero: 9 comes before 10."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = f"{new_path(spark, 'csv')}/{EXPECTED_FILES[3]}"
    tree = nation.select(F.col("n_nationkey").alias("categoryid"), F.concat((1000 + F.col("n_regionkey")).cast("string"), F.lit(".0")).alias("parentid"))
    tree.orderBy(F.desc("categoryid")).write.option("header", True).csv(path)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").cast("string").alias("category"), F.col("s_suppkey").alias("itemid"), "s_acctbal")
    popular = first_n(supplier, ["category"], [F.desc("s_acctbal"), F.asc("itemid")], DEPTH)
    return rankings.sibling_items(read_csv(spark, path, TREE, "category_tree.csv"), popular, DEPTH)


@query(f"WITH {_EV} SELECT itemid, category FROM cats")
def csv_latest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with equal times the later file's counts."""
    return rankings.latest_category(_written_dataset(spark, sf_dir).properties, 10**15)


@query(f"WITH {_EV} SELECT event, count(*) AS events, count(DISTINCT itemid) AS items, count(transactionid) AS ids, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM ev GROUP BY 1")
def csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _written_dataset(spark, sf_dir).events
    return events.groupBy("event").agg(F.count("*").alias("events"), F.count_distinct("itemid").alias("items"), F.count("transactionid").alias("ids"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


@query(
    f"WITH {_EV}, {_PROPS}, items AS (SELECT DISTINCT itemid FROM ev WHERE itemid IS NOT NULL) SELECT count(*) AS items, count(*) FILTER (itemid IN (SELECT itemid FROM props)) AS with_any, "
    "count(*) FILTER (itemid IN (SELECT itemid FROM props WHERE property = 'categoryid')) AS with_category, count(*) FILTER (itemid IN (SELECT itemid FROM props WHERE property = 'available')) AS with_available FROM items"
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = star_dataset(spark, sf_dir)
    found = audit.coverage(data.events, data.properties)
    items = data.events.where("itemid is not null").agg(F.count_distinct("itemid")).first()[0]
    return spark.createDataFrame([(items, *(found[f"event_items_with_{n}_property"] for n in ("any", "category", "available")))], "items long, with_any long, with_category long, with_available long")


# -- ranked lists ------------------------------------------------------------------------------------------------------


@query(f"WITH {_EV} " + " UNION ALL ".join(f"SELECT '{e}' AS event, * FROM ({_popularity_sql(e)})" for e in EVENT_TYPES))
def popularity_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _Base(spark, sf_dir).train
    return reduce(DataFrame.unionByName, [rankings.event_popularity(train, e).withColumn("event", F.lit(e)) for e in EVENT_TYPES])


@query(f"WITH {_EV} SELECT itemid, round(score, 6) AS score, rank FROM ({_DECAY})")
def decayed_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rankings.decayed_popularity(_Base(spark, sf_dir).train, HALF_LIFE), "score")


_LISTS = _EV + _lists_sql(DEPTH)


@query(f"WITH {_LISTS} SELECT source, itemid, score, rank FROM trans")
def transitions_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.neighbors(rankings.adjacent_pairs(_Base(spark, sf_dir).train, GAP), DEPTH)


@query(f"WITH {_LISTS} SELECT source, itemid, score, rank FROM covis")
def covisitation_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.neighbors(rankings.adjacent_pairs(_Base(spark, sf_dir).train, GAP), DEPTH, symmetric=True)


@query(f"WITH {_LISTS} SELECT visitorid, itemid, score, rank FROM hist")
def visitor_history_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.visitor_history(_Base(spark, sf_dir).train, DEPTH)


@query(f"WITH {_EV} SELECT itemid, category FROM cats")
def latest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return rankings.latest_category(b.data.properties, b.train_end)


_STATE = "state AS (SELECT epoch_us(l_shipdate) // 1000 AS timestamp, l_partkey AS itemid, CASE WHEN max(l_linestatus) = 'O' THEN '1' ELSE '0' END AS value FROM lineitem GROUP BY 1, 2)"
#: Three cutoffs: 1995-01-01, 1996-01-01, 1998-01-01.
_CUTOFFS = {"early": 788918400000, "middle": 820454400000, "late": 883612800000}


@query(f"WITH {_STATE} SELECT itemid, " + ", ".join(f"max_by(value, timestamp) FILTER (timestamp <= {at}) AS {name}" for name, at in _CUTOFFS.items()) + f" FROM state WHERE timestamp <= {max(_CUTOFFS.values())} GROUP BY 1")
def states_at_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The availability of parts at three cutoffs, from one scan."""
    return rankings.states_at(star_dataset(spark, sf_dir).properties, "available", _CUTOFFS)


@query(f"WITH {_STATE} SELECT itemid, value, timestamp AS valid_from, lead(timestamp) OVER (PARTITION BY itemid ORDER BY timestamp) AS valid_to FROM state")
def state_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.state_intervals(star_dataset(spark, sf_dir).properties, "available")


@query(f"WITH {_LISTS} SELECT category, itemid, score, rank FROM catpop")
def category_popularity_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return rankings.category_popularity(b.train, rankings.latest_category(b.data.properties, b.train_end), DEPTH)


@query(f"WITH {_LISTS} SELECT category, itemid, rank FROM parent")
def parent_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    popular = rankings.category_popularity(b.train, rankings.latest_category(b.data.properties, b.train_end), DEPTH)
    return rankings.sibling_items(b.data.tree, popular, DEPTH)


_COHORTS = "cohorts AS (SELECT itemid, CASE WHEN (rn - 1) / n < 0.10 THEN 'head' WHEN (rn - 1) / n < 0.50 THEN 'mid_tail' ELSE 'long_tail' END AS cohort FROM (SELECT itemid, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) AS rn, count(*) OVER () AS n FROM train GROUP BY itemid))"


@query(f"WITH {_EV}, {_COHORTS} SELECT itemid, cohort FROM cohorts")
def item_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.item_cohorts(_Base(spark, sf_dir).train)


_VISITORS = "visitors AS (SELECT q.split, q.query_id, CASE WHEN coalesce(h, 0) = 0 THEN 'new' WHEN h < 5 THEN 'sparse' ELSE 'repeat' END AS cohort FROM q LEFT JOIN (SELECT visitorid, count(*) AS h FROM train GROUP BY 1) USING (visitorid))"


@query(f"WITH {_Q}, {_VISITORS} SELECT split, query_id, cohort FROM visitors")
def visitor_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return b.asked().queries.join(rankings.history_counts(b.train), "visitorid", "left").select("split", "query_id", rankings.visitor_cohort(F.col("history")).alias("cohort"))


# -- queries -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_Q} SELECT split, query_id, visitorid, timestamp, last_item FROM q")
def session_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Base(spark, sf_dir).asked().queries


@query(f"WITH {_Q} SELECT split, query_id, task, itemid FROM pos")
def session_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Base(spark, sf_dir).asked().positives


_STAGES = (
    _Q
    + """,
marked AS (SELECT *, min(CASE WHEN event = 'addtocart' THEN place END) OVER w AS cart, max(CASE WHEN place = 0 THEN event END) OVER w AS opens FROM placed WHERE n >= 2 AND split <> 'train' WINDOW w AS (PARTITION BY split, query_id)),
sq AS (SELECT split, query_id, 'view_stage' AS stage, visitorid, timestamp, itemid AS last_item FROM marked WHERE place = 0 AND event = 'view' UNION ALL SELECT split, query_id, 'cart_stage', visitorid, timestamp, itemid FROM marked WHERE place = cart AND cart < n - 1),
spos AS (SELECT DISTINCT split, query_id, 'view_stage' AS stage, event AS task, itemid FROM marked WHERE place > 0 AND opens = 'view' AND event IN ('view', 'addtocart', 'transaction')
  UNION ALL SELECT DISTINCT split, query_id, 'cart_stage', event, itemid FROM marked WHERE place > cart AND cart < n - 1 AND event = 'transaction')"""
)


def _stages(spark: SparkSession, sf_dir: str) -> sessions.Queries:
    b = _Base(spark, sf_dir)
    return sessions.stage_queries(b.split, "validation", GAP).union(sessions.stage_queries(b.split, "test", GAP))


@query(f"WITH {_STAGES} SELECT * FROM sq")
def stage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).queries


@query(f"WITH {_STAGES} SELECT * FROM spos")
def stage_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).positives


# -- metrics of baselines ----------------------------------------------------------------------------------------------

_NAMES = dict(zip(("visitor_history", "covisitation", "transition", "category"), evaluations.BASELINES[4:], strict=True))
_BASELINES = (
    _Q
    + _CAND
    + f""",
same AS (SELECT 'most_view' AS variant, itemid, rank FROM ({_popularity_sql('view')}) UNION ALL SELECT 'most_addtocart', itemid, rank FROM ({_popularity_sql('addtocart')}) UNION ALL SELECT 'most_transaction', itemid, rank FROM ({_popularity_sql('transaction')})
  UNION ALL SELECT 'time_decayed_popularity', itemid, rank FROM ({_DECAY})),
own AS (SELECT split, query_id, CASE source {' '.join(f"WHEN '{s}' THEN '{v}'" for s, v in _NAMES.items())} END AS variant, itemid, rank FROM cand WHERE source IN ({', '.join(f"'{s}'" for s in _NAMES)})),
asked AS (SELECT split, query_id, variant FROM q, (SELECT unnest([{', '.join(f"'{v}'" for v in _NAMES.values())}]) AS variant)),
ranked AS (SELECT split, query_id, variant, itemid, rank FROM q, same WHERE rank <= {K} UNION ALL {_completed_sql('own')})"""
)


def _ranked_baselines(spark: SparkSession, sf_dir: str) -> tuple[_Base, sessions.Queries, DataFrame]:
    b = _Base(spark, sf_dir)
    asked = b.asked()
    p = evaluations.Protocol(b.split, b.train, asked, {})
    return b, asked, evaluations.baseline_rankings(p, b.sources(asked.queries), K)


@query(f"WITH {_BASELINES}, m AS ({_metrics_sql('ranked')}) SELECT split, variant, task, {_AVG} FROM m GROUP BY ALL")
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked, ranked = _ranked_baselines(spark, sf_dir)
    return _averaged(metrics.query_metrics(ranked, asked.positives, evaluations.BASELINES, K), ["split", "variant", "task"])


@query(f"WITH {_BASELINES}, {_VISITORS}, m AS ({_metrics_sql('ranked')}) SELECT split, cohort, variant, task, {_AVG} FROM m JOIN visitors USING (split, query_id) GROUP BY ALL")
def visitor_cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, asked, ranked = _ranked_baselines(spark, sf_dir)
    cohorts = asked.queries.join(rankings.history_counts(b.train), "visitorid", "left").select("split", "query_id", rankings.visitor_cohort(F.col("history")).alias("cohort"))
    return _averaged(metrics.query_metrics(ranked, asked.positives, evaluations.BASELINES, K).join(cohorts, ["split", "query_id"]), ["split", "cohort", "variant", "task"])


@query(
    f"WITH {_BASELINES}, {_COHORTS}, parts AS (SELECT pos.*, coalesce(cohort, 'unseen') AS cohort FROM pos LEFT JOIN cohorts USING (itemid)), m AS ({_metrics_sql('ranked', 'parts', 'cohort')}) SELECT split, cohort, variant, task, {_AVG} FROM m GROUP BY ALL"
)
def item_cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, asked, ranked = _ranked_baselines(spark, sf_dir)
    parts = asked.positives.join(rankings.item_cohorts(b.train), "itemid", "left").withColumn("cohort", F.coalesce("cohort", F.lit("unseen")))
    return _averaged(metrics.query_metrics(ranked, parts, evaluations.BASELINES, K), ["split", "cohort", "variant", "task"])


@query(
    f"WITH {_BASELINES}, {_VISITORS}, {_COHORTS}, parts AS (SELECT pos.*, coalesce(cohort, 'unseen') AS cohort FROM pos LEFT JOIN cohorts USING (itemid)), m AS ({_metrics_sql('ranked')}), mi AS ({_metrics_sql('ranked', 'parts', 'cohort')}) "
    f"SELECT split, 'overall' AS scope, NULL AS cohort, variant, task, {_AVG} FROM m GROUP BY ALL UNION ALL SELECT split, 'visitor', cohort, variant, task, {_AVG} FROM m JOIN visitors USING (split, query_id) GROUP BY ALL UNION ALL SELECT split, 'item', cohort, variant, task, {_AVG} FROM mi GROUP BY ALL"
)
def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the baselines' metrics, overall and by both kinds of cohorts, from one scoring."""
    b, asked, ranked = _ranked_baselines(spark, sf_dir)
    visitors = asked.queries.join(rankings.history_counts(b.train), "visitorid", "left").select("split", "query_id", rankings.visitor_cohort(F.col("history")).alias("cohort"))
    parts = asked.positives.join(rankings.item_cohorts(b.train), "itemid", "left").withColumn("cohort", F.coalesce("cohort", F.lit("unseen")))
    return _rounded(metrics.cohort_metrics(ranked, parts, visitors, evaluations.BASELINES, K), "recall", "ndcg")


# -- fusion ------------------------------------------------------------------------------------------------------------


@query(f"WITH {_Q}{_CAND} SELECT split, query_id, itemid, round(score, 6) AS score, rank FROM ({_rrf_sql(list(COMPONENTS))})")
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    asked = b.asked().queries
    found = fusion.looked_up(asked, b.sources(asked), COMPONENTS, DEPTH)
    return _rounded(fusion.fused(found, COMPONENTS, DEPTH, OFFSET, K), "score")


_HYBRIDS = (
    _Q
    + _CAND
    + ", own AS ("
    + " UNION ALL ".join(f"SELECT split, query_id, '{v}' AS variant, itemid, rank FROM ({_rrf_sql(c)})" for v, c in evaluations.HYBRIDS.items())
    + f"), asked AS (SELECT split, query_id, variant FROM q, (SELECT unnest([{', '.join(repr(v) for v in evaluations.HYBRIDS)}]) AS variant)), ranked AS ({_completed_sql('own')}), m AS ({_metrics_sql('ranked')})"
)


def _hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    asked = b.asked()
    s = b.sources(asked.queries)
    rows = evaluations.gathered_rows(evaluations.Protocol(b.split, b.train, asked, {}), s, DEPTH, K)[1]
    return evaluations.hybrid_metrics(rows, OFFSET, K)


@query(f"WITH {_HYBRIDS} SELECT split, variant, task, {_AVG} FROM m GROUP BY ALL")
def hybrid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averaged(_hybrid_scores(spark, sf_dir), ["split", "variant", "task"])


@query(
    f"WITH {_HYBRIDS}, a AS (SELECT variant, task, avg(ndcg) AS ndcg FROM m WHERE split = 'validation' GROUP BY ALL) SELECT replace(x.variant, 'hybrid_minus_', '') AS component, x.task, round(f.ndcg - x.ndcg, 6) AS delta_ndcg FROM a x JOIN a f USING (task) WHERE f.variant = 'hybrid_full' AND x.variant LIKE 'hybrid_minus_%'"
)
def hybrid_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = metrics.averaged(_hybrid_scores(spark, sf_dir).where("split = 'validation'"), ["variant", "task"])
    full = means.where("variant = 'hybrid_full'").select("task", F.col("ndcg").alias("whole"))
    less = means.where("variant like 'hybrid_minus_%'")
    return less.join(full, "task").select(F.replace("variant", F.lit("hybrid_minus_"), F.lit("")).alias("component"), "task", F.round(F.col("whole") - F.col("ndcg"), 6).alias("delta_ndcg"))


# -- candidates --------------------------------------------------------------------------------------------------------

_ORDER = ("category", "parent", *COMPONENTS[1:])
_HALF = DEPTH // 2


def _limit_sql(category: int, behavioral: int, parent: int) -> str:
    return f"(source = 'category' AND rank <= {category} OR source IN ('covisitation', 'recency', 'visitor_history') AND rank <= {behavioral} OR source = 'parent' AND rank <= {parent})"


_DEPTHS = {"base": _HALF, "expanded": DEPTH, None: 0}
_VARIED = _Q + _CAND + ", varied AS (" + " UNION ALL ".join(f"SELECT *, '{v}' AS variant FROM cand WHERE {_limit_sql(_DEPTHS[c], _DEPTHS[b], _DEPTHS[p])}" for v, (c, b, p) in evaluations.RETRIEVALS.items()) + "), sets AS (SELECT DISTINCT split, query_id, variant, itemid FROM varied)"


def _varied(spark: SparkSession, sf_dir: str) -> tuple[sessions.Queries, DataFrame]:
    b = _Base(spark, sf_dir)
    asked = b.asked()
    found = fusion.looked_up(asked.queries, b.sources(asked.queries), _ORDER, DEPTH)
    return asked, evaluations._variant_candidates(found, {"base": _HALF, "expanded": DEPTH})


@query(f"WITH {_VARIED} SELECT split, query_id, variant, itemid FROM sets")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.candidate_sets(_varied(spark, sf_dir)[1])


@query(
    f"WITH {_VARIED} SELECT split, variant, task, round(avg(coalesce(found, 0) / positives), 6) AS recall FROM (SELECT split, query_id, task, count(*) AS positives FROM pos GROUP BY ALL) CROSS JOIN (SELECT DISTINCT variant FROM sets) "
    "LEFT JOIN (SELECT split, query_id, task, variant, count(*) AS found FROM pos JOIN sets USING (split, query_id, itemid) GROUP BY ALL) USING (split, query_id, task, variant) GROUP BY ALL"
)
def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, varied = _varied(spark, sf_dir)
    scored = metrics.candidate_recall(varied, asked.positives, list(evaluations.RETRIEVALS))
    return scored.groupBy("split", "variant", "task").agg(F.round(F.avg("recall"), 6).alias("recall"))


@query(
    f"WITH {_VARIED}, sizes AS (SELECT split, variant, coalesce(n, 0) AS n FROM q CROSS JOIN (SELECT DISTINCT variant FROM sets) LEFT JOIN (SELECT split, query_id, variant, count(*) AS n FROM sets GROUP BY ALL) USING (split, query_id, variant)) "
    "SELECT split, variant, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95 FROM sizes GROUP BY ALL"
)
def candidate_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, varied = _varied(spark, sf_dir)
    return _rounded(metrics.candidate_size(varied, asked.queries, ["split", "variant"], list(evaluations.RETRIEVALS)), "mean", "median", "p95")


_FEATURES = ", ".join(f"round(coalesce(1.0 / ({OFFSET} + min(CASE WHEN source = '{c}' THEN rank END)), 0), 6) AS {c}_rr" for c in COMPONENTS) + ", " + ", ".join(f"CAST(max(CASE WHEN source = '{c}' THEN 1 ELSE 0 END) AS DOUBLE) AS {c}_present" for c in COMPONENTS)


@query(f"WITH {_Q}{_CAND} SELECT split, query_id, itemid, {_FEATURES} FROM cand WHERE source IN ({', '.join(repr(c) for c in COMPONENTS)}) GROUP BY ALL")
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    asked = b.asked().queries
    found = fusion.features(fusion.looked_up(asked, b.sources(asked), COMPONENTS, DEPTH), dict.fromkeys(COMPONENTS, DEPTH), OFFSET)
    return _rounded(found, *[f"{c}_rr" for c in COMPONENTS])


@query(
    f"WITH {_Q}{_CAND}, u AS (SELECT DISTINCT split, query_id, itemid FROM cand WHERE source IN ({', '.join(repr(c) for c in COMPONENTS)})), l AS (SELECT u.*, task, CASE WHEN p.itemid IS NULL THEN 0 ELSE 1 END AS label FROM u CROSS JOIN (SELECT unnest(['view', 'addtocart', 'transaction']) AS task) t LEFT JOIN pos p USING (split, query_id, task, itemid)), "
    "o AS (SELECT *, max(label) OVER (PARTITION BY split, query_id, task) AS found, row_number() OVER (PARTITION BY split, query_id, task, label ORDER BY itemid) AS nth FROM l) SELECT split, query_id, task, itemid, label FROM o WHERE found = 1 AND (label = 1 OR nth <= 5)"
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    asked = b.asked()
    found = fusion.features(fusion.looked_up(asked.queries, b.sources(asked.queries), COMPONENTS, DEPTH), dict.fromkeys(COMPONENTS, DEPTH), OFFSET)
    each = [learning.training_rows(found, asked.positives, t, 5).select("split", "query_id", F.lit(t).alias("task"), "itemid", "label") for t in EVENT_TYPES]
    return reduce(DataFrame.unionByName, each)


_TRAINING = (
    f"u AS (SELECT split, query_id, itemid, {{}} FROM cand WHERE source IN ({', '.join(repr(c) for c in COMPONENTS)}) GROUP BY ALL), l AS (SELECT u.*, task, CASE WHEN p.itemid IS NULL THEN 0 ELSE 1 END AS label FROM u CROSS JOIN (SELECT unnest(['view', 'addtocart', 'transaction']) AS task) t LEFT JOIN pos p USING (split, query_id, task, itemid)), "
    "o AS (SELECT *, max(label) OVER (PARTITION BY split, query_id, task) AS found, row_number() OVER (PARTITION BY split, query_id, task, label ORDER BY itemid) AS nth FROM l), chosen AS (SELECT * FROM o WHERE found = 1 AND (label = 1 OR nth <= 5))"
)


@query(
    f"WITH {_Q}{_CAND}, {_TRAINING.format(_FEATURES)} SELECT task, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, true AS optimal, "
    + ", ".join(f"round(avg({c}_present), 4) AS {c}_mean" for c in COMPONENTS)
    + " FROM chosen GROUP BY task"
)
def fit_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit of each task, its rows, and whether the objective's gradient at its coefficients, as sums of SQL, is nothing: then no other coefficients are better."""
    b = _Base(spark, sf_dir)
    asked = b.asked()
    found = cut(fusion.features(fusion.looked_up(asked.queries, b.sources(asked.queries), COMPONENTS, DEPTH), dict.fromkeys(COMPONENTS, DEPTH), OFFSET))
    each = []
    for t in EVENT_TYPES:
        rows = cut(learning.training_rows(found, asked.positives, t, 5))
        judged = learning.certificate(rows, learning.fit(rows)[0]).select("n", "positives", (F.col("gradient") < 1e-8).alias("optimal"))
        means = rows.agg(*[F.round(F.avg(f"{c}_present"), 4).alias(f"{c}_mean") for c in COMPONENTS])
        each.append(judged.crossJoin(F.broadcast(means)).select(F.lit(t).alias("task"), "*"))  # one row each
    return reduce(DataFrame.unionByName, each)


_BUDGETS = fusion.budget_grid((_HALF, DEPTH), (2, DEPTH), (0, _HALF, DEPTH))
_SWEEP = (
    _Q
    + _CAND
    + ", b(budget, c, b, p) AS (VALUES "
    + ", ".join(f"('{x.key}', {x.category}, {x.behavioral}, {x.parent})" for x in _BUDGETS)
    + "), bs AS (SELECT DISTINCT budget, split, query_id, itemid FROM cand, b WHERE source = 'category' AND rank <= c OR source IN ('covisitation', 'recency', 'visitor_history') AND rank <= b OR source = 'parent' AND rank <= p), "
    "rec AS (SELECT budget, split, task, avg(coalesce(found, 0) / positives) AS recall FROM (SELECT split, query_id, task, count(*) AS positives FROM pos GROUP BY ALL) CROSS JOIN b LEFT JOIN (SELECT budget, split, query_id, task, count(*) AS found FROM bs JOIN pos USING (split, query_id, itemid) GROUP BY ALL) USING (budget, split, query_id, task) GROUP BY ALL), "
    "siz AS (SELECT budget, split, avg(coalesce(n, 0)) AS size FROM q CROSS JOIN b LEFT JOIN (SELECT budget, split, query_id, count(*) AS n FROM bs GROUP BY ALL) USING (budget, split, query_id) GROUP BY ALL), "
    "points AS (SELECT budget, split, avg(recall) AS recall, any_value(size) AS size FROM rec JOIN siz USING (budget, split) GROUP BY ALL)"
)


def _sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recall by (budget, split, task) and mean size by (budget, split)."""
    b = _Base(spark, sf_dir)
    asked = b.asked()
    hits = fusion.budget_hits(fusion.looked_up(asked.queries, b.sources(asked.queries), _ORDER, DEPTH), asked.positives, _BUDGETS)
    recall = hits.where("task is not null").groupBy("budget", "split", "task").agg(F.avg(F.col("found") / F.col("positives")).alias("recall"))
    # every query has the recency list, so each has a row
    return recall, hits.where("task is null").groupBy("budget", "split").agg(F.avg("found").alias("size"))


@query(f"WITH {_SWEEP} SELECT budget, split, task, round(recall, 6) AS recall, round(size, 6) AS size FROM rec JOIN siz USING (budget, split)")
def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall, size = _sweep(spark, sf_dir)
    return _rounded(recall.join(size, ["budget", "split"]), "recall", "size")


@query(
    f"WITH {_SWEEP}, r AS (SELECT budget, split, round(recall, 9) AS recall, round(size, 9) AS size FROM points) SELECT split, budget, round(recall, 6) AS recall, round(size, 6) AS size FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.split = r.split AND o.recall >= r.recall AND o.size <= r.size AND (o.recall > r.recall OR o.size < r.size))"
)
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall, size = _sweep(spark, sf_dir)
    points = recall.groupBy("budget", "split").agg(F.round(F.avg("recall"), 9).alias("recall")).join(size.withColumn("size", F.round("size", 9)), ["budget", "split"])
    each = [decisions.pareto_frame(points.where(F.col("split") == s)) for s in ("validation", "test")]
    return _rounded(each[0].unionByName(each[1]).select("split", "budget", "recall", "size"), "recall", "size")


_REFERENCE = fusion.Budget(DEPTH, DEPTH, DEPTH).key


@query(f"WITH {_SWEEP} SELECT x.budget, x.split, x.task, round(CASE WHEN f.recall > 0 THEN x.recall / f.recall ELSE 1 END, 6) AS retention FROM rec x JOIN rec f USING (split, task) WHERE f.budget = '{_REFERENCE}'")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall, _ = _sweep(spark, sf_dir)
    whole = recall.where(F.col("budget") == _REFERENCE).select("split", "task", F.col("recall").alias("whole"))
    kept = F.when(F.col("whole") > 0, F.col("recall") / F.col("whole")).otherwise(1.0)
    return recall.join(whole, ["split", "task"]).select("budget", "split", "task", F.round(kept, 6).alias("retention"))


# -- learned rankers and whole evaluations: no SQL ---------------------------------------------------------------------


def _scored(b: _Base, models: dict[str, learning.Model], decimals: int | None = None) -> DataFrame:
    """Ranked candidates of all queries by each task's model."""
    asked = b.asked().queries
    rows = fusion.gathered(asked, b.sources(asked), COMPONENTS, DEPTH, K)
    return learning.ranked_rows(rows.select("split", "query_id", fusion.items_of(COMPONENTS, OFFSET, fallback=False).alias("items")), models, K, decimals)


@query()
def learned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates of test queries by a model of each task, fitted on the later fifth of the training period."""
    b = _Base(spark, sf_dir)
    end, early, late = evaluations._internal(b.train, 0.8)
    inner = sessions.session_queries(late, "ranker_train", GAP)
    depths = dict.fromkeys(COMPONENTS, DEPTH)
    lists = fusion.fit_sources(early, b.data.properties, None, end, GAP, DEPTH, HALF_LIFE, inner.queries, K)
    counted = evaluations._counted(inner, lists, depths, OFFSET, 50)
    models = {t: m for t, (m, _, _) in learning.fits(counted.withColumnRenamed("task", "model"), EVENT_TYPES).items()}
    return _rounded(_scored(b, models), "score")


@query(f"WITH {_EV}, placed AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp, row_id) - 1 AS place, count(*) OVER () AS n FROM train) SELECT timestamp AS internal_fit_end_ms FROM placed WHERE place = round_even((n - 1) * 0.8, 0)")
def internal_fit_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _Base(spark, sf_dir).train
    end = values_at(train, "timestamp", [nearest_index(train.count(), 0.8)])[0]
    return spark.createDataFrame([(end,)], "internal_fit_end_ms long")


def _long(report: dict, key: str = "metrics") -> list[tuple]:
    return [(s, v, t, c["queries"], float(c["recall_at_k"]), float(c["ndcg_at_k"])) for s, vs in report[key].items() for v, ts in vs.items() for t, c in ts.items()]


_LONG = "split string, variant string, task string, queries long, recall double, ndcg double"


@query()
def efficient_reranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return spark.createDataFrame(_long(evaluations.evaluate_reranker(b.data, b.frozen(), k=K, category_depth=DEPTH, behavioral_depth=DEPTH, max_sessions_per_split=None, max_internal_ranker_sessions=None)), _LONG)


@query()
def stage_aware_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    found = evaluations.evaluate_stages(b.data, b.frozen(), k=K, category_depth=DEPTH, behavioral_depth=DEPTH, max_sessions_per_split=None, max_internal_ranker_sessions=None)
    rows = [(s, f"{v}/{st}", t, c["queries"], float(c["recall_at_k"]), float(c["ndcg_at_k"])) for s, vs in found["metrics"].items() for v, sts in vs.items() for st, ts in sts.items() for t, c in ts.items()]
    return spark.createDataFrame(rows, _LONG)


#: Places that the sampler draws from the 98 items that are no positives: the same draw as the query's.
_DRAWN = temporal.draw(98, 10, 42)


@query(
    f"WITH {_EV}, others AS (SELECT itemid, row_number() OVER (ORDER BY itemid) - 1 AS place FROM (SELECT itemid FROM ev WHERE itemid IS NOT NULL AND itemid NOT IN (5, 9) GROUP BY itemid HAVING min(timestamp) <= (SELECT train_end FROM cut))) "
    f"SELECT itemid FROM others WHERE place IN ({', '.join(map(str, _DRAWN))}) UNION SELECT unnest([5, 9])"
)
def sampled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    catalog = temporal.time_valid_items(temporal.first_seen(b.events), b.train_end)
    return spark.createDataFrame([(i,) for i in temporal.sampled_candidates(catalog, [5, 9], 10, 42)], "itemid long")


#: Coefficients of a ranker for every task, to look at scoring apart from fitting.
_MODELS = {t: learning.Model((0.01, 0.005, 0.008, 0.002, 0.5, 0.4, 0.3, 0.2), (0.004, 0.003, 0.005, 0.001, 0.5, 0.5, 0.4, 0.4), tuple(0.1 * (i + 1) * (-1) ** (i * n) for i in range(8)), 0.25 * n) for n, t in enumerate(EVENT_TYPES)}
_NAMED = [f"{c}_rr" for c in COMPONENTS] + [f"{c}_present" for c in COMPONENTS]


def _score_sql(m: learning.Model) -> str:
    terms = " + ".join(f"({c!r}) * (({f}) - {a!r}) / {d!r}" for f, a, d, c in zip(fusion.FEATURES, m.mean, m.deviation, m.coefficients, strict=True))
    return f"1 / (1 + exp(-({m.intercept!r} + {terms})))"


_RAW = ", ".join(f"coalesce(1.0::DOUBLE / ({OFFSET}::DOUBLE + min(CASE WHEN source = '{c}' THEN rank END)), 0) AS {c}_rr" for c in COMPONENTS) + ", " + ", ".join(f"CAST(max(CASE WHEN source = '{c}' THEN 1 ELSE 0 END) AS DOUBLE) AS {c}_present" for c in COMPONENTS)


@query(
    f"WITH {_Q}{_CAND}, f AS (SELECT split, query_id, itemid, {_RAW} FROM cand WHERE source IN ({', '.join(repr(c) for c in COMPONENTS)}) GROUP BY ALL), "
    "scored AS (" + " UNION ALL ".join(f"SELECT split, query_id, '{t}' AS task, itemid, round({_score_sql(m)}, 9) AS score FROM f" for t, m in _MODELS.items()) + ") "
    f"SELECT split, query_id, task, itemid, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id, task ORDER BY score DESC, itemid) AS rank FROM scored) WHERE rank <= {K}"
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored and ranked by given models. Scores are compared to nine decimals, on which both engines agree."""
    return _rounded(_scored(_Base(spark, sf_dir), _MODELS, decimals=9), "score")


_THRESHOLD = 0.9


@query(
    f"WITH {_SWEEP}, j AS (SELECT x.budget, count(*) FILTER (x.recall >= {_THRESHOLD} * f.recall) = 3 AS enough, avg(x.recall) AS recall FROM rec x LEFT JOIN (SELECT * FROM rec WHERE budget = '{_REFERENCE}') f USING (split, task) WHERE x.split = 'validation' GROUP BY 1) "
    f"SELECT budget, round(recall, 6) AS recall, round(size, 6) AS size FROM j JOIN (SELECT budget, size FROM siz WHERE split = 'validation') USING (budget) WHERE enough OR budget = '{_REFERENCE}' ORDER BY enough DESC, size, recall DESC, budget LIMIT 1"
)
def efficient_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall, size = _sweep(spark, sf_dir)
    points = recall.join(size, ["budget", "split"]).where("split = 'validation'")
    return _rounded(decisions.efficient_choice(points, _REFERENCE, _THRESHOLD), "recall", "size")


_SINGLES = [f"{c}_only" for c in COMPONENTS]


@query(
    f"WITH {_HYBRIDS}, a AS (SELECT variant, task, avg(ndcg) AS ndcg FROM m WHERE split = 'validation' GROUP BY ALL), means AS (SELECT variant, avg(ndcg) AS mean FROM a GROUP BY 1), singles AS (SELECT unnest([{', '.join(repr(x) for x in _SINGLES)}]) AS variant), "
    "best AS (SELECT task, max(ndcg) AS best FROM a JOIN singles USING (variant) GROUP BY 1) SELECT round((SELECT mean FROM means WHERE variant = 'hybrid_full'), 6) AS mean_full, round((SELECT max(mean) FROM means JOIN singles USING (variant)), 6) AS mean_single, "
    "(SELECT count(*) FROM a JOIN best USING (task) WHERE variant = 'hybrid_full' AND ndcg >= best) AS wins, (SELECT mean FROM means WHERE variant = 'hybrid_full') > (SELECT max(mean) FROM means JOIN singles USING (variant)) AND (SELECT count(*) FROM a JOIN best USING (task) WHERE variant = 'hybrid_full' AND ndcg >= best) >= 2 AS retained"
)
def hybrid_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule on fusion, from the same numbers as the report."""
    cells = metrics.averaged(_hybrid_scores(spark, sf_dir).where("split = 'validation'"), ["variant", "task"])
    return _rounded(decisions.hybrid_rule(cells, "hybrid_full", _SINGLES), "mean_full", "mean_single").select("mean_full", "mean_single", "wins", "retained")


@query(
    f"WITH {_VARIED}, r AS (SELECT variant, task, avg(coalesce(found, 0) / positives) AS recall FROM (SELECT split, query_id, task, count(*) AS positives FROM pos WHERE split = 'validation' GROUP BY ALL) CROSS JOIN (SELECT DISTINCT variant FROM sets) "
    "LEFT JOIN (SELECT split, query_id, task, variant, count(*) AS found FROM pos JOIN sets USING (split, query_id, itemid) GROUP BY ALL) USING (split, query_id, task, variant) GROUP BY ALL), "
    "b AS (SELECT task, recall AS base FROM r WHERE variant = 'base_union'), e AS (SELECT task, recall AS expanded FROM r WHERE variant = 'expanded_union') SELECT round(avg(expanded) - avg(base), 6) AS gain, round(avg(expanded) - avg(base), 9) >= 0.03 AND bool_and(expanded >= base) AS retained FROM b JOIN e USING (task)"
)
def retrieval_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule on expanded retrieval."""
    asked, varied = _varied(spark, sf_dir)
    scored = metrics.candidate_recall(varied, asked.positives, list(evaluations.RETRIEVALS)).where("split = 'validation'")
    cells = scored.groupBy("variant", "task").agg(F.avg("recall").alias("recall"))
    return _rounded(decisions.retrieval_rule(cells, "base_union", "expanded_union"), "gain")


_SEED = 365


def _keyed_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{_SEED}', {', '.join(parts)})), 1, 8) AS BIGINT)"


@query(f"WITH {_Q}, picked AS (SELECT split, query_id FROM placed WHERE split = 'test' AND place = 0 AND n >= 2 ORDER BY {_keyed_sql('visitorid', 'session_index')}, visitorid, session_index LIMIT 20) SELECT q.* FROM q JOIN picked USING (split, query_id)")
def keyed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of twenty sessions, those with the smallest keyed numbers."""
    return sessions.session_queries(_Base(spark, sf_dir).laid, "test", GAP, max_sessions=20, seed=_SEED, how="keyed").queries


_DRAWS = 7


@query(
    f"WITH {_Q}, cat AS (SELECT itemid, row_number() OVER (ORDER BY itemid) - 1 AS position FROM (SELECT itemid FROM ev WHERE itemid IS NOT NULL GROUP BY 1 HAVING min(timestamp) <= (SELECT train_end FROM cut))), "
    # primes under 1,000; the catalogue has a hundred items
    "composite AS (SELECT DISTINCT a.x * b.x AS p FROM range(2, 500) a(x), range(2, 500) b(x) WHERE a.x * b.x < 1000), dims AS (SELECT n, (SELECT min(p) FROM range(2, 1000) r(p) WHERE p >= n AND p NOT IN (SELECT p FROM composite)) AS prime FROM (SELECT count(*) AS n FROM cat)), "
    "own AS (SELECT DISTINCT split, query_id, itemid FROM pos), "
    f"starts AS (SELECT split, query_id, {_keyed_sql(chr(39) + 'step' + chr(39), 'split', 'query_id')} % (prime - 1) + 1 AS step, {_keyed_sql(chr(39) + 'start' + chr(39), 'split', 'query_id')} % prime AS start, prime FROM q, dims), "
    "stood AS (SELECT split, query_id, pace, (start + pace * step) % prime AS position FROM starts, range(0, 1000) r(pace) WHERE pace < prime) "
    f"SELECT split, query_id, itemid, draw FROM (SELECT split, query_id, itemid, row_number() OVER (PARTITION BY split, query_id ORDER BY pace) AS draw FROM stood JOIN cat USING (position) ANTI JOIN own USING (split, query_id, itemid)) WHERE draw <= {_DRAWS}"
)
def drawn_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven negatives of every query, drawn at once from the items that are eligible at the end of training."""
    b = _Base(spark, sf_dir)
    asked = b.asked()
    catalog = temporal.time_valid_items(temporal.first_seen(b.events), b.train_end)
    return temporal.drawn_negatives(asked.queries, asked.positives, catalog, ["split", "query_id"], _DRAWS, _SEED)


@query()
def sampled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of a drawn sample of the eligible sessions; compared with the same draw in the tests."""
    return sessions.session_queries(_Base(spark, sf_dir).split, "test", GAP, max_sessions=20, seed=365).queries


@query()
def learned_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Base(spark, sf_dir)
    return spark.createDataFrame(_long(evaluations.evaluate_learned(b.data, b.frozen(), k=K, source_depth=DEPTH, max_sessions_per_split=None, max_internal_ranker_sessions=None)), _LONG)


_PLAIN = {"category_only": ["category"], "efficient_rrf": list(COMPONENTS)}
_MODEL_CELLS = (
    _Q
    + _CAND
    + f", f AS (SELECT split, query_id, itemid, {_RAW} FROM cand WHERE source IN ({', '.join(repr(c) for c in COMPONENTS)}) GROUP BY ALL), scored AS ("
    + " UNION ALL ".join(f"SELECT split, query_id, '{t}' AS task, itemid, {_score_sql(m)} AS score FROM f" for t, m in _MODELS.items())
    + "), learned AS (SELECT split, query_id, task, itemid, row_number() OVER (PARTITION BY split, query_id, task ORDER BY score DESC, itemid) AS rank FROM scored), tasks AS (SELECT split, query_id, task FROM q, (SELECT unnest(['view', 'addtocart', 'transaction']) AS task)), own AS ("
    + " UNION ALL ".join(f"SELECT split, query_id, '{v}' AS variant, itemid, rank FROM ({_rrf_sql(c)})" for v, c in _PLAIN.items())
    + f"), asked AS (SELECT split, query_id, variant FROM q, (SELECT unnest([{', '.join(repr(v) for v in _PLAIN)}]) AS variant)), plain AS ({_completed_sql('own')}), trained AS (SELECT *, 'learned_task_specific' AS variant FROM ({_completed_sql('learned', 'task', 'tasks')})), "
    + f"m AS ({_metrics_sql('plain')} UNION ALL {_metrics_sql('trained', by_task=True)}), cells AS (SELECT split, variant, task, count(*) AS queries, avg(recall) AS recall, avg(ndcg) AS ndcg FROM m GROUP BY ALL)"
)


def _given_report(spark: SparkSession, sf_dir: str) -> dict:
    b = _Base(spark, sf_dir)
    return evaluations.evaluate_reranker(b.data, b.frozen(), k=K, category_depth=DEPTH, behavioral_depth=DEPTH, max_sessions_per_split=None, models=_MODELS)


@query(f"WITH {_MODEL_CELLS} SELECT split, variant, task, queries, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM cells")
def given_rankers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation of rerankers, with given models in place of fitted ones."""
    return _rounded(spark.createDataFrame(_long(_given_report(spark, sf_dir)), _LONG), "recall", "ndcg")


@query(
    f"WITH {_MODEL_CELLS}, means AS (SELECT variant, avg(ndcg) AS mean FROM cells WHERE split = 'validation' GROUP BY 1), best AS (SELECT variant FROM means WHERE variant <> 'learned_task_specific' ORDER BY mean DESC, variant DESC LIMIT 1), "
    "mine AS (SELECT task, ndcg FROM cells WHERE split = 'validation' AND variant = 'learned_task_specific'), other AS (SELECT task, ndcg AS bar FROM cells WHERE split = 'validation' AND variant = (SELECT variant FROM best)) "
    "SELECT (SELECT variant FROM best) AS comparator, avg(ndcg) > avg(bar) AND count(*) FILTER (ndcg > bar) >= 2 AS retained FROM mine JOIN other USING (task)"
)
def learned_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule on learned rankers, from the same report."""
    found = _given_report(spark, sf_dir)
    return spark.createDataFrame([(found["best_deterministic_validation_baseline"], found["validation_retain_learned_ranker"])], "comparator string, retained boolean")


#: Rankers by stage and task: the given ones with the signs of their coefficients turned where the stage is the cart's.
_STAGE_MODELS = {(st, t): learning.Model(m.mean, m.deviation, tuple((-1) ** (st == "cart_stage") * c for c in m.coefficients[::-1]), m.intercept) for st, ts in sessions.STAGE_TASKS.items() for t, m in _MODELS.items() if t in ts}
_STAGE_CELLS = (
    _PLACED
    + """,
marked AS (SELECT *, min(CASE WHEN event = 'addtocart' THEN place END) OVER w AS cart, max(CASE WHEN place = 0 THEN event END) OVER w AS opens FROM placed WHERE n >= 2 AND split <> 'train' WINDOW w AS (PARTITION BY split, query_id)),
q AS (SELECT split, 'view_stage/' || query_id AS query_id, visitorid, timestamp, itemid AS last_item FROM marked WHERE place = 0 AND event = 'view' UNION ALL SELECT split, 'cart_stage/' || query_id, visitorid, timestamp, itemid FROM marked WHERE place = cart AND cart < n - 1),
pos AS (SELECT DISTINCT split, 'view_stage/' || query_id AS query_id, event AS task, itemid FROM marked WHERE place > 0 AND opens = 'view' AND event IN ('view', 'addtocart', 'transaction')
  UNION ALL SELECT DISTINCT split, 'cart_stage/' || query_id, event, itemid FROM marked WHERE place > cart AND cart < n - 1 AND event = 'transaction')"""
    + _CAND
    + f", f AS (SELECT split, query_id, itemid, {_RAW} FROM cand WHERE source IN ({', '.join(repr(c) for c in COMPONENTS)}) GROUP BY ALL), scored AS ("
    + " UNION ALL ".join(f"SELECT split, query_id, '{t}' AS task, 'pooled_task_specific' AS variant, itemid, {_score_sql(m)} AS score FROM f" for t, m in _MODELS.items())
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT split, query_id, '{t}', 'stage_conditioned', itemid, {_score_sql(m)} FROM f WHERE query_id LIKE '{st}/%'" for (st, t), m in _STAGE_MODELS.items())
    + "), own AS (SELECT split, query_id, task, variant, itemid, row_number() OVER (PARTITION BY split, query_id, task, variant ORDER BY score DESC, itemid) AS rank FROM scored UNION ALL SELECT split, query_id, task, 'category_only', itemid, rank FROM cand, (SELECT unnest(['view', 'addtocart', 'transaction']) AS task) WHERE source = 'category'), "
    + f"asked AS (SELECT split, query_id, task, variant FROM q, (SELECT unnest(['view', 'addtocart', 'transaction']) AS task), (SELECT unnest(['category_only', 'pooled_task_specific', 'stage_conditioned']) AS variant)), ranked AS ({_completed_sql('own', 'task, variant')}), "
    + f"m AS ({_metrics_sql('ranked', by_task=True)}), cells AS (SELECT split, variant || '/' || split_part(query_id, '/', 1) AS variant, task, count(*) AS queries, avg(recall) AS recall, avg(ndcg) AS ndcg FROM m GROUP BY ALL)"
)


def _stage_report(spark: SparkSession, sf_dir: str) -> dict:
    b = _Base(spark, sf_dir)
    return evaluations.evaluate_stages(b.data, b.frozen(), k=K, category_depth=DEPTH, behavioral_depth=DEPTH, max_sessions_per_split=None, models=_MODELS, stage_models=_STAGE_MODELS)


@query(f"WITH {_STAGE_CELLS} SELECT split, variant, task, queries, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM cells")
def given_stage_rankers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation by stages, with given models in place of fitted ones."""
    found = _stage_report(spark, sf_dir)
    rows = [(s, f"{v}/{st}", t, c["queries"], float(c["recall_at_k"]), float(c["ndcg_at_k"])) for s, vs in found["metrics"].items() for v, sts in vs.items() for st, ts in sts.items() for t, c in ts.items()]
    return _rounded(spark.createDataFrame(rows, _LONG), "recall", "ndcg")


@query(
    f"WITH {_STAGE_CELLS}, v AS (SELECT split_part(variant, '/', 1) AS variant, split_part(variant, '/', 2) || task AS cell, ndcg FROM cells WHERE split = 'validation'), means AS (SELECT variant, avg(ndcg) AS mean FROM v GROUP BY 1), best AS (SELECT variant FROM means WHERE variant <> 'stage_conditioned' ORDER BY mean DESC, variant DESC LIMIT 1), "
    "mine AS (SELECT cell, ndcg FROM v WHERE variant = 'stage_conditioned'), other AS (SELECT cell, ndcg AS bar FROM v WHERE variant = (SELECT variant FROM best)) "
    "SELECT (SELECT variant FROM best) AS comparator, avg(ndcg) > avg(bar) AND count(*) FILTER (ndcg > bar) >= 2 AS retained FROM mine JOIN other USING (cell)"
)
def stages_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule on rankers by stage, from the same report; half of the four cells are two."""
    found = _stage_report(spark, sf_dir)
    return spark.createDataFrame([(found["best_validation_comparator"], found["validation_retain_stage_conditioning"])], "comparator string, retained boolean")
