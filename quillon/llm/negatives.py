"""Hard negatives of embeddings, by branch and bound over ball trees.

Tasks grow trees over the rows that they read, some ten thousand at a time. A ball bounds the inner products of its rows with an anchor: the centre's
product, plus and minus the anchor's length times the radius. A block of anchors, of bounded size, goes down a tree together, depth-first and the
child that promises each of them more first; an anchor leaves where no row can be in its score window or where even the best row would be strictly beneath its current
last place. A task carries the places of its anchors from tree to tree, and gives out one list of bounded length for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, written

#: Rows of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 16_384, 128
#: Bytes of the vectors of a block of anchors, about.
BLOCK_BYTES = 16_000_000
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, as parts of a hundred of the positive's.
WINDOW = (30, 90)


class Ball:
    """A node: centre, radius, labels, and rows (a leaf) or two children."""

    __slots__ = ("centre", "labels", "radius", "rows", "sides")

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        own = vectors[rows]
        self.centre = own.mean(axis=0)
        apart = np.sqrt(((own - self.centre) ** 2).sum(axis=1))
        self.radius = float(apart.max()) * (1 + 1e-9)
        self.labels = np.unique(labels[rows])
        self.rows, self.sides = rows, ()
        if len(rows) > LEAF_ROWS and self.radius > 0:
            # split in the middle along the line between two rows that lie far apart
            far = own[apart.argmax()]
            along = (own @ (own[((own - far) ** 2).sum(axis=1).argmax()] - far)).argsort(kind="stable")
            self.sides = tuple(Ball(vectors, labels, rows[half]) for half in np.array_split(along, 2))


class Places:
    """The best rows so far of each query: scores descending, ties by smaller id. Places without a row have the score -inf."""

    def __init__(self, queries: int, size: int):
        self.scores, self.ids = np.full((queries, size), -np.inf), np.zeros((queries, size), np.int64)

    def last(self, queries: np.ndarray) -> np.ndarray:
        return self.scores[queries, -1]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (-inf: not in question) of rows for queries."""
        size = self.scores.shape[1]
        least = self.last(queries)
        if scores.shape[1] > size:
            least = np.maximum(least, np.partition(scores, -size, axis=1)[:, -size])
        at, row = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        mine = np.unique(at)
        who = np.concatenate([np.repeat(mine, size), at])
        score = np.concatenate([self.scores[queries[mine]].ravel(), scores[at, row]])
        name = np.concatenate([self.ids[queries[mine]].ravel(), ids[row]])
        order = np.lexsort((name, -score, who))
        who, score, name = who[order], score[order], name[order]
        begin = np.flatnonzero(np.diff(who, prepend=-1))
        place = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
        kept = place < size
        self.scores[queries[who[kept]], place[kept]], self.ids[queries[who[kept]], place[kept]] = score[kept], name[kept]


class Anchors:
    """A block of anchors of one dimension, with the scores of their positives where those are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: np.ndarray | None = None):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths = np.sqrt((vectors**2).sum(axis=1)) * (1 + 1e-9)
        if positives is None:
            self.low = self.high = None
        else:  # missing ones have no window
            known = np.isfinite(positives)
            score = np.where(known, positives, 0)
            self.low = np.where(known, np.ceil(WINDOW[0] * score / 100), np.inf)
            self.high = np.where(known, np.floor(WINDOW[1] * score / 100), -np.inf)


def descend(ball: Ball, anchors: Anchors, active: np.ndarray, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, places: list[Places]) -> int:
    """Offers all rows of the ball that can take a place to the active anchors, and returns how many products of rows that took."""
    middle, swing = anchors.vectors[active] @ ball.centre, anchors.lengths[active] * ball.radius
    slack = 1e-9 * (np.abs(middle) + swing) + 1e-6
    most, least = middle + swing + slack, middle - swing - slack
    if anchors.low is None:
        stays = np.isin(anchors.labels[active], ball.labels) & (most >= places[0].last(active))
    else:
        open_ = [(most >= np.maximum(anchors.low[active, j], p.last(active))) & (least <= anchors.high[active, j]) for j, p in enumerate(places)]
        stays = np.any(open_, axis=0)
        if len(ball.labels) == 1:
            stays &= anchors.labels[active] != ball.labels[0]
    active, middle = active[stays], middle[stays]
    if not len(active):
        return 0
    if ball.sides:
        one, other = ball.sides
        first = anchors.vectors[active] @ (one.centre - other.centre) >= 0
        return sum(descend(side, anchors, some, vectors, labels, ids, places) for side, some in ((one, active[first]), (other, active), (one, active[~first])))
    scores = anchors.vectors[active] @ vectors[ball.rows].T
    alike = anchors.labels[active][:, None] == labels[ball.rows]
    if anchors.low is None:
        others = alike & (anchors.ids[active][:, None] != ids[ball.rows])
        places[0].add(active, np.where(others, scores, -np.inf), ids[ball.rows])
    else:
        for j, p in enumerate(places):
            inside = ~alike & (scores >= anchors.low[active, j][:, None]) & (scores <= anchors.high[active, j][:, None])
            p.add(active, np.where(inside, scores, -np.inf), ids[ball.rows])
    return scores.size


def _searched(block: Callable[[], dict[int, Anchors]], n: int, lists: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The best ``n`` rows of a task for each anchor and list, as anchor_id, list, id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = block()
        places = {d: [Places(len(a.ids), n) for _ in range(lists)] for d, a in asked.items()}

        def grow(rows: pd.DataFrame) -> None:
            for size, own in rows.groupby("size"):
                if size in asked:
                    vectors, labels, ids = np.array(own["vector"].tolist()).reshape(len(own), size), own["label"].to_numpy(), own["vec_id"].to_numpy()
                    descend(Ball(vectors, labels, np.arange(len(own))), asked[size], np.arange(len(asked[size].ids)), vectors, labels, ids, places[size])

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TREE_ROWS:
                grow(pd.concat(held))
                held = []
        if held:
            grow(pd.concat(held))
        for size, found in places.items():
            for j, p in enumerate(found):
                at, place = np.nonzero(p.scores > -np.inf)
                yield pd.DataFrame({"anchor_id": asked[size].ids[at], "list": j, "id": p.ids[at, place], "score": np.clip(p.scores[at, place], -(2.0**62), 2.0**62).astype(np.int64)})

    return run


FOUND = "anchor_id long, list int, id long, score long"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector, size of the rows that take part. Of rows that share a vec_id the one with the least label and vector does."""
    whole = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    out = whole.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.rint(F.floor(x.cast("double") * 256).cast("double"))).alias("vector"))
    if not out.groupBy("vec_id").count().where("count > 1").isEmpty():
        out = out.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("one")).select("vec_id", "one.*")
    return out.withColumn("size", F.size("vector"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by 100; of each the first POSITIVES other rows of its label are positives, and for each of these the first
    NEGATIVES rows of other labels whose score is in the positive's WINDOW are returned. Scores are inner products of components floor(256 x), higher ones
    first, ties by smaller vec_id; they are exact as long as they are under 2^53. Rows with a null vec_id, label or vector, or a null or non-finite component take no part; rows that
    share a vec_id are one, see vectors(); vectors meet only those of their own dimension. Where vec_id is divisible by 7 the label is moved on by one of ten. Other columns are left out.
    """
    spark = embeddings.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = written(small_batches(vectors(embeddings).repartition(cores) if embeddings.rdd.getNumPartitions() < cores else vectors(embeddings)), "vectors")
    some = rows.where("vec_id % 100 = 0")
    n_bytes = some.agg(F.sum(8 * F.col("size") + 24)).first()[0] or 0
    blocks = -(-n_bytes // BLOCK_BYTES)
    path = new_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))
    for i in range(blocks):
        block = some.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toPandas()  # of BLOCK_BYTES, about
        asked = {d: Anchors(own["vec_id"].to_numpy(), own["label"].to_numpy(), np.array(own["vector"].tolist()).reshape(len(own), d)) for d, own in block.groupby("size")}
        sent = spark.sparkContext.broadcast(asked)
        first = rows.mapInPandas(_searched(lambda sent=sent: sent.value, POSITIVES, 1), FOUND).withColumn("place", best(["anchor_id"])).where(F.col("place") <= POSITIVES)
        known = first.orderBy("anchor_id", "place").toPandas()  # some rows for each anchor of the block
        sent.destroy()
        for a in asked.values():
            mine = known[known["anchor_id"].isin(a.ids)]
            scores = np.full((len(a.ids), POSITIVES), np.nan)
            scores[np.searchsorted(a.ids, mine["anchor_id"]), mine["place"] - 1] = mine["score"]
            a.__init__(a.ids, a.labels, a.vectors, scores)
        sent = spark.sparkContext.broadcast(asked)
        found = rows.mapInPandas(_searched(lambda sent=sent: sent.value, NEGATIVES, POSITIVES), FOUND).withColumn("rank", best(["anchor_id", "list"])).where(F.col("rank") <= NEGATIVES)
        positives = spark.createDataFrame(list(zip(*(known[c].tolist() for c in ("anchor_id", "place", "id", "score")), strict=True)), "anchor_id long, place int, positive_id long, positive_score long")
        named = found.withColumn("place", F.col("list") + 1).join(F.broadcast(positives), ["anchor_id", "place"])
        named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def oracle_sql() -> str:
    low, high = WINDOW
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score QUALIFY rank <= {NEGATIVES}"""
