"""One layout of sessions serves the internal parts of training too: the same queries, positives and pairs as layouts of these by themselves."""

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import ranks
from quillon.operators import fusion, learning, metrics, rankings, sessions, temporal
from quillon.plans import evaluations

END, TRAIN_END, VALIDATION_END, GAP = 400, 700, 850, 1


@pytest.fixture(scope="module")
def events(spark):
    # sessions that lie before, across and after the end, equal times, a hot visitor, null items and visitors
    rows = [((i * 37) % 1000 * 1000 * 60 // 10, None if i % 41 == 0 else i % 7, ("view", "addtocart", "transaction", "error")[(i * i) % 4], None if i % 29 == 0 else i % 11, i) for i in range(1500)]
    made = spark.createDataFrame(rows, "timestamp long, visitorid long, event string, itemid long, row_id long")
    scale = 6000
    return temporal.with_split(made, TRAIN_END * scale, VALIDATION_END * scale).persist(), END * scale


def found(df, *names):
    return sorted([tuple(r) for r in df.select(*names).collect()], key=repr)


@pytest.mark.parametrize("stages", [False, True])
@pytest.mark.parametrize("gap", [0.1, 1, 10_000])
def test_parts_of_one_layout(events, stages, gap):
    table, end = events
    laid = sessions.laid_out(table, gap, end, stages)
    ask = sessions.stage_queries if stages else sessions.session_queries
    train = table.where("split = 'train'")
    late = train.where(F.col("timestamp") > end).withColumn("split", F.lit("ranker_train"))
    got, want = ask(sessions.later_part(laid, end, "ranker_train"), "ranker_train", gap), ask(late, "ranker_train", gap)
    names = [*(["stage"] if stages else []), "visitorid", "timestamp", "last_item"]
    assert got.eligible == want.eligible and found(got.queries, *names) == found(want.queries, *names)

    # query numbers differ by what came before: positives are compared beside their queries
    def beside(q):
        return found(q.positives.join(q.queries, fusion.keys_of(q.queries)), *names, "task", "itemid")

    assert beside(got) == beside(want) and (gap < 1 or beside(got))
    pairs = sessions.earlier_pairs(laid, end)
    assert found(pairs, "source", "target") == found(rankings.adjacent_pairs(train.where(F.col("timestamp") <= end), gap), "source", "target")


def test_both_splits_at_once(events):
    table, end = events
    laid = sessions.laid_out(table, 5, end, True)
    both = sessions.staged(laid.where("split <> 'train' and events >= 2"), 0)
    each = sessions.stage_queries(table, "validation", 5).union(sessions.stage_queries(table, "test", 5))
    assert found(both.queries, *each.queries.columns) == found(each.queries, *each.queries.columns)
    assert found(both.positives, *each.positives.columns) == found(each.positives, *each.positives.columns)


def test_positions_share_passes(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    order = sorted(r["v"] for r in df.collect())
    jobs, run = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: jobs.append(1) or run(self))
    assert ranks.values_at(df, "v", [100, 100, 19_999, 0]) == [order[100], order[100], order[19_999], order[0]]
    # a pass over the whole range for all, and one more for each value
    assert len([j for j in jobs if j]) <= 5


def test_the_jvm_compiles_the_code_of_stages(spark):
    """With a stage of its own in each row no cell of a stage ranker is folded away; one model's code serves all."""
    lists = ", ".join(f"l_{n} array<long>" for n in (*fusion.COMPONENTS, ""))
    rows = spark.createDataFrame([], f"split string, query_id string, stage string, {lists}, wanted array<struct<task: string, itemid: long>>")
    cells = learning.learned_order([((F.col("stage") == st) & (F.col("task") == t), m) for (st, t), m in queries._STAGE_MODELS.items()])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = metrics.positive_places(rows, [fusion.fused_order(["category"], 60.0), cells, cells], 60.0, 5)._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_what_is_written_goes_when_the_evaluation_ends(spark):
    paths = []

    @evaluations.releasing
    def run():
        table = evaluations.written(spark.range(10).withColumn("x", F.lit("a")))
        paths.extend(table.inputFiles())
        return {"n": table.count()}

    assert run() == {"n": 10} and paths
    at = spark._jvm.org.apache.hadoop.fs.Path(paths[0].rpartition("/")[0])
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
