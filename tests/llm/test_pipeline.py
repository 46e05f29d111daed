import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from quillon.llm.common import written

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_work_on_what_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == DOCUMENTS
        assert 0 < docs.count() <= left
        left = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    key = lambda rows: sorted(map(tuple, rows))
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(pieces.collect())


def test_every_operator_has_its_query():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_sql_has_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    ours = __spark_entry__.queries()[name](spark, sf).select(columns).collect()
    assert sorted(map(tuple, ours), key=str) == sorted(found.fetchall(), key=str)
