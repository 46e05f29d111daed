import math
import random

import duckdb
import numpy as np
import pytest

from quillon.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        one = (label, [math.floor(256 * float(np.float32(x))) for x in e])
        kept[i] = min(kept.get(i, one), one)
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            inside = [(n, i) for n, i, other in scores if other != label and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(a, positive, rank, i, -p, -n) for rank, (n, i) in enumerate(inside, 1)]
    return sorted(out)


def found(frame):
    out = negatives.hard_negatives(frame)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(rng, n, dimension, values=None):
    centres = [[rng.uniform(-1, 1) for _ in range(dimension)] for _ in range(6)]
    point = lambda: [rng.choice(values) if values else c + rng.gauss(0, 0.2) for c in rng.choice(centres)]
    return [(i, point(), rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("dimension", "values"), [(8, None), (3, (0.0, 0.5, -0.25)), (1, (1.0, 2.0))])
def test_against_brute_force(spark, monkeypatch, dimension, values):
    """Clustered vectors; vectors with many ties; several trees, leaves and blocks."""
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 400)
    rows = made(random.Random(dimension), 900, dimension, values)
    want = brute(rows)
    assert len(want) > 50
    assert found(spark.createDataFrame(rows, SCHEMA)) == want


def test_trees_prune():
    """Anchors leave balls: of tight clusters a small part of all products is computed, and the places are those of all rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (40, 16))
    vectors = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 8, (8000, 16)))
    labels, ids = rng.integers(0, 5, 8000), rng.permutation(8000)
    ball = negatives.Ball(vectors, labels, np.arange(8000))
    asked = negatives.Anchors(ids[:50], labels[:50], vectors[:50])
    places = [negatives.Places(50, 5)]
    assert negatives.descend(ball, asked, np.arange(50), vectors, labels, ids, places) < 0.3 * 50 * 8000
    for i in range(50):
        others = [k for k in range(8000) if labels[k] == labels[i] and k != i]
        best = sorted((-vectors[k] @ vectors[i], ids[k]) for k in others)[:5]
        assert best == list(zip(-places[0].scores[i], places[0].ids[i], strict=True))
    asked = negatives.Anchors(ids[:50], labels[:50], vectors[:50], places[0].scores)
    lists = [negatives.Places(50, 10) for _ in range(5)]
    assert negatives.descend(ball, asked, np.arange(50), vectors, labels, ids, lists) < 0.6 * 50 * 8000


def test_sql_has_the_same_rows(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(negatives.oracle_sql())
    assert [c[0] for c in want.description] == negatives.hard_negatives(embeddings).columns
    want = sorted(want.fetchall())
    assert want
    assert found(embeddings) == want == brute([tuple(r) for r in embeddings.select("vec_id", "embedding", "label").collect()])


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = made(rng, 230, 4)
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1100, [1.0] * 4, None), (1200, [1.0, None, 1.0, 1.0], 1), (1300, [float("nan")] * 4, 1), (1400, [float("inf")] * 4, 1), (1500, [], 1), (1501, [], 1), (1502, [], 2), (1600, [1.0], 1), rows[100], rows[5], (200, [0.5] * 4, 1), (-100, [0.5] * 4, 2), (1700, [0.0] * 4, 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert {1500, -100, 1700} <= {w[0] for w in want}
    assert found(frame.selectExpr("*", "1 as score", "2 as list", "'x' as size", "3L as id", "4 as rank")) == want
    assert found(frame.limit(0)) == []
