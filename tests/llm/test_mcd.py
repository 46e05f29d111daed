"""The minimum-covariance-determinant estimate against all subsets, and the verdicts against a plain computation from it."""

import math
from itertools import combinations

import numpy as np
import pytest

from quillon.llm import quality

SCHEMA = "key string, " + ", ".join(f"{s} long" for s in quality.STATS)
FLOORS = np.diag(np.square(np.array(quality.FLOOR, float)))


def logdet(rows):
    cov = np.cov(rows.T, bias=True) + FLOORS
    return np.linalg.slogdet(cov)[1]


def test_smallest_determinant_of_all_subsets(spark):
    """Cells of fifteen rows in six dimensions, a few of them far off: four starts find the best of all subsets of eleven in many, and come near it in all."""
    rng = np.random.default_rng(6)
    cells = {}
    for k in range(12):
        rows = rng.multivariate_normal(rng.uniform(0, 9000, quality.P), np.diag(rng.uniform(300, 2500, quality.P) ** 2), 15)
        rows[: k % 4] += rng.choice([-1, 1], quality.P) * rng.uniform(15_000, 40_000)
        cells[f"k{k}"] = rows.round().astype(int)
    data = [(k, *map(int, r)) for k, rows in cells.items() for r in rows]
    found = {r.key: r for r in quality.robust_estimates(spark.createDataFrame(data, SCHEMA), True).collect()}
    off = []
    for k, rows in cells.items():
        best = min(logdet(rows[list(c)]) for c in combinations(range(15), 11))
        off.append(found[k].logdet - best)
    assert min(off) > -1e-6 and sum(x < 1e-6 for x in off) >= 5 and max(off) < 1.0


def test_steps_never_raise_the_determinant(spark):
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.normal(3000, 900, (300, quality.P)), rng.normal(9000, 400, (60, quality.P))])
    frame = spark.createDataFrame([("k", *map(int, r)) for r in rows], SCHEMA).cache()
    now = quality.written(quality._starts(frame, True), "t")
    before = {r.start: r.logdet for r in quality.written(quality._step(frame, now, True), "t").collect()}
    now = quality.written(quality._step(frame, now, True), "t")
    for _ in range(4):
        now = quality.written(quality._step(frame, now, True), "t")
        after = {r.start: r.logdet for r in now.collect()}
        assert set(after) == set(range(len(quality.STARTS))) and all(after[s] <= before[s] + 1e-9 for s in after)
        before = after


def plain_verdicts(rows, cells):
    """doc_id -> distance from estimates by key, written out."""
    out = {}
    for r in rows:
        x = np.array([r[s] for s in quality.STATS], float)
        for key in (f"0\x1f={r['lang']}\x1f={r['source']}", f"1\x1f={r['lang']}", "2"):
            if key in cells:
                mean, inverse, scale = cells[key]
                out[r["doc_id"]] = (x - mean) @ inverse @ (x - mean) / scale
                break
    return out


def test_verdicts_match_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and source is not null")
    stats = quality._statistics(docs).where(~quality._rules(20, 30)).cache()
    estimates, _ = quality.estimated(stats)
    cells = {}
    for e in estimates.collect():
        inverse = np.zeros((quality.P, quality.P))
        for (i, j), v in zip(quality.PAIRS, e.inverse, strict=True):
            inverse[i, j] = inverse[j, i] = v
        cells[e.key] = (np.array(e["mean"]), inverse, e.scale)
    want = plain_verdicts([r.asDict() for r in stats.collect()], cells)
    found = {r.doc_id: r for r in quality.judged(docs).collect() if not r.base_failed}
    assert set(found) == set(want)
    for i, d in want.items():
        assert found[i].distance == pytest.approx(d, rel=1e-6, abs=1e-5) and (abs(d - quality.CHI2_CUT) < 1e-4 or found[i].kept == (d <= quality.CHI2_CUT))


def test_ties_and_constant_cells(spark):
    """Equal rows all count at the limit; a cell of one vector has its floor for a spread."""
    frame = spark.createDataFrame([("same", *[500] * quality.P)] * 40 + [("two", *[100 * (i % 2)] * quality.P) for i in range(41)], SCHEMA)
    found = {r.key: r for r in quality.robust_estimates(frame, True).collect()}
    assert found["same"]["mean"] == [500.0] * quality.P and found["same"].logdet == pytest.approx(2 * sum(math.log(x) for x in quality.FLOOR))
    assert all(math.isfinite(x) for x in found["two"].inverse)


def test_capitals_of_all_scripts_count():
    for text in ("АБВГД ЕЖЗ", "ΑΒΓΔ ΕΖΗ", "ŁÓDŹ ŻÓŁĆ"):
        assert quality.counts(text)[-1] > quality.counts(text.lower())[-1] == 0
