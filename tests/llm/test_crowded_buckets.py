"""SimHash buckets of any size, dense groups, and recall of the pipeline's fingerprints."""

import random

import pytest

from quillon.llm import simhash
from quillon.llm.common import connected


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_roots(values, distance):
    """Smallest signed value that each value reaches."""
    values = sorted(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_components_do_not_hang_on_block_sizes(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {signed(b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6)))) for b in base for _ in range(25)}
    prints = spark.createDataFrame([(v, v) for v in sorted(values)], "node long, f0 long")
    links = simhash.spanning_links(prints, simhash.HALVES, 4)
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    found = {r.node: r.root for r in connected(links).collect()}
    want = plain_roots(values, 4)
    assert {v: found.get(v, v) for v in values} == want


def test_a_dense_group_has_few_links(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {signed(centre ^ (1 << a) ^ (1 << b)) for a in range(64) for b in range(a)} | {signed(centre)}
    prints = spark.createDataFrame([(v, v) for v in sorted(values)], "node long, f0 long")
    links = simhash.spanning_links(prints, simhash.HALVES, 4)
    assert links.count() < 120 * len(values)  # all pairs would be nearly two million
    assert {r.root for r in connected(links).collect()} == {min(values)} and len(values) == 2017


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_at_the_similarity_asked_for(spark):
    """Pairs of five-word similarity from 0.8 to 0.83 are found with a rate of at least 0.9."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    rows = []
    while len(rows) < 600:
        a = [word() for _ in range(rng.randint(80, 500))]
        b = list(a)
        for i in rng.sample(range(len(a)), max(1, round(len(a) * rng.uniform(0.015, 0.025)))):
            b[i] = word()
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.83:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = simhash.one_of_each(docs).count()
    assert len(rows) - left >= 0.9 * len(rows) / 2 and left >= len(rows) / 2
