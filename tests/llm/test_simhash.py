import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.common import connected

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, linked):
    """Smallest index that each index reaches."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_match_the_definition(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").limit(60), odd):
        texts = [r.text for r in docs.select("text").collect()]
        for t in texts:
            assert simhash.fingerprint(t) == [plain_fingerprint(t)]


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("the and of é"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("the and of é".encode(), 42)


def test_no_link_is_lost(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(5)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v, v) for v in signed], "node long, f0 long")
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {tuple(sorted((r.u, r.v))) for r in simhash.links(prints, simhash.HALVES, 4).collect()} == want and want


def test_components_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_connected_chain_hub_and_null(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (None, 5), (7, None), (-3, -9)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, -3: -9, -9: -9}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [3, 20, 90])
def test_spanning_links_connect_what_all_links_connect(size):
    rng = random.Random(size)
    keys, words = [], []
    for key in range(12):
        centers = [rng.getrandbits(128) for _ in range(3)]
        for _ in range(rng.randint(1, size)):
            keys.append(key)
            words.append(rng.choice(centers) ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 20))))
    array = np.array([[w & (1 << 64) - 1 for w in words], [w >> 64 for w in words]], np.uint64)
    a, b = simhash._spanning(np.array(keys), array, 24)
    assert all(keys[i] == keys[j] and (words[i] ^ words[j]).bit_count() <= 24 for i, j in zip(a, b, strict=True))
    index = list(range(len(keys)))
    linked = {tuple(sorted((int(i), int(j)))) for i, j in zip(a, b, strict=True)}
    want = plain_components(index, lambda i, j: keys[i] == keys[j] and (words[i] ^ words[j]).bit_count() <= 24)
    assert plain_components(index, lambda i, j: tuple(sorted((i, j))) in linked) == want


def near_copy(rng, words, part):
    return [rng.choice(["zus", "xen", "qua"]) if rng.random() < part else w for w in words]


def test_one_of_each_finds_planted_copies(spark, odd):
    rng = random.Random(11)
    rows, truth = [], {}
    for g in range(60):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 300))]
        for c in range(3):
            rows.append((len(rows), " ".join(near_copy(rng, words, 0.012 if c else 0))))
            truth[rows[-1][0]] = g
    kept = [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()]
    assert {truth[i] for i in kept} == set(range(60))  # nothing else goes
    assert len(kept) <= 66  # of 120 planted copies nearly all go
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in left.collect())
    assert ids == sorted(["1", "4", "5", "None", "None", "-7"])


def test_odd_rows_and_empty_tables(odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    zero = {r.component_id for r in found if r.f0 == 0}
    assert zero == {1}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
