import random
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, min_length=6, min_count=5, planted=199, dominance=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % planted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= min_length
    words = {w: n for w, n in counts.items() if n >= min_count}
    form, out = {}, []
    around = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= dominance * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(docs, **parameters):
    return sorted(tuple(r) for r in spelling.variants(docs, **parameters).collect())


def corpus(rng, n):
    """Texts over few letters, so that words have many neighbours, some far more frequent than others."""
    words = ["".join(rng.choice("abÀÿé") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    weights = [5 ** (i % 7) for i in range(60)]
    rows = []
    for i in range(n):
        picked = [w if rng.random() < 0.8 else w[: (k := rng.randrange(len(w)))] + rng.choice("abé") + w[k + rng.randrange(2) :] for w in rng.choices(words, weights, k=80)]
        rows.append((i, rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in picked)))
    return rows


@pytest.mark.parametrize("shard", [50_000, 7])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 1000 if shard == 7 else 48_000_000)
    rows = corpus(random.Random(shard), 120)
    for parameters in ({}, {"min_length": 4, "min_count": 2, "planted": 5, "dominance": 2}):
        want = brute(rows, **parameters)
        assert len(want) > 20 and any(w[1] for w in want)
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **parameters) == want


def test_forms_lead_on(spark):
    """A chain of forms, each far more frequent than the one before, and words without a form."""
    chain = ["aaaaaabb", "aaaaaabc", "aaaaaacc", "aaaaaccc", "aaaacccc"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(5 ** (i + 1))) + " strange" * 9
    rows = [(3, text)]
    want = brute(rows, planted=10**12)
    assert {w[0]: w[2] for w in want}["aaaaaabb"] == "aaaacccc"
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), planted=10**12) == want


def test_each_neighbour_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(300)} | {"a" * 3000, "a" * 2999, "ab" * 900})
    tried = spelling.trie(words, range(1, len(words) + 1))
    for w in [*words, "", "abababab", "bbbbbbbbb"]:
        got = list(spelling.neighbours(w, tried))
        assert sorted(x for x, _ in got) == [x for x in words if near(w, x)]
        assert all(words[n - 1] == x for x, n in got)


def test_all_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == brute(rows)
    assert found(odd, min_length=2, min_count=1, planted=2) == brute(rows, min_length=2, min_count=1, planted=2)
    assert found(none) == []
