import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import language, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    on = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = text.split("\n")
    dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(on))


def test_base_counts(spark, sf, odd):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [r.text for r in odd.collect() if r.text is None or len(r.text) < 1000]
    rng = random.Random(2)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["a\n\na\n \na", "x " * 8, "x " * 9]
    for t in texts:
        assert quality.counts(t)[:5] == plain_counts(t)


def test_verdicts(spark, odd, none):
    rng = random.Random(4)
    clean = lambda: " ".join("".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 400)))
    rows = [(i, clean(), "en", f"s{i % 2}") for i in range(900)]
    rows += [(1000 + i, " ".join(w + "$$$###" for w in clean().split()), "en", "s0") for i in range(40)]
    rows += [(2000, "too short", "en", "s0"), (2001, "again and again we say the same thing, " * 20, "en", "s1")]
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not found[i].kept for i in range(900)) <= 9
    assert not any(found[1000 + i].kept for i in range(40))
    assert found[2000].base_failed and found[2001].base_failed and not found[2000].kept
    assert len(found) == len(rows)
    few = quality.judged(odd).collect()
    assert len(few) == odd.count() and all(r.distance is None for r in few) and {r.kept for r in few if not r.base_failed} <= {True}
    assert quality.judged(none).count() == 0


def test_kept_rows_agree_with_judged(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert quality.kept_rows(odd).columns == odd.columns
    assert quality.kept_rows(none).count() == 0


def test_estimates_do_not_hang_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (sorted(map(tuple, quality.judged(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_estimate_is_robust(spark):
    rng = np.random.default_rng(1)
    good = rng.multivariate_normal([1000] * quality.P, np.diag([200**2] * quality.P), 800)
    bad = rng.normal(5000, 10, (120, quality.P))
    rows = [("k", *map(int, x)) for x in np.vstack([good, bad])]
    est = quality.robust_estimates(spark.createDataFrame(rows, "key string, " + ", ".join(f"{s} long" for s in quality.STATS)), True).first()
    assert all(abs(m - 1000) < 60 for m in est["mean"])


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_filter_has_no_false_negative_and_counts_are_corrected():
    model = language.Model(["a", "b"], [1, 2], [np.zeros(language.SLOTS, np.int64)])
    h = language.gram_hashes(language.letters("the quick brown fox jumps over the lazy dog"))
    for k in range(language.HASHES):
        model.filters[0][language.slots(h, k)] |= 1
    model.__post_init__()
    assert model.counts(h)[0] == len(h)
    assert model.predict("the quick brown fox jumps over the lazy dog") == ("a", 1.0)
    assert model.predict("zzzz yyyy xxxx") == ("b", 0.0)
    assert model.predict(None) == model.predict("12 34 !") == ("und", 0.0)


def test_many_languages(spark):
    rng = random.Random(5)
    rows = []
    for n in range(70):  # more than one mask holds
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(100 * n + i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(80)), f"l{n:02}") for i in range(6)]
    found = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) > 0.8 * len(rows)


def test_language_odd_rows(odd, none):
    found = {r.doc_id: r for r in language.identified(odd).collect()}
    assert found[2].lang_pred == found[1].lang_pred == "und" and found[2].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.identified(none).count() == 0


@pytest.mark.parametrize("doc_id", [0, 7, -3])
def test_held_out_is_crc32_of_the_id(spark, doc_id):
    import zlib

    frame = spark.createDataFrame([(doc_id,)], "doc_id long")
    assert frame.select(language.held_out()).first()[0] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
