"""The filter's masks against sets of n-grams, and languages that share most of their words."""

import random
from collections import Counter, defaultdict

import numpy as np

from quillon.llm import language


def masks_of(model, h):
    out = model.filters[0][language.slots(h, 0)]
    for k in range(1, language.HASHES):
        out = out & model.filters[0][language.slots(h, k)]
    return out


def test_masks_name_all_languages_that_contain_a_gram(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = []
    for n in range(6):
        own = rng.sample(words, 150)
        rows += [(100 * n + i, " ".join(rng.choice(own) for _ in range(40)), f"l{n}") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sets = defaultdict(set)
    for n in range(6):
        seen = Counter(g for _, t, lang in rows if lang == f"l{n}" for g in language.gram_hashes(language.letters(t)).tolist())
        sets[n] = {g for g, c in seen.items() if c >= language.MIN_COUNT}
    grams = np.array(sorted(set().union(*sets.values())), np.uint64)
    masks = masks_of(model, grams)
    want = np.array([sum(1 << n for n in range(6) if g in sets[n]) for g in grams.tolist()])
    assert (masks & want == want).all()  # none is left out
    assert np.bitwise_count(want).max() >= 5  # some stand in nearly all languages
    assert (masks != want).mean() < 0.01
    text = rows[45][1]
    h = language.gram_hashes(language.letters(text))
    counts = model.counts(h)
    exact = np.array([sum(g in sets[n] for g in h.tolist()) for n in range(6)])
    assert (counts >= exact).all() and (counts - exact).max() <= 2


def test_languages_over_one_vocabulary(spark):
    """Six languages with the same words in other proportions of common ones: n-grams are shared, scores stay high and most rows come out right."""
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    rows = []
    for n in range(6):
        own = ["".join(rng.choice("mnopqrst") for _ in range(4)) for _ in range(6)]
        rows += [(100 * n + i, " ".join(rng.choice(own) if rng.random() < 0.15 else rng.choice(shared) for _ in range(60)), f"l{n}") for i in range(50)]
    truth = {i: lang for i, _, lang in rows}
    found = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) > 0.97 * len(rows)
    assert sum(r.score for r in found) / len(found) > 0.8


def test_many_languages_tally_like_few(spark):
    """Masks of more than eight languages are tallied bit by bit: the same numbers."""
    rng = random.Random(2)
    rows = [(10 * n + i, " ".join("".join(rng.choice("abcdefgh"[n % 4 : n % 4 + 5]) for _ in range(5)) for _ in range(30)), f"l{n}") for n in range(7) for i in range(8)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    h = language.gram_hashes(language.letters(rows[3][1]))
    few = model.tallied(h)
    model.filters.append(np.zeros(language.SLOTS, np.int64))  # a second word takes the other way
    many = model.tallied(h)
    assert few[0].tolist() == many[0].tolist() and np.allclose(few[1], many[1]) and abs(few[2] - many[2]) < 1e-6


def test_two_texts_tell_two_languages_apart(spark):
    rows = [(1, "der Hund und die Katze schlafen auf dem Sofa", "de"), (3, "die Kinder spielen mit dem Ball im Garten", "de"), (6, "the dog and the cat sleep on the couch", "en"), (7, "the children play with the ball in the garden", "en"), (9, "die Katze und der Ball", None), (11, "the cat and the ball", None)]
    found = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [found[i].lang_pred for i in (1, 3, 6, 7, 9, 11)] == ["de", "de", "en", "en", "de", "en"]
    assert all(r.score > 0 for r in found.values())


def test_too_many_languages_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="2 languages"):
        language.fit(spark.createDataFrame([(str(i), "some text") for i in range(3)], "lang string, text string"))
