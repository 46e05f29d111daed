"""Texts and benchmark items that repeat a q-gram many times."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from quillon.llm import decontamination


def plain_fewest(window, text):
    row = list(range(len(window) + 1))
    best = row[-1]
    for x in text:
        new = [0]
        for i, y in enumerate(window):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_a_run_of_one_character_is_bounded():
    index = decontamination.Index([(0, "0" * 400), (1, "a benchmark item of words " * 4)])
    tracemalloc.start()
    began = time.perf_counter()
    found = decontamination.find(index, ["0" * 60_000, "clean text", "1" * 1000])
    peak, took = tracemalloc.get_traced_memory()[1], time.perf_counter() - began
    tracemalloc.stop()
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in found] == [(0, 0, 0, 60_000, 337, 0)]
    assert peak < 200e6 and took < 60


def test_a_repeated_gram_in_a_large_benchmark_is_bounded():
    index = decontamination.Index([(0, "ab" * 40_000)])
    tracemalloc.start()
    found = decontamination.find(index, ["ab" * 300])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][:2] == (0, 0) and found[0][5] == 0 and peak < 300e6


@pytest.mark.parametrize("meetings", [40, 1000, 500_000])
def test_blocks_change_nothing(monkeypatch, meetings):
    """Few letters, so that q-grams repeat: any size of block gives what all windows against all texts give."""
    monkeypatch.setattr(decontamination, "MEETINGS", meetings)
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(rng.randint(14, 30)))) for i in range(5)]
    index = decontamination.Index(items)
    texts = []
    for _ in range(14):
        item = rng.choice(items)[1]
        passage = list(item[rng.randrange(20) :][:90])
        for _ in range(rng.randint(0, 9)):
            passage[rng.randrange(len(passage))] = rng.choice("xy")
        texts.append("".join(rng.choice("abz") for _ in range(120)) + "".join(passage) + "".join(rng.choice("abz") * rng.randint(1, 6) for _ in range(30)))
    want = {}
    for n, text in enumerate(texts):
        codes = decontamination.canonical(text)[0].tolist()
        for k, (i, _) in enumerate(items):
            at, width, size = int(index.base[k]), int(index.width[k]), int(index.size[k])
            fewest = min(plain_fewest(index.codes[at + s : at + s + width].tolist(), codes) for s in range(0, size - width + 1))
            if fewest <= index.edits[k]:
                want[n, i] = fewest
    found = decontamination.find(index, texts)
    assert {(r[0], r[1]): r[5] for r in found} == want and want
    whole = np.array([r[2:5] for r in found])
    monkeypatch.setattr(decontamination, "MEETINGS", 10**9)
    assert (np.array([r[2:5] for r in decontamination.find(index, texts)]) == whole).all()
